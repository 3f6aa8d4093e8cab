import random
import re
from collections import Counter

import compare
from codestrata.llm import host_rules, queries
from pyspark.sql import functions as F

TYPE = "doc_id long, source string, text string"


def brute_measures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(runs)
    covered = {k + d for k, r in enumerate(runs) if often[r] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def failures(m: tuple) -> list[bool]:
    words, chars, symbols, lines, dup, repeats = m
    return [words < 10, 100 * repeats > 20 * words, 10 * symbols > words, 10 * dup > 3 * lines, chars < 3 * words or chars > 10 * words]


def brute_kept(rows) -> list[bool]:
    found = [failures(brute_measures(r[2])) for r in rows]
    hosts = {}
    for r, f in zip(rows, found, strict=True):
        if r[1] is not None:
            hosts.setdefault(r[1], []).append(f)
    bad = set()
    for k in range(5):
        sizes, sums = [len(v) for v in hosts.values()], [sum(f[k] for f in v) for v in hosts.values()]
        total, mean = sum(sizes), sum(sums) / sum(sizes)
        tie = 0.0
        if len(sizes) == 1:
            tie = 1.0
        elif 0 < mean < 1:
            spread = sum(n * (f / n - mean) ** 2 for n, f in zip(sizes, sums, strict=True)) / (mean * (1 - mean))
            room = total - sum(n * n for n in sizes) / total - (len(sizes) - 1)
            tie = min(1.0, max(0.0, (spread - (len(sizes) - 1)) / room)) if room else 0.0
        for name, n, f in zip(hosts, sizes, sums, strict=True):
            if (tie * f + (1 - tie) * mean) / (tie * n + 1 - tie) > 0.5:
                bad.add(name)
    return [not any(f[:2]) and r[1] not in bad for r, f in zip(rows, found, strict=True)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))


def table(spark, rows):
    docs = spark.createDataFrame(rows, TYPE).repartition(3)
    return docs.withColumns({c: F.lit(1) for c in ("n", "host", "salt", "_words", "n_words", "rejected", "id")})


def test_measures_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b c d", "a a a a a", "a a a a a a", "x\ny\nx\n\n x\n\n\r\nx\ny\r\ny\r\n", "a\x0bb\x0cc\x1cd\x85e f", "#*$ %&|<> #€ \U0001f600 ü"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(5, 60))) for _ in range(40)] + ["\n".join(rng.choices(["l 1", "l 2 ", " ", "l 3 l 3"], k=30))]
    texts += [prose(rng, 40_000), prose(rng, 500) + " " + "same words come again here " * 3_000]
    rows = [(k, "s", t) for k, t in enumerate(texts)]
    found = {r.doc_id: r for r in host_rules.measure(spark.createDataFrame(rows, TYPE)).collect()}
    for k, t in enumerate(texts):
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute_measures(t), repr(t)[:80]


def test_hosts_against_brute_force(spark):
    rng = random.Random(5)
    junk = ["# # # # # # # # # # # # # " + prose(rng, 12) for _ in range(400)]
    rows = [(k, "junk.example", junk.pop()) for k in range(180)] + [(200 + k, "junk.example", prose(rng, 30)) for k in range(20)]
    rows += [(1000 + k, f"host{k % 30}", prose(rng, 30) if rng.random() < 0.95 else junk.pop()) for k in range(900)]
    rows += [(3000, "once.example", junk.pop()), (3001, None, junk.pop()), (3002, None, prose(rng, 20)), (3003, "once.example", None)]
    rows += [rows[0], (None, "junk.example", prose(rng, 30)), (None, None, None)]
    found = host_rules.judge(table(spark, rows), F.col("source"))
    expected = Counter((r[0], k) for r, k in zip(rows, brute_kept(rows), strict=True))
    assert Counter((r.id, r.kept) for r in found.collect()) == expected
    assert expected[200, False] == 1  # clean itself, of a rejected host
    assert expected[3000, True] == 1 or expected[3000, False] == 1
    rates = {r.host: r.symbols for r in host_rules.host_rates(host_rules.measure(table(spark, rows).select("doc_id", F.col("source").alias("host"), "text")), host_rules.RULES).collect()}
    assert rates["junk.example"] > 0.8 > 0.5 > rates["once.example"] > rates["host1"]


def test_few_hosts_and_empty(spark):
    rng = random.Random(6)
    clean, junk = prose(rng, 30), "$ " * 40 + prose(rng, 20)
    for rows in ([(1, "a", clean), (2, "a", junk), (3, "a", junk)], [(1, "a", clean), (2, "b", junk)], [(1, None, clean)], [(1, "a", clean), (2, "b", clean)]):
        found = host_rules.judge(table(spark, rows), F.col("source")).collect()
        expected = brute_kept(rows) if any(r[1] for r in rows) else [True]
        assert [r.kept for r in sorted(found)] == expected
    assert host_rules.judge(table(spark, rows).limit(0), F.col("source")).collect() == []


def test_query_equals_duckdb(spark):
    con = compare.connect("/root/testdata/sf0.001")
    found = queries.QUERIES["op13_host_quality_rules"](spark, "/root/testdata/sf0.001")
    assert compare.difference(found, con, queries.ORACLE_SQL["op13_host_quality_rules"]) == ""
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
