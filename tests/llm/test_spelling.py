import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pytest
from codestrata.llm import queries, spelling
from pyspark.sql import functions as F

TYPE = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, s=spelling.Settings()) -> list[tuple]:
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= s.least_length and n >= s.least_count}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    forms = {}
    for w, found in near.items():
        if found and words[best := min(found, key=lambda x: (-words[x], x))] >= s.ratio * words[w]:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))))
    return sorted(out, key=repr)


def edited(rng: random.Random, word: str) -> str:
    at, kind, letter = rng.randrange(len(word)), rng.randrange(3), rng.choice("abcdeéÿ")
    return word[:at] + ([letter] if kind < 2 else [""])[0] + word[at + (kind > 0) :]


def texts(rng: random.Random, words: int = 250) -> list[tuple]:
    stems = ["".join(rng.choices("abcdeé", k=rng.randint(6, 11))) for _ in range(words)]
    chain = ["kabcabcabc" + "z" * k for k in range(4)]
    pool = [w for k, w in enumerate(stems) for _ in range(1 + 120 // (k + 1))] + [edited(rng, edited(rng, w)) for w in stems for _ in range(3)] + [edited(rng, w) for w in stems for _ in range(6)]
    pool += [c for k, c in enumerate(chain) for _ in range(4 * 14**k)]
    pool += [w.upper() for w in stems[:20]] + ["x" * 300, "x" * 300, "x" * 299 + "y", "x" * 299 + "y"]
    rng.shuffle(pool)
    return [(k, " ".join(pool[k::60]) + ".\n7 ×÷ß_a") for k in range(60)]


@pytest.mark.parametrize(
    "settings", [spelling.Settings(), spelling.Settings(cell=20, leaf=4), spelling.Settings(cell=20, visitors=30, sample=100, leaf=2), spelling.Settings(cell=1, sample=1)]
)
def test_variants_against_brute_force(spark, settings):
    rows = texts(random.Random(1))
    rows += [(None, rows[3][1]), (3, rows[3][1]), (99, None), (98, ""), (97, "a b c 1 2 3")]
    docs = spark.createDataFrame(rows, TYPE).repartition(3).withColumns({c: F.lit(1) for c in ("word", "n", "cell", "form", "id")})
    found = spelling.variants(docs, settings=settings).collect()
    expected = brute(rows)
    assert sorted(map(tuple, found), key=repr) == expected
    assert any(r[1] != r[2] for r in expected if r[1]) and any(r[1] is None and r[4] for r in expected)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "short words only, ünd 1234567890123")], TYPE)
    assert spelling.variants(docs).collect() == spelling.variants(docs.limit(0)).collect() == []


def test_near_pairs_of_anagrams():
    rng = random.Random(2)
    words = sorted({"".join(rng.sample("aabbccd", 7)) for _ in range(300)} | {"".join(rng.sample("aabbcce", 7)) for _ in range(300)})
    long = sorted({"".join(rng.sample("aabbccde", 8)) for _ in range(500)})
    for others in (words, long):
        p, q = spelling.near_pairs(spelling.Words(others), spelling.Words(words), 16)
        assert sorted(zip(p.tolist(), q.tolist(), strict=True)) == [(i, j) for i, a in enumerate(others) for j, b in enumerate(words) if one_edit(a, b)]


def test_upper_trees_prune_and_lose_nothing():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefgh", k=8)) for _ in range(4000)})
    counts = spelling.Words(words).counts
    tree, cells = spelling.UpperTree.fitted(counts, 64, 0)
    rows, own = tree.visits(counts, 0, 0)
    assert sorted(rows.tolist()) == list(range(len(words))) and 32 <= cells <= 128
    place = own[np.argsort(rows)]
    rows, seen = tree.visits(counts, 1, 1)
    visits = set(zip(rows.tolist(), seen.tolist(), strict=True))
    p, q = spelling.near_pairs(spelling.Words(words), spelling.Words(words), 32, own=True)
    assert all((a, place[b]) in visits for a, b in zip(p.tolist(), q.tolist(), strict=True))
    assert len(visits) < len(words) * cells / 2


def test_query_equals_duckdb(spark):
    con = compare.connect("/root/testdata/sf0.001")
    found = queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert compare.difference(found, con, queries.ORACLE_SQL["op12_spelling_variants"]) == ""
