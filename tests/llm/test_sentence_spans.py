import hashlib
import random

import pytest

import compare
from codestrata.llm import queries, sentence_spans


def split(text, ends=sentence_spans.ENDS, least=0):
    """Sentences, sign by sign."""
    parts, text = [], text or ""
    while text:
        at = least
        while at < len(text) and text[at] not in ends:
            at += 1
        if at >= len(text):
            return [*parts, text]
        while at < len(text) and text[at] in ends:
            at += 1
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        parts.append(text[:at])
        text = text[at:]
    return parts


def brute(rows, run, **sentences):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for name, text in rows:
        parts = split(text, **sentences)
        gone = set()
        for i in range(len(parts) - run + 1):
            words = " ".join(p.strip(" \t\r\n") for p in parts[i : i + run])
            if words in seen:
                gone |= set(range(i, i + run))
            seen.add(words)
        out.append((name, len(parts), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run,sentences", [(3, {}), (2, {"least": 9}), (1, {"ends": ",.", "least": 4}), (3, queries.SENTENCES)])
def test_equals_brute_force(spark, run, sentences):
    rng = random.Random(run)
    pool = [" ".join(rng.choice(["ab", "c", "dé"]) for _ in range(rng.randint(1, 5))) + rng.choice([". ", "!\n", "? ", ".\t\n ", ", ", ";"]) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "no end"), (103, "...!!!\n\n"), (None, rows[3][1] + "tail"), (104, "x. " * 3000), (105, "\n \U0001f600, " * 40)]
    assert all("".join(split(t, **sentences)) == (t or "") for _, t in rows)
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, parts string")
    found = sentence_spans.remove_repeats(docs, run=run, **sentences).collect()
    assert sorted(((r["id"], r["n_sentences"], r["n_removed"], r["kept"]) for r in found), key=repr) == brute(rows, run, **sentences)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b. c d. e f. g h."), (1, "a b. c d. e f. g h.")], "doc_id long, text string")
    assert [r["n_removed"] for r in sentence_spans.remove_repeats(docs).collect()] == [0, 0]
    assert sentence_spans.remove_repeats(docs.limit(0)).count() == 0


def test_query_equals_duckdb(spark):
    con = compare.connect("/root/testdata/sf0.001")
    name = "op5_sentence_span_dedup"
    assert compare.difference(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con, queries.ORACLE_SQL[name]) == ""


def test_removes_short_runs(spark):
    rows = [(1, "One. Two. Three. Tail one is here."), (2, "Other head. One. Two. Three."), (3, "a.\nb.\nc.\na.\nb.\nc.\n"), (4, "One. Two.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["id"], r["n_sentences"], r["n_removed"], r["kept"]) for r in sentence_spans.remove_repeats(docs).collect())
    assert found == brute(rows, 3)
    assert [r[2] for r in found] == [0, 3, 3, 0]


def test_query_counts_short_parts_to_the_next_sentence(spark, tmp_path):
    passage = "Of. The first part of a passage that repeats, and the second one is long enough too; then a third, long enough as well. "
    rows = [(1, "Some head of a text that is long. " + passage + "Tail one is here."), (2, f"Another head that ends in a sign. {passage}"), (3, "Of. The. In. " * 9), (4, "Of. The. In.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_sentence_span_dedup"](spark, str(tmp_path)).collect()}
    for name, n, removed, kept in brute(rows, 3, **queries.SENTENCES):
        assert (found[name]["n_sentences"], found[name]["n_removed"]) == (n, removed)
        assert found[name]["kept_md5"] == hashlib.md5(kept.encode()).hexdigest()
    assert found[1]["n_removed"] == found[4]["n_removed"] == 0 and found[2]["n_removed"] == 3
