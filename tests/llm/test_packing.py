import zlib

import numpy as np
import pytest

from codestrata.llm import packing, queries

TEXTS = [
    None, "", " ", "It's we'll THEY'RE I'm 12 3.5 -- ok_then", "\u00c9t\u00e9 \u0130stanbul \u03a3\u03a3 stra\u00dfe e\u0301",
    "a\x1cb a\x85b \u00b2\u00bc x\u00aay <|endoftext|> z", "caf\u00e9 \u00a0 ___ ... ?!", "\u4f60\u597d world \U0001f600", "word " * 6000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.tokenizer_of(packing.default_tokenizer())


def test_ids_equal_the_tokenizer(tokenizer, spark):
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, found in zip(texts, tokenizer.encode(texts), strict=True):
        assert found.tolist() == tokenizer.plain(text or "").tolist()


def test_few_remembered_words():
    small = packing.WordTokenizer(packing.default_tokenizer(), remembered=5)
    texts = ["one two three four", "five six seven eight nine ten", "one two three"] * 40
    assert [x.tolist() for x in small.encode(texts)] == [small.plain(t).tolist() for t in texts]


def check(rows, expected, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(expected)
    for name, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == expected[name]
        place = 0
        for r in pieces:
            assert r["start"] == place and len(r["ids"]) == 4 * r["length"] and r["doc_tokens"] == len(expected[name])
            place += r["length"]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        place = 0
        for r in pieces:
            assert r["offset"] == place and r["length"] > 0
            place += r["length"]
        assert place == capacity or (place < capacity and place & (place - 1) == 0)


@pytest.mark.parametrize("capacity,block", [(2048, 1 << 20), (64, 500)])
def test_pieces_hold_every_id_once(spark, tokenizer, capacity, block):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = packing.pack(docs, capacity=capacity, block_tokens=block).collect()
    check(found, {i: [*tokenizer.plain(t or "").tolist(), 1] for i, t, _ in rows}, capacity)


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    found = packing.pack(docs).collect()
    assert sum(r["length"] for r in found if r["id"] == 1) == 6
    assert sum(r["length"] for r in found if r["id"] is None) == 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_costs_are_balanced():
    packer = packing.Packer(2048, 1.0, 1 / 1024)
    rng = np.random.default_rng(0)
    for d, n in enumerate(rng.integers(1, 2000, 400).tolist()):
        packer.add(d, n)
    packer.pack_full()
    costs = {}
    for _, _, n, s, _ in packer.pieces:
        costs[s] = costs.get(s, 0) + packer.cost(n)
    values = np.array(list(costs.values()))
    assert values.std() / values.mean() < 0.2


def test_query_digest(spark, tokenizer):
    rows = queries.QUERIES["op2_cost_balanced_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows[:200]:
        ids = np.array([*tokenizer.plain(texts[r["doc_id"]] or "").tolist(), 1], dtype="<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
