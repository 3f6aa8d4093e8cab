import gc
import hashlib
import random
import zlib

import numpy as np
import pytest

from codestrata.llm import nbest, queries


@pytest.fixture(scope="module")
def lattice():
    return nbest.Lattice(nbest.default_model(), n=4)


def brute(lattice, text, n):
    """Scores of the n best ways through one lattice over the whole text, by lists of all n best prefixes."""
    text = nbest.BLANK + text.replace(" ", nbest.BLANK)
    best = [[(0.0, ())]] + [[] for _ in text]
    for end in range(1, len(text) + 1):
        found = []
        for start in range(max(0, end - lattice.longest), end):
            piece = lattice.pieces.get(text[start:end])
            if piece is None and start < end - 1:
                continue
            score = piece[1] if piece else lattice.penalty
            ids = (piece[0],) if piece else tuple(lattice.bytes[b] for b in text[start].encode())
            found += [(s + score, w + ids) for s, w in best[start]]
        best[end] = sorted(found, key=lambda x: -x[0])[: 4 * n]
    return [s for s, _ in best[-1][:n]]


TEXTS = [
    "a", " ", "  two  blanks ", "Hello, world! It's (not) 3.14².\n\nNew\tline", "unbelievable characteristics", "▁block▁sign", "naïve café straße",
    "\U0001f600 你好吗 \x00\x07", "....----====", "www.example.com/a_b?c=1&d=2", "x", "\n", "ab" * 40,
]


@pytest.mark.parametrize("text", TEXTS)
def test_scores_equal_brute_force_and_decode(lattice, text):
    ways = lattice.ways(text)
    assert [w.score for w in ways] == brute(lattice, text, 4)
    assert len({w.ids for w in ways}) == len(ways)
    for way in ways:
        assert lattice.decode(np.array(way.ids, int)) == text.replace(nbest.BLANK, " ")


def test_random_texts(lattice):
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", "er", " ", "é", ",", "1", "\n", "z", "²", "_"]) for _ in range(rng.randint(1, 25)))
        assert [w.score for w in lattice.ways(text)] == brute(lattice, text, 4)


def test_fine_units_are_used_and_equal_coarse_ones(lattice):
    assert lattice.units is nbest.FINE
    coarse = nbest.Lattice(nbest.default_model(), n=4, remembered=2)
    coarse.units = nbest.COARSE
    for text in TEXTS:
        assert [w.score for w in coarse.ways(text)] == [w.score for w in lattice.ways(text)]
        assert "".join(nbest.FINE.findall(text)) == text


def test_round_trip_and_odd_rows(spark):
    rows = [(1, "some text here", 5), (1, "some text here", 5), (2, None, None), (None, "", 1), (3, "long" * 2000 + " " + "word " * 3000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(2)
    found = nbest.decode(nbest.encode(docs, n=3)).collect()
    for name, text, _ in rows:
        mine = sorted((r["rank"], r["text"]) for r in found if r["id"] == name)
        assert mine and all(t == (text or "") for _, t in mine)
    assert len([r for r in found if r["id"] == 1]) == 6
    assert nbest.encode(docs.limit(0)).count() == 0


def test_query_digest(spark, lattice):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.QUERIES["op6_nbest_segmentation"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found[:200]:
        way = lattice.ways(texts[r["doc_id"]])[r["rank"] - 1]
        assert (r["score"], r["n_pieces"], r["ids_crc32"]) == (way.score, len(way.ids), zlib.crc32(np.array(way.ids, "<u4").tobytes()))


def test_query_decodes_every_segmentation(spark, tmp_path):
    rows = [(1, "some text here"), (2, None), (3, ""), (4, "long" * 2000), (5, " \n  two\t\u4f60\U0001f600 \x00 "), (6, f"{nbest.BLANK}sign"), (7, "word. " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op6_nbest_segmentation"](spark, str(tmp_path)).collect()
    texts = {name: (text or "").replace(nbest.BLANK, " ") for name, text in rows}
    assert {r["doc_id"] for r in found} == set(texts)
    assert all(r["decoded_md5"] == hashlib.md5(texts[r["doc_id"]].encode()).hexdigest() for r in found)


def test_decode_equals_the_library(lattice):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(lattice.model.get_piece_size()) for _ in range(rng.randint(0, 6))]
        ids = [rng.choice([*ids, lattice.bytes[10], lattice.bytes[200], lattice.pieces[nbest.BLANK][0]]) for _ in ids]
        assert lattice.decode(np.array(ids, int)) == lattice.model.decode(ids)


def test_memory_forgets_what_is_not_asked_for():
    made = []
    memory = nbest.Memory(lambda u: made.append(u) or u.upper(), 4)
    for unit in "ababcabdae":
        assert memory[unit] == unit.upper()
        assert len(memory) + len(memory.older) <= 4
    assert made.count("a") == 1 and memory["x" * 65] == "X" * 65 and "x" * 65 not in memory


def test_wide_units_are_made_of_fine_ones(lattice):
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", " ", " ", "  ", "\n", ".", nbest.BLANK, "é1"]) for _ in range(rng.randint(1, 12)))
        whole = nbest.BLANK + text.replace(" ", nbest.BLANK)
        units = lattice._split(text)
        assert units == nbest.WIDE.findall(whole) and "".join(units) == whole
        assert [u for x in units for u in nbest.FINE.findall(x)] == nbest.FINE.findall(whole)


def test_remembered_ways_stay_out_of_garbage_collection():
    small = nbest.Lattice(nbest.default_model(), n=2)
    small.ways("Many words, some of them new: zwirbelig, quorxle.")
    gc.collect()
    assert small.known and small.joined
    assert not any(gc.is_tracked(found) for found in [*small.known.values(), *small.joined.values()])
