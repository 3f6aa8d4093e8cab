import random

import numpy as np
import pytest

from codestrata.llm import simhash
from codestrata.llm.components import connected


def brute_components(values, budget):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= budget:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clustered(seed, groups=40):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out | {0, 1, 2**64 - 1})


def test_fingerprint_equals_plain_form():
    rng = random.Random(1)
    words = ["Ab", "cd", "\u00c4x", "\u00a0", "e\x0bf", "g\x1ch"]
    texts = [None, "", " \t\r\n", "One", "one TWO three", "a b c d", "x " * 5000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 700))) for _ in range(20)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_join_equals_all_pairs(budget):
    values = clustered(budget)
    array = np.array(values, dtype=np.uint64)
    tries = simhash.Tries(array, np.array([0, len(array)]))
    for block in (7, 1 << 19):
        assert simhash.spanning(len(values), tries.links(budget, block)).tolist() == brute_components(values, budget)


@pytest.mark.parametrize("segment", [4, 1024])
def test_links_across_keys_and_segments(spark, segment):
    values = clustered(7)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, segment)
    found = {r["node"]: r["component"] for r in connected(links).collect()}
    labels = brute_components(values, 4)
    smallest = {}
    for value, label in zip(signed, labels, strict=True):
        smallest[label] = min(value, smallest.get(label, value))
    for value, label in zip(signed, labels, strict=True):
        assert found.get(value, value) == smallest[label]


def test_connected_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 199), (200, 199)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 199, 199: 199}


def test_odd_rows_and_clashing_columns(spark):
    rows = [
        (5, "a b c d e", "x", 1.0), (3, "a b c d e", "y", 2.0), (3, "a b c d e", "y", 2.0), (None, "a b c d e", None, None),
        (9, None, "z", None), (8, "", "z", None), (None, "other words stand in here", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string, fp double")
    found = simhash.simhash_classes(docs)
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in found.collect()) == [
        (-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)
    ]
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["component"] or "") for r in kept.collect()) == [(-1, ""), (3, "y"), (8, "z")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_classes(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0
