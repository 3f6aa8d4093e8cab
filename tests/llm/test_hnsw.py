import math
import random

import numpy as np
import pytest

from codestrata.llm import hnsw, queries


def brute(rows, threshold):
    """n_links and component of (id, vector, label) rows, as the contract says."""
    def good(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    parent, count = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    count[i] += 1
                    count[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], count[i], least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def sample(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim))
    rows = [(k, (centres[rng.integers(15)] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 1])).astype(np.float32).tolist(), int(rng.integers(3))) for k in range(n)]
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(30)]
    return rows


@pytest.mark.parametrize("settings", [
    hnsw.Settings(threshold=0.9),
    hnsw.Settings(threshold=0.9, shard_rows=50, block_rows=16, part_blocks=1, degree=4, build_beam=8, beam=2, audits=8),
])
def test_equals_all_pairs(spark, settings):
    rows = sample(1)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = hnsw.near_duplicates(docs, settings=settings).collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"]) for r in found), key=repr) == brute(rows, 0.9)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found)


def test_odd_rows(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [
        (1, v, 0), (2, [2.0, 4.0], 0), (3, v, 0), (3, v, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0], 0),
        (9, [1.0, nan], 0), (10, [inf, 1.0], 0), (11, [1.0, None], 0), (None, v, 0), (12, [1.0, 2.0, 0.0], 0), (13, [-0.0, 1e-30], 0), (14, [0.0, 1e30], 0),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    found = hnsw.near_duplicates(docs).collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"]) for r in found), key=repr) == brute(rows, 0.93)
    assert hnsw.near_duplicates(docs.limit(0)).count() == 0


def test_poor_graph_is_scanned():
    rng = random.Random(3)
    raw = np.array([[rng.gauss(0, 1) for _ in range(4)] for _ in range(300)])
    exact = hnsw.unit(raw)
    settings = hnsw.Settings(threshold=0.8, beam=2)
    graph = hnsw.Graph(exact.astype(np.float32), settings)
    graph.links = [np.full_like(x, hnsw.NONE) for x in graph.links]
    ids = np.arange(300)
    a, b, beam, recall = hnsw.block_links(graph, ids, exact, ids, exact)
    r, c = np.nonzero(exact @ exact.T >= 0.8)
    assert beam == 0 and recall == 1.0
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(r.tolist(), c.tolist()) if i != j}


def test_query_recall_on_the_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    expected = brute([(r["vec_id"], list(r["embedding"]), r["label"]) for r in table], 0.93)
    found = queries.QUERIES["op1_hnsw_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == expected


def test_a_graph_without_edges_fails_the_audit_without_links_in_the_sample():
    rng = np.random.default_rng(4)
    shard, asking = rng.normal(size=(600, 24)), rng.normal(size=(300, 24))
    asking[7] = shard[450] + 1e-3  # the only link; the audit samples four other queries
    ids, query_ids = np.arange(600), np.arange(1000, 1300)
    settings = hnsw.Settings(threshold=0.93, audits=4)
    graph = hnsw.Graph(hnsw.unit(shard).astype(np.float32), settings)
    a, b, beam, _ = hnsw.block_links(graph, ids, hnsw.unit(shard), query_ids, hnsw.unit(asking))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1007, 450)] and beam > 0
    graph.links = [np.full_like(layer, hnsw.NONE) for layer in graph.links]
    a, b, beam, _ = hnsw.block_links(graph, ids, hnsw.unit(shard), query_ids, hnsw.unit(asking))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1007, 450)] and beam == 0
