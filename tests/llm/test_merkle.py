import hashlib

import compare
import pytest
from codestrata.llm import merkle, queries
from pyspark.sql import functions as F

TYPE = "doc_id long, source string, lang string, n_chars long, text string"


def h(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[str]:
    found = []
    for level in tree[:-1]:
        found += level[at ^ 1 : (at ^ 1) + 1]
        at //= 2
    return found


def brute(rows) -> set[tuple]:
    """leaf, subroot, root, proof of every row."""
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: levels([x for _, x in sorted(((r[0] is not None, r[0] or 0), leaf(r)) for r in rows if r[2] == n)]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for at, x in enumerate(trees[n][0]):
            out.append((x, trees[n][-1][0], top[-1][0], h(*siblings(trees[n], at), *siblings(top, k))))
    return sorted(out)


def rows_of(sizes: dict) -> list[tuple]:
    return [(7 * k + len(lang or ""), f"s{k}", lang, k if k % 3 else None, f"téxt {k}" if k % 4 else None) for lang, n in sizes.items() for k in range(n)]


@pytest.mark.parametrize("height", [1, 2, 12])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"de": 17, "": 5, None: 9, "ü": 4, "z": 1, "en": 8}])
def test_witnesses_against_all_levels(spark, height, sizes):
    rows = rows_of(sizes)
    docs = spark.createDataFrame(rows, TYPE).repartition(4).withColumns({c: F.lit("x") for c in ("tree", "node", "position", "witness")})
    whole = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    found = merkle.folded(merkle.manifest(docs, F.col("lang"), F.col("doc_id"), whole, height=height)).collect()
    assert sorted((r.leaf.hex(), r.subroot.hex(), r.root.hex(), h(r.witness.hex())) for r in found) == brute(rows)
    assert all(r.folded_root == r.root for r in found)


def test_open_trees_extend_witnesses():
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    trees = merkle.OpenTrees(len(nodes))
    for node in nodes:
        trees.append(node)
    root = trees.close(4)
    assert root.hex() == levels([n.hex() for n in nodes])[-1][0]
    for k, node in enumerate(nodes):
        assert merkle.fold(node, trees.witness_of(k), [(k, 11)]) == root
        assert merkle.fold(nodes[k - 1], trees.witness_of(k), [(k, 11)]) != root


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "x" * 300_000), (5, "s", "en", 1, ""), (5, "s", "en", 1, "")]
    docs = spark.createDataFrame(rows, TYPE)
    whole = merkle.leaf_of(*[F.col(c) for c in docs.columns])
    found = merkle.folded(merkle.manifest(docs, F.col("lang"), F.col("doc_id"), whole, height=1)).collect()
    assert sorted((r.leaf.hex(), r.subroot.hex(), r.root.hex(), h(r.witness.hex())) for r in found) == brute(rows)
    assert all(r.folded_root == r.root for r in found)
    assert merkle.manifest(docs.limit(0), F.col("lang"), F.col("doc_id"), whole).collect() == []


def test_query_equals_duckdb(spark):
    con = compare.connect("/root/testdata/sf0.001")
    found = queries.QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert compare.difference(found, con, queries.ORACLE_SQL["op11_merkle_manifest"]) == ""
    assert 0 < found.where("not verified").count() < found.count() / 3
