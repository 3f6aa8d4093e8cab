"""Merkle manifest of a data set, with witnesses that grow while leaves are appended.

Every tree takes its leaves in order. Appending keeps a row of open subtrees of
falling height. When a subtree completes its sibling, the two become one: the digest
of the right one extends the witness of every leaf on the left, and the other way
round. A node that is last and alone on its level is hashed alone and adds nothing
to a witness. So a leaf's witness is complete as soon as its tree is closed, without
a second walk from the root.

Positions come from one sort over the cluster; 2**height aligned leaves of a tree are
a block and one group. A block yields its root and the partial witnesses of its
leaves. Block roots are appended in turn as leaves of the next stage, until every
tree is one node; the roots of the trees are the leaves of a last tree, appended in
the same way. Witnesses are completed from the top down by joins in which a key has
at most 2**height rows, so a tree that holds all rows is as many tasks as any other.
Texts are hashed where they are read and do not travel. Every stage is a written
table.

H is SHA-256; digests enter it as lower-case hexadecimal text.

Defined results: nulls have their own mark in the leaf and come first in every order;
equal keys of a tree are ordered by their leaves, so rows that are equal as a whole
share neither position nor witness, but it does not matter which gets which; a tree of
one leaf has that leaf as its root; an empty table gives an empty result. Columns that
are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import materialize
from .ship import shipped

SIZE = 32


def digest(*parts: bytes) -> bytes:
    """H of digests, each as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


# --- one block ----------------------------------------------------------------------------


class OpenTrees:
    """Appends up to ``capacity`` leaves; witnesses grow while subtrees complete."""

    def __init__(self, capacity: int):
        height = max(capacity - 1, 0).bit_length()
        self.witness = np.zeros((capacity, height, SIZE), np.uint8)
        self.present = np.zeros((capacity, height), bool)
        self.open: list[tuple[int, int, bytes]] = []  # level, first leaf, digest
        self.count = 0

    def append(self, leaf: bytes) -> None:
        self.open.append((0, self.count, leaf))
        self.count += 1
        self._join()

    def _join(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            level, middle, right = self.open.pop()
            _, first, left = self.open.pop()
            self.witness[first:middle, level] = np.frombuffer(right, np.uint8)
            self.witness[middle : self.count, level] = np.frombuffer(left, np.uint8)
            self.present[first : self.count, level] = True
            self.open.append((level + 1, first, digest(left, right)))

    def close(self, height: int) -> bytes:
        """Root at the given height; a last node without sibling is hashed alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            level, first, alone = self.open.pop()
            self.open.append((level + 1, first, digest(alone)))
            self._join()
        return self.open[0][2]

    def witness_of(self, leaf: int) -> bytes:
        return self.witness[leaf][self.present[leaf]].tobytes()


def fold(leaf: bytes, witness: bytes, places: list[tuple[int, int]]) -> bytes:
    """Root that a leaf and its witness lead to; a place is position and number of leaves in one tree."""
    at = 0
    for position, size in places:
        while size > 1:
            if position % 2 or position + 1 < size:
                sibling, at = witness[at : at + SIZE], at + SIZE
                leaf = digest(sibling, leaf) if position % 2 else digest(leaf, sibling)
            else:
                leaf = digest(leaf)
            position, size = position // 2, (size + 1) // 2
    return leaf


# --- trees as tables ----------------------------------------------------------------------


def leaf_of(*fields: Column) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _appended(table: pa.Table, height: int) -> pa.Table:
    """Partial witness of every node of a block, and the root of the block."""
    table = table.sort_by("position")
    trees = OpenTrees(len(table))
    for node in table["node"].to_pylist():
        trees.append(node)
    size = table["size"][0].as_py()
    root = trees.close(min(height, (size - 1).bit_length()))
    table = table.append_column("witness", pa.array([trees.witness_of(k) for k in range(len(table))], pa.binary()))
    return table.append_column("root", pa.array([root] * len(table), pa.binary()))


def _positions(entries: DataFrame, order: list[str]) -> DataFrame:
    """``entries`` with position in its tree and size of the tree."""
    # The last column only keeps rows that are equal in all others from being one key of the sort.
    rows = entries.withColumn("tie", F.monotonically_increasing_id())
    placed = rows.orderBy("tree", *[F.col(c).asc_nulls_first() for c in order], "tie").drop("tie")
    # Written once: the sizes and the rows must see the same partitions.
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumn("slice", F.shiftright("place", 33))
    sizes = placed.groupBy("tree", "slice").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "tree", "slice", "first_place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(tree).alias("size")
    )
    joined = placed.join(offsets, ["tree", "slice"])
    return joined.withColumn("position", F.col("before") + F.col("place") - F.col("first_place")).drop("slice", "first_place", "before", "place")


def _stages(placed: DataFrame, height: int) -> list[DataFrame]:
    """Nodes with partial witness and block root, stage by stage; the last has one block a tree."""
    stages = []
    while True:
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
        block = F.shiftright("position", height)
        grown = placed.groupBy("tree", block).applyInArrow(lambda t: _appended(t, height), f"{kind}, witness binary, root binary")
        stages.append(materialize(grown, "witnesses"))
        largest = stages[-1].agg(F.max("size")).first()[0] or 0
        if largest <= 1 << height:
            return stages
        roots = stages[-1].where(F.col("position").bitwiseAND((1 << height) - 1) == 0)
        placed = roots.select(
            "tree", block.alias("position"), F.shiftright(F.col("size") + ((1 << height) - 1), height).alias("size"), F.col("root").alias("node")
        )


def _completed(stages: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """First stage with whole witnesses; ``above`` has, for every tree, the witness of its root and further columns."""
    for stage in stages[::-1]:
        up = above.withColumnsRenamed({"witness": "higher", "position": "up", "tree": "of"}).drop("node", "size", "root_here")
        own = stage.withColumnRenamed("root", "root_here")
        joined = own.join(up, (own["tree"] == up["of"]) & (F.shiftright(own["position"], height) == up["up"]))
        above = joined.withColumn("witness", F.concat("witness", "higher")).drop("higher", "of", "up")
    return above.drop("root_here")


@shipped
def manifest(docs: DataFrame, tree: Column, key: Column, leaf: Column, carried: dict[str, Column] | None = None, height: int = 12) -> DataFrame:
    """Every row with its place in the manifest.

    ``leaf, position, size`` (in its tree), ``subroot, tree_position, trees`` (place of
    the tree in the last one), ``root, witness`` (siblings from the leaf to the root) and
    the carried columns. Digests are binary.
    """
    carried = carried or {}
    named = F.coalesce(F.concat(F.lit("+"), tree.cast("string")), F.lit(""))
    entries = docs.select(named.alias("tree"), key.alias("key"), leaf.alias("node"), *[c.alias(f"carried_{k}") for k, c in carried.items()])
    stages = _stages(_positions(entries, ["key", "node"]), height)
    subroots = stages[-1].where("position = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("node"))
    last = _stages(_positions(subroots, ["key"]), height)
    root = last[-1].where("position = 0").select("tree", "position", F.lit(b"").alias("witness"), "root")
    trees = materialize(_completed(last, root, height), "trees")
    above = trees.select(
        F.col("key").alias("tree"), F.lit(0).cast("long").alias("position"), "witness", "root",
        F.col("node").alias("subroot"), F.col("position").alias("tree_position"), F.col("size").alias("trees"),
    )
    return _completed(stages, above, height).select(
        *[F.col(f"carried_{k}").alias(k) for k in carried],
        F.col("node").alias("leaf"), "position", "size", "subroot", "tree_position", "trees", "root", "witness",
    )


@shipped
def folded(rows: DataFrame, leaf_column: str = "leaf") -> DataFrame:
    """``rows`` of a manifest with ``folded_root``: what the given leaf leads to by the row's witness."""

    def run(*columns: pa.Array) -> pa.Array:
        values = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([fold(leaf, witness, [(p, n), (tp, tn)]) for leaf, witness, p, n, tp, tn in values], pa.binary())

    found = F.arrow_udf(run, "binary")(leaf_column, "witness", "position", "size", "tree_position", "trees")
    return rows.withColumn("folded_root", found)


def hexadecimal(value: str) -> Column:
    return F.lower(F.hex(value))


# --- DuckDB text --------------------------------------------------------------------------


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def oracle() -> str:
    """DuckDB text of the manifest of documents, level by level, with tampered rows."""
    head = " || ".join(map(_field, ("doc_id", "source", "lang")))
    own, changed = (f"sha256({head} || {_field(n)} || {_field('text')})" for n in ("n_chars", "n_chars + 1"))
    step = "lambda x, i: xor(x >> 1, (x & 1) * CAST(3988292384 AS UBIGINT))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS UBIGINT[])), {step})"
    letters = "[CAST(ascii(d) AS UBIGINT) FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {letters}), {byte}), CAST(4294967295 AS UBIGINT))"

    def nodes(name: str, first: str) -> str:
        return f"""{name}(t, lv, p, n, h) AS ({first} UNION ALL
  SELECT t, lv + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY t, lv, p // 2, n)"""

    def walk(name: str, tree: str, first: str) -> str:
        return f"""{name}(doc_id, lv, t, p, n, h, proof) AS ({first} UNION ALL
  SELECT w.doc_id, w.lv + 1, w.t, w.p // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.p % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {tree} s ON s.t IS NOT DISTINCT FROM w.t AND s.lv = w.lv AND s.p = xor(w.p, 1) WHERE w.n > 1)"""

    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {own} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {changed} ELSE {own} END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{nodes('inner_nodes', "SELECT lang, 0, p, n, leaf FROM placed")},
subroots AS (
  SELECT t AS lang, h AS subroot, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
{nodes('outer_nodes', "SELECT CAST(NULL AS VARCHAR), 0, p, n, subroot FROM subroots")},
{walk('inner_walk', 'inner_nodes', "SELECT doc_id, 0, lang, p, n, tampered, '' FROM placed")},
{walk('outer_walk', 'outer_nodes', '''SELECT w.doc_id, 0, CAST(NULL AS VARCHAR), s.p, s.n, w.h, w.proof
  FROM inner_walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.t WHERE w.n = 1''')}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM placed JOIN subroots s ON s.lang IS NOT DISTINCT FROM placed.lang JOIN outer_walk w USING (doc_id),
  (SELECT h AS root FROM outer_nodes WHERE n = 1) WHERE w.n = 1"""
