"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import materialize


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """``x, y, m``: every pair with the smallest of x and its partners."""
    smallest = pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return pairs.join(smallest, "x")


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns a, b).

    ``component`` is the smallest node reached. Large and small stars alternate
    until the table stays as it is; their number grows with the logarithm of the
    longest chain. Minima are taken before the shuffle, so a node with very many
    links is no hot key there, and the joins back are plain equality joins whose
    large partitions are split. Every round is a written table.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = materialize(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
            edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
        )
        large = _to_smallest(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        small = _to_smallest(large)
        stars = small.select(F.col("y").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("x").alias("a"), F.col("m").alias("b"))
        )
        edges = materialize(stars.where("a <> b").distinct(), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
