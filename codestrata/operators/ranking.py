"""Ranking of opportunities and ids 1..n per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..sources.stores import materialize
from .rules import with_text

def rank_order():
    return [
        F.col("priority").desc(),
        F.col("impact").desc(),
        F.col("is_duplicate"),
        F.col("primary_path"),
        F.col("rule_ord"),
        F.col("fn_ord"),
    ]


#: What names an opportunity before it has an id.
KEY = ["repo", "is_duplicate", "primary_path", "rule_ord", "fn_ord"]


def rank(scored: DataFrame) -> DataFrame:
    """Add ``id``: position by priority, impact and source order within the repository.

    Only the order columns are sorted, over the whole cluster, so a repository of
    any size is many tasks. Positions are corrected by the sizes of the sort's own
    partitions, and joined back to the opportunities by their key.
    """
    narrow = scored.select(*KEY, "priority", "impact")
    # The sort is written out once: both uses below must see the same partitions.
    placed = materialize(
        narrow.orderBy(F.col("repo"), *rank_order()).withColumn("place", F.monotonically_increasing_id()), "ranks"
    ).withColumn("slice", F.shiftright("place", 33))
    sizes = placed.groupBy("repo", "slice").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    earlier = Window.partitionBy("repo").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "repo", "slice", "first_place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    ids = placed.join(offsets, ["repo", "slice"]).select(
        *KEY, (F.col("before") + F.col("place") - F.col("first_place") + 1).alias("id")
    )
    return scored.join(ids, KEY)


def ranked_opportunities(scored: DataFrame) -> DataFrame:
    return with_text(rank(scored))


def summarize(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """One row per repository: counts by label, riskiest and best first file."""
    label = F.col("priority_label")
    counts = ranked.groupBy("repo").agg(
        F.count_if(label == "High").alias("high_priority_count"),
        F.count_if(label == "Medium").alias("medium_priority_count"),
        F.count_if(label == "Low").alias("low_priority_count"),
        F.min_by("primary_path", F.struct(-F.col("risk"), F.col("id"))).alias("highest_risk_area"),
        F.min_by("primary_path", "id").alias("best_first_refactor"),
    )
    scanned = files.groupBy("repo").agg(
        F.count("*").alias("files_scanned"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("language", F.lit("unknown")))), ", ").alias("languages"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return scanned.join(counts, "repo", "left").select(
        "repo", "files_scanned", zero("high_priority_count"), zero("medium_priority_count"),
        zero("low_priority_count"), "highest_risk_area", "best_first_refactor", "languages",
    )
