"""Duplicate function bodies across files.

A body may occur in any number of files. Groups are therefore aggregates, never
collected lists: first occurrence, extremes and flags combine map-side, and the
members stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..functions.text import pascal_case
from .analysis import signal

NAMED = ["repo", "body_hash"]


def hashed_functions(files: DataFrame) -> DataFrame:
    """One row per function with a body hash, with the facts of its file.

    The outer form of explode is used for computed arrays: the inner form makes
    the optimizer add a size filter that computes the array a second time.
    """
    fn = F.col("fn")
    keep = F.filter(
        "functions", lambda f: f["body_hash"].isNotNull() & (f["line_count"] >= fixed.MIN_HASHED_LINES)
    )
    return files.select(
        "repo", "path", "language", "workspace", "line_count", "complexity_score", "dependent_count",
        F.size("signals").alias("signal_count"), "has_tests_nearby",
        F.arrays_overlap("responsibilities", F.array(*[F.lit(t) for t in fixed.SENSITIVE_TAGS])).alias("sensitive"),
        F.explode_outer(keep).alias("fn"),
    ).filter(fn.isNotNull()).select(
        "*", fn["body_hash"].alias("body_hash"), fn["fn_ord"].alias("fn_ord"), fn["name"].alias("name"),
        fn["start_line"].alias("start_line"), fn["line_count"].alias("body_lines"),
        fn["blob_request"].alias("blob_request"), fn["blob_type"].alias("blob_type"),
    ).drop("fn")


def duplicate_groups(files: DataFrame, limit: int = fixed.DUPLICATE_GROUPS_PER_REPO) -> DataFrame:
    """Groups of equal bodies in more than one file; the first ``limit`` per repository."""
    functions = hashed_functions(files)
    spot = F.struct("path", "fn_ord")
    folder = F.concat(paths.directory(F.col("path")), F.lit("/"))
    # First pass: one row per body and file. Copies inside one file and copies in
    # many files both shrink on the map side before anything meets per body.
    per_file = functions.groupBy(*NAMED, "path").agg(
        F.min("fn_ord").alias("fn_ord"),
        F.min_by("name", "fn_ord").alias("name"),
        F.count("*").alias("members"),
        F.max("body_lines").alias("max_lines"),
        F.min(F.col("name").startswith(fixed.ANONYMOUS_PREFIX)).alias("anonymous"),
        F.max("blob_request").alias("blob_request"),
        F.max("blob_type").alias("blob_type"),
        *[
            F.first(c).alias(c)
            for c in ("language", "workspace", "line_count", "complexity_score", "dependent_count",
                      "signal_count", "has_tests_nearby", "sensitive")
        ],
    )
    groups = (
        per_file.groupBy(*NAMED)
        .agg(
            F.count("*").alias("file_count"),
            F.sum("members").alias("member_count"),
            F.min(spot).alias("first_spot"),
            F.min_by(F.struct("name", "language", "workspace"), spot).alias("first"),
            F.max("max_lines").alias("max_duplicate_lines"),
            F.min("anonymous").alias("anonymous"),
            (F.max("blob_request") & F.max("blob_type")).alias("blob_reader"),
            F.min(folder).alias("low_folder"),
            F.max(folder).alias("high_folder"),
            F.min("workspace").alias("low_workspace"),
            F.max("workspace").alias("high_workspace"),
            F.count("workspace").alias("with_workspace"),
            F.max("line_count").alias("max_line_count"),
            F.max("complexity_score").alias("max_complexity"),
            F.max("dependent_count").alias("max_dependents"),
            F.max("signal_count").alias("max_signals"),
            F.min("has_tests_nearby").alias("all_tested"),
            F.max("sensitive").alias("sensitive"),
        )
        .filter(F.col("file_count") > 1)
    )
    # Keeping the first ten is a per-task limit before it is a per-repository one.
    by_first = Window.partitionBy("repo").orderBy("first_spot")
    ranked = groups.withColumn("group_ord", F.row_number().over(by_first)).filter(F.col("group_ord") <= limit)
    return _named(ranked)


def _named(groups: DataFrame) -> DataFrame:
    blob = F.col("blob_reader")
    display = F.when(blob, F.lit(fixed.BLOB_READER_LABEL)).otherwise(F.col("first.name"))
    helper = F.when(blob, F.lit(fixed.BLOB_READER_HELPER)).otherwise(
        F.concat(F.lit("extract"), pascal_case(F.col("first.name")), F.lit("Helper"))
    )
    workspace = F.when(
        (F.col("with_workspace") == F.col("file_count"))
        & (F.col("low_workspace") == F.col("high_workspace")),
        F.col("low_workspace"),
    )
    common = paths.folder_prefix_of(F.col("low_folder"), F.col("high_folder"))
    return (
        groups.withColumn("display_name", display)
        .withColumn("helper_name", helper)
        .withColumn(
            "helper_path",
            paths.grouped_helper_path(F.col("first.language"), workspace, common, F.col("helper_name")),
        )
        .withColumn("language", F.col("first.language"))
        .withColumn("dropped", F.col("anonymous") & ~blob)
    )


def duplicate_members(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Member rows of the kept groups, each with its signal."""
    kept = groups.select(*NAMED, "group_ord", "display_name", "helper_name", "helper_path")
    return (
        hashed_functions(files)
        .select(*NAMED, "path", "fn_ord", "name", "start_line", "body_lines")
        .join(kept, NAMED)
        .select("repo", "group_ord", "path", "fn_ord", duplicate_signal().alias("signal"))
    )


def duplicate_signal() -> Column:
    return signal(
        "duplicate-function-body",
        F.concat(
            F.col("name"), F.lit(" appears to duplicate "), F.col("display_name"),
            F.lit(" logic found in another file."),
        ),
        "medium",
        F.col("start_line"),
        functionName=F.col("name"),
        duplicateLineCount=F.col("body_lines"),
        helperName=F.col("helper_name"),
        suggestedHelperPath=F.col("helper_path"),
    )


