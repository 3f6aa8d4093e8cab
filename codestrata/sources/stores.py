"""Stored tables: lineage cuts, the scan store, briefs, settings and the run log."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..params import OutputSettings

RUN_LOG_TYPE = (
    "repo string, run_id string, opportunity_key string, status string, created_at timestamp, "
    "updated_at timestamp, last_verdict string, completion_summary string"
)


COMMIT_TYPE = "batch string, committed_at long"


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """Folder for intermediate tables that all executors see.

    In this order: the given one, ``spark.checkpoint.dir``, a subfolder of the
    session's warehouse. Nothing is written back to the session.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate").rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cached plan it survives lost executors, and unlike a checkpoint it
    is columnar, so later reads touch only the columns they need.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


# --- scan store -----------------------------------------------------------------------


def write_scan(table: DataFrame, store: str, name: str, scan_id: str) -> None:
    """Write one complete table of a scan, clustered by repository and row, so that a large one is many tasks.

    The folder of a scan is replaced as a whole; other scans stay.
    """
    order = ["repo", *[c for c in ("path", "id") if c in table.columns][:1]]
    clustered = table.repartitionByRange(*order).sortWithinPartitions(*order)
    clustered.write.mode("overwrite").parquet(f"{store}/{name}/scan_id={scan_id}")


def read_scan(spark: SparkSession, store: str, name: str, scan_id: str | None = None) -> DataFrame:
    """One scan of a stored table, the latest by default."""
    table = spark.read.parquet(f"{store}/{name}").withColumn("scan_id", F.col("scan_id").cast("string"))
    if scan_id is None:
        latest = table.agg(F.max("scan_id").alias("scan_id")).first()["scan_id"]
        if latest is None:
            raise ValueError(f"no scan found in {store}/{name}")
        scan_id = latest
    return table.filter(F.col("scan_id") == scan_id).drop("scan_id")


# --- batches ------------------------------------------------------------------------------


def append_batch(tables: dict[str, DataFrame], store: str) -> str:
    """Append rows to several tables that count together or not at all.

    The rows carry the id of their batch, which counts once its record is there: one
    row in one file, written last. What a broken attempt left is never read, so the
    attempt can simply be made again.
    """
    batch = uuid.uuid4().hex
    for name, table in tables.items():
        table.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{store}/{name}")
    commit(next(iter(tables.values())).sparkSession, store, batch)
    return batch


def commit(spark: SparkSession, store: str, batch: str) -> None:
    record = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(time.time_ns()).alias("committed_at"))
    record.coalesce(1).write.mode("append").parquet(f"{store}/commits")


def committed(rows: DataFrame, store: str) -> DataFrame:
    """Rows of committed batches, with ``committed_at``."""
    return rows.join(rows.sparkSession.read.schema(COMMIT_TYPE).parquet(f"{store}/commits"), "batch")


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Committed rows of a table that is written in batches."""
    return committed(spark.read.parquet(f"{store}/{name}"), store).drop("batch", "committed_at")


# --- briefs -------------------------------------------------------------------------------


def write_brief_lines(lines: DataFrame, store: str, scan_id: str, replace: bool = True) -> None:
    """Write briefs of a scan; lines of one brief stay together and in order.

    All briefs of the scan are replaced, or (``replace`` false) a new version of the
    given ones is added beside the others.
    """
    order, batch = ["repo", "id", "section", "item"], uuid.uuid4().hex
    clustered = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("batch", F.lit(batch))
    clustered.write.mode("overwrite" if replace else "append").parquet(f"{store}/briefs/scan_id={scan_id}")
    commit(lines.sparkSession, store, batch)


def read_briefs(spark: SparkSession, store: str, scan_id: str | None = None) -> DataFrame:
    """Lines of the newest version of every brief of a scan, the latest by default."""
    rows = committed(read_scan(spark, store, "briefs", scan_id), store)
    newest = rows.groupBy("repo", "id").agg(F.max_by("batch", F.struct("committed_at", "batch")).alias("batch"))
    return rows.join(newest, ["repo", "id", "batch"], "left_semi").drop("batch", "committed_at")


# --- output settings --------------------------------------------------------------------


def settings_table(repos: DataFrame, settings: OutputSettings) -> DataFrame:
    return repos.select("repo").distinct().select(
        "repo", F.lit(settings.limit).cast("double").alias("limit"), F.lit(settings.min_priority).alias("min_priority")
    )


def write_settings(table: DataFrame, store: str, scan_id: str) -> None:
    """Settings of one scan, a row for each repository."""
    write_scan(table, store, "settings", scan_id)


def effective_settings(repos: DataFrame, stored: DataFrame, fallback: OutputSettings) -> DataFrame:
    """Stored settings where they are valid, else the current ones, field by field."""
    limit, priority = F.col("limit"), F.col("min_priority")
    valid_limit = (limit >= 0) & (limit == F.floor(limit))
    return repos.select("repo").distinct().join(stored, "repo", "left").select(
        "repo",
        F.when(valid_limit, limit.cast("long")).otherwise(F.lit(fallback.limit).cast("long")).alias("limit"),
        F.when(priority.isin("high", "medium", "low"), priority)
        .otherwise(F.lit(fallback.min_priority))
        .alias("min_priority"),
    )


# --- run log ------------------------------------------------------------------------------


def append_runs(versions: DataFrame, store: str) -> None:
    """Append new versions of run rows; earlier versions are never changed."""
    append_batch({"runs": versions}, store)


def store_check(comparisons: DataFrame, verdict: DataFrame, checked: DataFrame, store: str) -> None:
    """Append the rows of a check and the new version of the run, which count together."""
    append_batch({"comparisons": comparisons, "checks": verdict, "runs": checked}, store)


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.schema(f"{RUN_LOG_TYPE}, batch string").parquet(f"{store}/runs")
    return committed(rows, store).drop("batch", "committed_at")


def current_runs(versions: DataFrame) -> DataFrame:
    """Newest version of every run."""
    newest = F.struct("updated_at", status_order(F.col("status")))
    rest = [c for c in versions.columns if c not in ("repo", "run_id")]
    return (
        versions.groupBy("repo", "run_id")
        .agg(F.max_by(F.struct(*rest), newest).alias("row"))
        .select("repo", "run_id", "row.*")
    )


def latest_run(versions: DataFrame) -> DataFrame:
    """``repo, run_id`` of the run touched last; creation time breaks ties."""
    return versions.groupBy("repo").agg(
        F.max_by("run_id", F.struct("updated_at", "created_at", "run_id")).alias("run_id")
    )


def status_order(status: Column) -> Column:
    return F.when(status == "started", 1).when(status == "checked", 2).when(status == "completed", 3)


def completion_row(runs: DataFrame, summary: Column | None = None) -> DataFrame:
    """Completed version of each given run, with a summary from its last verdict."""
    from_verdict = F.replace(F.lit(fixed.SUMMARY_CHECKED), F.lit("{verdict}"), F.col("last_verdict"))
    text = F.coalesce(from_verdict, F.lit(fixed.SUMMARY_UNCHECKED))
    return runs.select(
        "repo", "run_id", "opportunity_key", F.lit("completed").alias("status"), "created_at",
        F.current_timestamp().alias("updated_at"), "last_verdict",
        (text if summary is None else F.coalesce(summary, text)).alias("completion_summary"),
    )
