"""Tracked runs: begin, check, verdict, next task.

Version control and check commands are run elsewhere; their results come in as
tables (``changed_files``, ``command_results``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..params import Params
from ..sources.stores import materialize


def changed_path(status_line: Column) -> Column:
    """Path of one line of a short status listing: no status, rename target, no quotes."""
    name = F.element_at(F.split(status_line.substr(F.lit(4), F.length(status_line)), " -> "), -1)
    return F.replace(F.regexp_replace(name, '^"|"$', ""), F.lit("\\"), F.lit("/"))


def without_tool_state(changed: DataFrame, params: Params = Params()) -> DataFrame:
    state = params.state_directory
    return changed.filter((F.col("path") != state) & ~F.col("path").startswith(state + "/"))


def opportunity_keys(ranked: DataFrame, files_of: DataFrame) -> DataFrame:
    """``repo, id, opportunity_key`` of every opportunity.

    The key holds type, title, and count and hash sums of the files: equal for equal
    sets of files, in any order, and short for any number of them.
    """
    sums = [F.sum(F.xxhash64(F.lit(seed), F.col("path")).cast("decimal(38,0)")).cast("string").alias(f"h{seed}") for seed in (1, 2)]
    files = files_of.groupBy("repo", "id").agg(F.count("*").cast("string").alias("n"), *sums)
    key = F.concat_ws(":", "type", "title", "n", "h1", "h2")
    return ranked.select("repo", "id", "type", "title").join(files, ["repo", "id"]).select("repo", "id", key.alias("opportunity_key"))


def next_unstarted(ranked: DataFrame, keys: DataFrame, runs: DataFrame) -> DataFrame:
    """Best opportunity of each repository for which no run exists."""
    started = runs.select("repo", "opportunity_key").distinct()
    taken = keys.join(started, ["repo", "opportunity_key"], "left_semi").select("repo", "id")
    open_ = ranked.join(taken, ["repo", "id"], "left_anti")
    return open_.groupBy("repo").agg(
        F.min_by(F.struct("id", "type", "title", "primary_path", "priority"), "id").alias("best")
    ).select("repo", "best.*")


def guard(ranked: DataFrame, changed: DataFrame, params: Params = Params(), files_of: DataFrame | None = None) -> DataFrame:
    """``repo, id, error``: why an opportunity cannot be started, null if it can.

    With ``files_of`` the paths of all its files are guarded, else that of the first.
    """
    dirty = changed.select("repo").distinct().withColumn("dirty", F.lit(True))
    too_many = F.concat(
        F.lit("Opportunity "), F.col("id").cast("string"), F.lit(" touches "), F.col("file_count").cast("string"),
        F.lit(f" files, which exceeds the limit of {params.max_files_per_task}."),
    )
    unclean = F.lit("Repository has uncommitted changes.")
    error = F.when(F.col("file_count") > params.max_files_per_task, too_many)
    if not params.allow_dirty:
        error = error.when(F.col("dirty"), unclean)
    outside = ~paths.stays_inside(F.col("primary_path"))
    tasks = ranked.join(dirty, "repo", "left")
    if files_of is not None:
        escaping = files_of.filter(~paths.stays_inside(F.col("path"))).select("repo", "id", F.lit(True).alias("escapes")).distinct()
        tasks, outside = tasks.join(escaping, ["repo", "id"], "left"), outside | F.coalesce("escapes", F.lit(False))
    return tasks.select("repo", "id", error.when(outside, F.lit("Path escapes repository root.")).alias("error"))


def snapshot(files_of: DataFrame, files: DataFrame, started: DataFrame) -> DataFrame:
    """``repo, run_id, path, hash, line_count, complexity_score, signal_count`` of started runs."""
    facts = files.select(
        "repo", "path", F.col("content_hash").alias("hash"), "line_count", "complexity_score",
        F.size("signals").alias("signal_count"),
    )
    return (
        started.select("repo", "run_id", "id")
        .join(files_of, ["repo", "id"])
        .join(facts, ["repo", "path"])
        .select("repo", "run_id", "path", "hash", "line_count", "complexity_score", "signal_count")
    )


def possible_targets(targets: DataFrame, listing: DataFrame, bits: int = 26) -> DataFrame:
    """Rows of ``listing`` that may be targets, decided where they are read.

    The targets set one bit each in a bitmap of ``2**bits`` bits (8 MB, whatever their
    number), whose pieces are broadcast; a row without its bit is no target.
    """
    place = F.pmod(F.xxhash64("repo", "path"), F.lit(1 << bits)) + 1
    pieces = targets.select(F.bitmap_bucket_number(place).alias("piece"), F.bitmap_bit_position(place).alias("bit"))
    pieces = pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = listing.withColumn("piece", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "piece")
    return met.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(listing.columns)


def snapshot_contents(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """Text of the target files of started runs; other contents stay where they are."""
    wanted = targets.select("repo", "path").distinct()
    # An inner join on distinct keys: the optimizer would move a semi join below the one with the bitmap.
    return possible_targets(wanted, listing).join(wanted, ["repo", "path"]).select(listing.columns)


def begin(ranked: DataFrame, files_of: DataFrame, files: DataFrame, chosen: DataFrame, changed: DataFrame,
          params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start runs for ``chosen(repo, id, run_id)``: run rows, target rows and rejected rows."""
    errors = guard(ranked, changed, params, files_of).filter(F.col("error").isNotNull())
    accepted = chosen.join(errors, ["repo", "id"], "left_anti")
    rejected = chosen.join(errors, ["repo", "id"])
    keys = opportunity_keys(ranked, files_of)
    runs = accepted.join(keys, ["repo", "id"]).select(*started_row(F.col("run_id")))
    return runs, snapshot(files_of, files, accepted), rejected


def materially_worse(lines_before: Column, line_delta: Column, complexity_delta: Column) -> Column:
    allowed = F.greatest(F.lit(20), F.ceil(lines_before * 0.1).cast("int"))
    return (line_delta > allowed) | (complexity_delta > 2)


def compare(targets: DataFrame, current: DataFrame, current_listing: DataFrame) -> DataFrame:
    """Target files then and now.

    A file that still exists but is no longer scanned keeps its old score and
    signal count; a removed file has no deltas.
    """
    now = current_listing.select(
        "repo", "path", F.sha2("content", 256).alias("hash_after"), F.lit(True).alias("present"),
        line_count_of_text().alias("plain_lines"),
    )
    scanned = current.select(
        "repo", "path", F.col("line_count").alias("scanned_lines"), F.col("complexity_score").alias("scanned_score"),
        F.size("signals").alias("scanned_signals"),
    )
    exists = F.coalesce(F.col("present"), F.lit(False))
    after = lambda found, other: F.when(exists, F.coalesce(F.col(found), F.col(other)))
    joined = targets.join(now, ["repo", "path"], "left").join(scanned, ["repo", "path"], "left").select(
        "repo", "run_id", "path", exists.alias("exists_now"),
        (~exists | (F.col("hash_after") != F.col("hash"))).alias("changed"),
        F.col("line_count").alias("line_count_before"),
        after("scanned_lines", "plain_lines").alias("line_count_after"),
        F.col("complexity_score").alias("complexity_before"),
        after("scanned_score", "complexity_score").alias("complexity_after"),
        F.col("signal_count").alias("signal_count_before"),
        after("scanned_signals", "signal_count").alias("signal_count_after"),
    )
    deltas = joined.select(
        "*",
        (F.col("line_count_after") - F.col("line_count_before")).alias("line_delta"),
        (F.col("complexity_after") - F.col("complexity_before")).alias("complexity_delta"),
        (F.col("signal_count_after") - F.col("signal_count_before")).alias("signal_delta"),
    )
    worse = materially_worse(F.col("line_count_before"), F.col("line_delta"), F.col("complexity_delta"))
    return deltas.withColumn("materially_worse", F.coalesce(worse, F.lit(False)))


def line_count_of_text() -> Column:
    from ..functions.text import line_count

    return line_count(F.col("content"))


def scope(changed: DataFrame, targets: DataFrame, comparisons: DataFrame, versioned: DataFrame,
          params: Params = Params()) -> DataFrame:
    """``repo, run_id, path, inside``: changed files inside and outside the scope of each run.

    Repositories outside version control (not in ``versioned``) report their
    changed targets and nothing outside.
    """
    wanted = targets.select("repo", "run_id", "path").withColumn("inside", F.lit(True))
    tracked = without_tool_state(changed, params).join(versioned.select("repo").distinct(), "repo", "left_semi")
    seen = tracked.join(wanted, ["repo", "run_id", "path"], "left").select(
        "repo", "run_id", "path", F.coalesce("inside", F.lit(False)).alias("inside")
    )
    own = (
        comparisons.filter("changed")
        .join(versioned.select("repo").distinct(), "repo", "left_anti")
        .select("repo", "run_id", "path", F.lit(True).alias("inside"))
    )
    return seen.unionByName(own)


def failures(comparisons: DataFrame, command_results: DataFrame) -> DataFrame:
    """``repo, run_id, message``: removed targets and failed commands."""
    removed = comparisons.filter(~F.col("exists_now")).select(
        "repo", "run_id", F.concat(F.lit(fixed.FAIL_REMOVED), "path").alias("message")
    )
    code = F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown"))
    failed = command_results.filter(F.coalesce(F.col("exit_code") != 0, F.lit(True))).select(
        "repo", "run_id",
        F.concat(F.lit("Command failed: "), "command", F.lit(" (exit "), code, F.lit(")")).alias("message"),
    )
    return removed.unionByName(failed)


def warnings(runs: DataFrame, comparisons: DataFrame, in_scope: DataFrame, command_results: DataFrame,
             versioned: DataFrame) -> DataFrame:
    """``repo, run_id, message``. All files outside the scope of a run give one message."""
    ids = runs.select("repo", "run_id")
    untracked = ids.join(versioned.select("repo").distinct(), "repo", "left_anti")
    silent = ids.join(command_results.select("repo", "run_id").distinct(), ["repo", "run_id"], "left_anti")
    note = lambda df, message: df.select("repo", "run_id", message.alias("message"))
    outside = in_scope.filter(~F.col("inside")).groupBy("repo", "run_id").agg(F.min("path").alias("first"), F.count("*").alias("n"))
    more = F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))
    return (
        note(untracked, F.lit(fixed.WARN_NO_VCS))
        .unionByName(note(silent, F.lit(fixed.WARN_NO_COMMANDS)))
        .unionByName(note(outside, F.concat(F.lit(fixed.WARN_OUTSIDE), "first", F.when(F.col("n") > 1, more).otherwise(""))))
        .unionByName(
            note(comparisons.filter("materially_worse"), F.concat(F.lit(fixed.WARN_WORSE), F.col("path")))
        )
    )


def verdicts(runs: DataFrame, failed: DataFrame, warned: DataFrame) -> DataFrame:
    """``repo, run_id, recommendation, failure_count, warning_count``."""
    count = lambda df, name: df.groupBy("repo", "run_id").agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        runs.select("repo", "run_id")
        .join(count(failed, "failure_count"), ["repo", "run_id"], "left")
        .join(count(warned, "warning_count"), ["repo", "run_id"], "left")
        .select("repo", "run_id", zero("failure_count"), zero("warning_count"))
        .withColumn(
            "recommendation",
            F.when(F.col("failure_count") > 0, "fail").when(F.col("warning_count") > 0, "warn").otherwise("pass"),
        )
    )


def check(open_runs: DataFrame, targets: DataFrame, current: DataFrame, current_listing: DataFrame, changed: DataFrame,
          command_results: DataFrame, versioned: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Comparisons and verdicts of open runs after a rescan.

    ``changed`` and ``command_results`` come from version control and from the check
    commands, by repository; paths of the tool's own state are left out. Comparisons are
    stored first: three kinds of messages read them, and each time the files would be measured.
    """
    ids = open_runs.select("repo", "run_id").distinct()
    own = targets.join(ids, ["repo", "run_id"], "left_semi")
    comparisons = materialize(compare(own, current, current_listing), "comparisons")
    in_scope = scope(changed.join(ids, "repo"), own, comparisons, versioned, params)
    commands = command_results.join(ids, "repo")
    failed = failures(comparisons, commands)
    return comparisons, verdicts(ids, failed, warnings(ids, comparisons, in_scope, commands, versioned))


def checked_version(runs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Version ``checked`` of runs, with their verdict."""
    return runs.drop("last_verdict").join(verdict, ["repo", "run_id"]).select(
        "repo", "run_id", "opportunity_key", F.lit("checked").alias("status"), "created_at",
        F.current_timestamp().alias("updated_at"), F.col("recommendation").alias("last_verdict"), "completion_summary",
    )


def started_row(run_id: Column) -> list[Column]:
    """Columns of a run that starts now, for rows with repo and opportunity_key."""
    none = F.lit(None).cast("string")
    return [
        F.col("repo"), run_id.alias("run_id"), F.col("opportunity_key"), F.lit("started").alias("status"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
        none.alias("last_verdict"), none.alias("completion_summary"),
    ]
