from pyspark.sql import functions as F

from codestrata.operators import runs


def test_a_check_measures_the_later_state_once(spark, tmp_path):
    """Verdicts read the stored comparisons; they would measure all files again for each kind of message."""
    place = str(tmp_path / "current")
    rows = [("r", "a.py", 60, 9, ["s"]), ("r", "b.py", 5, 1, []), (None, "c.py", 1, 1, [])]
    spark.createDataFrame(rows, "repo string, path string, line_count int, complexity_score int, signals array<string>").write.parquet(place)
    current = spark.read.parquet(place)
    listing = spark.createDataFrame([("r", "a.py", "x\n" * 59), ("r", "b.py", "y")], "repo string, path string, content string")
    started = spark.createDataFrame([("r", "r-1")], "repo string, run_id string")
    targets = spark.createDataFrame(
        [("r", "r-1", "a.py", "old", 10, 2, 0), ("r", "r-1", "gone.py", "old", 10, 2, 0)],
        "repo string, run_id string, path string, hash string, line_count int, complexity_score int, signal_count int",
    )
    changed = targets.select("repo", "path")
    commands = spark.createDataFrame([("r", "make", 0)], "repo string, command string, exit_code int")
    comparisons, verdict = runs.check(started, targets, current, listing, changed, commands, started.select("repo"))
    for result in (comparisons, verdict):
        assert not any(place in f for f in result.inputFiles())
    assert {(c.path, c.exists_now, c.materially_worse) for c in comparisons.collect()} == {("a.py", True, True), ("gone.py", False, False)}
    assert [tuple(v) for v in verdict.select("failure_count", "warning_count", F.col("recommendation")).collect()] == [(1, 1, "fail")]
