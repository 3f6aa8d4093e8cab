import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("codestrata-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def listing(spark):
    """Build a listing from ``{path: content}`` or ``{repo: {path: content}}``."""

    def build(files: dict):
        rows = []
        for key, value in files.items():
            if isinstance(value, dict):
                rows += [(key, path, content) for path, content in value.items()]
            else:
                rows.append(("repo", key, value))
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return build
