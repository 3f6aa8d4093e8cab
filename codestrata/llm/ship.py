"""Makes this package importable in Python workers of any machine."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    What the driver can import says nothing of other machines, so it is always sent.
    The archive is made on the driver, handed out by Spark itself and removed when the
    driver ends.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="codestrata-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "codestrata.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(application)


def shipped[**P, R](operator: Callable[P, R]) -> Callable[P, R]:
    """An operator whose first argument is a table, and whose workers need the package."""

    @wraps(operator)
    def run(table: DataFrame, *arguments, **named):
        ship(table.sparkSession)
        return operator(table, *arguments, **named)

    return run
