"""Sends the package to workers that do not have it."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = __name__.partition(".")[0]
#: Applications that have been looked at.
_seen: set[str] = set()


def found_by_workers(spark: SparkSession) -> bool:
    name = PACKAGE  # a plain value, so that the function itself does not need the package
    look = importlib.util.find_spec
    return spark.sparkContext.parallelize([0], 1).map(lambda _: look(name) is not None).first()


def ship(spark: SparkSession) -> None:
    """Once for an application: if Python workers cannot import the package, send it as a zip file through Spark."""
    application = spark.sparkContext.applicationId
    if application in _seen:
        return
    if not found_by_workers(spark):
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{PACKAGE}.zip"  # the driver's own file, served to the executors
        with zipfile.ZipFile(path, "w") as zipped:
            for file in sorted(root.rglob("*.py")):
                zipped.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
    _seen.add(application)
