"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only in local mode, as in tests, one is made and set where that is unset; on a
    cluster a folder of the driver's would be lost on the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write as Parquet and read again: stable rows, and nothing to recompute if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """The same with a folder for each value of ``column``; Spark evens out values with very many rows."""
    path = scratch_path(df.sparkSession, name)
    df.hint("rebalance", column).sortWithinPartitions(column).write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(df: DataFrame) -> set[str]:
    """The scratch folders that ``df`` reads."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    inside = f"{root.rstrip('/').removeprefix('file:').lstrip('/')}/" if root else None
    # the folder right below the root; a table written by a column has more below it
    return {f[: f.index("/", f.index(inside) + len(inside))] for f in df.inputFiles() if inside and inside in f}


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def dropped(df: DataFrame, *kept: DataFrame) -> None:
    """Delete the scratch folders that ``df`` reads and ``kept`` do not."""
    for path in folders(df).difference(*map(folders, kept)):
        system, place = _file_system(df.sparkSession, path)
        system.delete(place, True)


def size_of(df: DataFrame) -> int:
    """Bytes of the scratch folders that ``df`` reads."""
    total = 0
    for path in folders(df):
        system, place = _file_system(df.sparkSession, path)
        if system.exists(place):
            total += system.getContentSummary(place).getLength()
    return total
