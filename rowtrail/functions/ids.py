"""Row ids.

An id is a struct that is never null itself. Structs compare field by field and
count null fields as equal, so ids and group keys with nulls join by plain
equality, which Spark hashes and sorts like any other key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "__id"


def key_struct(columns: Sequence[Column]) -> Column:
    """One key of several columns; without columns, one key for all rows."""
    named = [c.alias(f"k{i}") for i, c in enumerate(columns)]
    return F.struct(*(named or [F.lit(1).alias("all")]))


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ID]


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select(ID).distinct()


def keeping(rows: DataFrame, on: Column, ids: DataFrame) -> DataFrame:
    """The rows whose ``on`` is among the ids."""
    wanted = ids.select(F.col(ID).alias("__wanted"))
    return rows.join(wanted, on == F.col("__wanted"), "left_semi")
