"""Small helpers that the operators share: scratch tables and input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import scratch
from ..sources.scratch import dropped, scratch_path  # noqa: F401

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder, tightly packed, and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    return scratch.written(df, name, compression="zstd")


def extended(schema: StructType, ddl: str) -> StructType:
    """A new schema with more columns."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, as UTF-8.

    ``bytes.split`` cuts at exactly the six white-space bytes 09-0D and 20, and
    ``bytes.lower`` changes A-Z alone.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
