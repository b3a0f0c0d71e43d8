"""Lines of text files with places that do not depend on how the files are split.

A line is known by its file and its number in it. Spark numbers the lines of a split as
they come; where a split begins is the number of lines in the splits before it, which
one more scan of the same plan counts, with one row for each split. So nothing is written, and
other split sizes or executors give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import ID

#: A partition's rows have numbers of so many bits.
ROW_BITS = 33
#: CSV options that only the reader itself can follow.
READER_OPTIONS = {"multiline", "encoding", "charset", "linesep", "pathglobfilter", "recursivefilelookup", "modifiedbefore", "modifiedafter"}


def file_number() -> Column:
    """A file is known by a 64-bit hash of its path."""
    return F.xxhash64("_metadata.file_path")


def lines(spark: SparkSession, path: str, files: Sequence[int] | None = None) -> DataFrame:
    """(value, __id): each line with its file and its number in the file, from 0; only of some ``files``, if told."""
    read = spark.read.text(path)
    if files is not None:
        read = read.where(file_number().isin(list(files)))
    at = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1).alias("__at")
    rows = read.select("value", file_number().alias("file"), F.col("_metadata.file_block_start").alias("start"), at)
    splits = rows.groupBy("file", "start").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # one row for each split, as many as the scan has tasks or fewer than a few times that
    placed = rows.join(F.broadcast(splits), ["file", "start"])
    return placed.select("value", F.struct("file", (F.col("__at") + F.col("shift")).alias("row")).alias(ID))


def blank(value: Column) -> Column:
    return ~value.rlike(r"[^\x00-\x20]")


def parsed(rows: DataFrame, made: Column, schema: StructType) -> DataFrame:
    """The fields of the parsed struct beside the ids."""
    return rows.select(made.alias("__made"), ID).select(*(F.col("__made")[f.name].alias(f.name) for f in schema.fields), ID)


def in_place(options: dict) -> bool:
    """Whether lines can be parsed one by one, as the reader would."""
    given = {k.lower(): str(v).lower() for k, v in options.items()}
    return given.get("mode") != "dropmalformed" and not any(given.get(o, "false") != "false" for o in READER_OPTIONS)


def csv(spark: SparkSession, path: str, schema: StructType, options: dict, files: Sequence[int] | None = None) -> DataFrame:
    """The rows of CSV files, one a line; a header is each file's first line."""
    given = {k.lower(): v for k, v in options.items()}
    rows = lines(spark, path, files).where(~blank(F.col("value")))
    if str(given.pop("header", "false")).lower() == "true":
        rows = rows.where(F.col(f"{ID}.row") > 0)
    if given.get("comment"):
        rows = rows.where(~F.startswith("value", F.lit(given["comment"])))
    given.pop("inferschema", None)
    kept = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in given.items()}
    return parsed(rows, F.from_csv("value", ddl(schema), kept), schema)


def json(spark: SparkSession, path: str, schema: StructType, files: Sequence[int] | None = None) -> DataFrame:
    """The objects of JSON files, one a line; a line that holds an array is an error, as it would be several rows."""
    rows = lines(spark, path, files).where(~blank(F.col("value")))
    several = F.startswith(F.ltrim("value"), F.lit("["))
    value = F.when(several, F.raise_error(F.lit("a line holds an array: read such files with frame()")).cast("string")).otherwise(F.col("value"))
    return parsed(rows, F.from_json(value, schema), schema)


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
