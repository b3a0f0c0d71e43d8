"""The entry point: sources with row ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import ID
from .operators.traced import Traced
from .plans.levels import Source
from .sources import lines
from .sources.scratch import dropped, size_of, written


@dataclass(frozen=True)
class RowTrail:
    """Reads tables so that their rows can be traced.

    ``granularity``: "exact" takes single rows through joins and top-k; "key" takes
    all rows that share the key, as provenance by shuffle key does.
    """

    spark: SparkSession
    granularity: str = "exact"
    held: list[DataFrame] = field(default_factory=list, compare=False)  #: the copies of sources that this session made

    def size(self) -> int:
        """Bytes that the copies of sources, and what top-k and limits wrote, take on disk."""
        return sum(size_of(df) for df in self.held)

    def release(self) -> None:
        """Delete them all; traces that need them end here."""
        for df in self.held:
            dropped(df)
        self.held.clear()

    def _source(self, name: str, rows: DataFrame, cut: Callable[[list[int]], DataFrame] | None = None) -> Traced:
        return Traced(rows, Source((), name, rows=rows, cut=cut), self.granularity, self.held, intact=True)

    def parquet(self, path: str, name: str | None = None) -> Traced:
        """A Parquet table; a row's id is its file and its place in it, so nothing is copied.

        The file is known by a 64-bit hash of its path, which keeps shuffled ids short.
        """
        place = F.struct(lines.file_number().alias("file"), F.col("_metadata.row_index").alias("row")).alias(ID)
        read = self.spark.read.parquet(path)
        return self._source(name or path, read.select("*", place), lambda files: read.where(lines.file_number().isin(files)).select("*", place))

    def frame(self, df: DataFrame, name: str = "frame") -> Traced:
        """Any DataFrame, cached or not. Its rows are written once with numbers, as other formats have no stable places."""
        copy = written(df.withColumn(ID, F.struct(F.monotonically_increasing_id().alias("row"))), "source")
        self.held.append(copy)
        return self._source(name, copy)

    def keyed(self, df: DataFrame, *key: str, name: str = "frame") -> Traced:
        """A DataFrame with a unique key, which serves as the id; nothing is copied."""
        return self._source(name, df.withColumn(ID, F.struct(*key)))

    def text(self, path: str) -> Traced:
        """Lines of text, known by their file and number; nothing is copied."""
        return self._source(path, lines.lines(self.spark, path), lambda files: lines.lines(self.spark, path, files))

    def csv(self, path: str, schema: str | None = None, **options) -> Traced:
        """CSV with one row a line, known by its file and the line's number; nothing is copied.

        Rows that may span lines, other encodings and dropped malformed rows are left
        to Spark's reader, whose rows are written once with numbers.
        """
        read = self.spark.read.options(**options).csv(path, schema=schema)
        if not lines.in_place(options):
            return self.frame(read, path)
        made = lambda files=None: lines.csv(self.spark, path, read.schema, options, files)
        return self._source(path, made(), made)

    def json(self, path: str, schema: str | None = None) -> Traced:
        """JSON with one object a line, known by its file and the line's number; nothing is copied."""
        known = self.spark.read.json(path, schema=schema).schema
        made = lambda files=None: lines.json(self.spark, path, known, files)
        return self._source(path, made(), made)

    def orc(self, path: str) -> Traced:
        return self.frame(self.spark.read.orc(path), path)

    def values(self, rows: list, schema: str) -> Traced:
        return self.frame(self.spark.createDataFrame(rows, schema), "values")
