"""Provenance across micro-batches: running aggregates traced to the rows of all batches.

A folder holds two append-only logs. ``rows/batch=N`` has a batch's rows with their ids,
sorted by group; ``groups/batch=N`` has one row for each group that the batch touched,
with the batch's own aggregates. A running result is the merge of the second log, so
nothing is kept in memory, no state is rewritten, and the result as it was after any
batch can be asked for and traced. Both logs outlive the query and the session.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import ID
from ..operators.traced import Traced
from ..plans.levels import TraceError, quiet, UnsupportedOperatorError
from ..session import RowTrail

#: How a batch's aggregates are merged: the aggregate of a batch, and of those.
MERGED = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
BATCH, ROW, FIRST = "__batch", "__row", "__first"


@dataclass(frozen=True)
class History:
    """The logs below ``folder``, which all executors share, of a query grouped by ``keys``.

    ``aggregates`` gives for each name the function ("count", "sum", "min", "max") and the
    column, or "*" for all rows. Null keys form a group. A group without a value has null,
    or 0 for a count. Columns of the stream may not be called ``__batch`` or ``__row``.
    """

    trail: RowTrail
    folder: str
    keys: Sequence[str]
    aggregates: Mapping[str, tuple[str, str]]

    def __post_init__(self):
        unknown = {f for f, _ in self.aggregates.values()} - MERGED.keys()
        if unknown:
            raise UnsupportedOperatorError(f"no way to merge {', '.join(sorted(unknown))} over batches")
        if set(self.keys) & self.aggregates.keys():
            raise ValueError("an aggregate is called like a key")

    # writing

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Log the stream's batches. A new start with the same checkpoint goes on after the last one."""
        taken = {BATCH, ROW} & set(stream.columns)
        if taken:
            raise ValueError(f"the stream has columns called {', '.join(sorted(taken))}")
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def append(self, batch: DataFrame, number: int) -> None:
        """Log one batch. One that is tried again after a failure keeps the rows and ids that were written in full."""
        rows = f"{self.folder}/rows/{BATCH}={number}"
        if not self._complete(rows):
            sorted_rows = batch.hint("rebalance", *self.keys).sortWithinPartitions(*self.keys)
            sorted_rows.withColumn(ROW, F.monotonically_increasing_id()).write.mode("overwrite").parquet(rows)
        groups = f"{self.folder}/groups/{BATCH}={number}"
        if not self._complete(groups):
            logged = self.trail.spark.read.schema(batch.schema).parquet(rows)
            own = [MERGED[f][0](F.lit(1) if c == "*" else F.col(c)).alias(name) for name, (f, c) in self.aggregates.items()]
            logged.groupBy(*self.keys).agg(*own).write.mode("overwrite").parquet(groups)

    def _complete(self, path: str) -> bool:
        spark = self.trail.spark
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

    # reading

    def _log(self, name: str, upto: int | None) -> DataFrame:
        """A log's batches up to ``upto``; the folders of later ones are pruned."""
        try:
            with quiet():
                log = self.trail.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            raise TraceError("no batch has been logged") from e
        log = log.withColumn(BATCH, F.col(BATCH).cast("long"))
        return log if upto is None else log.where(F.col(BATCH) <= upto)

    def batches(self) -> DataFrame:
        """For each group and batch that touched it: ``__batch``, the keys and the batch's own aggregates."""
        return self._log("groups", None)

    def result(self, upto: int | None = None) -> DataFrame:
        """The running result, after all batches or as it was after batch ``upto``."""
        return self._log("groups", upto).groupBy(*self.keys).agg(*[MERGED[f][1](name).alias(name) for name, (f, _) in self.aggregates.items()])

    def _same_keys(self, a: str, b: str) -> Column:
        condition = F.lit(True)
        for k in self.keys:
            condition &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return condition

    def trace(self, condition: str | Column | None = None, upto: int | None = None) -> DataFrame:
        """The rows of all batches behind the running result's rows that ``condition`` chooses, with ``__batch``.

        The log of groups tells first which batches touched a chosen group, so the other
        batches' rows are not read.
        """
        chosen = self.result(upto) if condition is None else self.result(upto).where(condition)
        touched = self._log("groups", upto).alias("g").join(chosen.alias("c"), self._same_keys("g", "c"), "left_semi").select(BATCH, *self.keys)
        rows = self._log("rows", upto).alias("r")
        return rows.join(touched.alias("t"), (F.col(f"r.{BATCH}") == F.col(f"t.{BATCH}")) & self._same_keys("r", "t"), "left_semi").drop(ROW)

    def reached(self, condition: str | Column) -> DataFrame:
        """Forth: the running results' rows that the chosen logged rows influenced, once for each batch.

        A row that came with batch N is behind its group's result after N and after each later
        batch that touched the group; ``__batch`` is the batch after which the result was this.
        """
        first = self._log("rows", None).where(condition).groupBy(*self.keys).agg(F.min(BATCH).alias(FIRST))
        log = self._log("groups", None).alias("g").join(first.alias("f"), self._same_keys("g", "f")).select("g.*", FIRST)
        so_far = Window.partitionBy(*self.keys).orderBy(BATCH).rowsBetween(Window.unboundedPreceding, 0)
        running = [MERGED[f][1](name).over(so_far).alias(name) for name, (f, _) in self.aggregates.items()]
        return log.select(BATCH, *self.keys, *running, FIRST).where(F.col(BATCH) >= F.col(FIRST)).drop(FIRST)

    def rows(self, upto: int | None = None) -> Traced:
        """The logged rows as a traced source, known by batch and place, for any traced query over all batches."""
        log = self._log("rows", upto).withColumn(ID, F.struct(F.col(BATCH).alias("batch"), F.col(ROW).alias("row"))).drop(ROW)
        return self.trail._source(self.folder, log)
