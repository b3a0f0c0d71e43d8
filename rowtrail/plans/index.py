"""A stored lineage index: pairs of output and input ids in buckets of the output's id.

Without it every step computes the query's rows anew. With it a step reads the
buckets of the chosen ids and nothing else. Steps over joins by row ids, unions and
windows are read off the ids themselves and need no table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ID, keeping
from .levels import FEW_KEYS, Joined, Keyed, Level, Source

BUCKETS = 64


def bucket_of(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


@dataclass(eq=False)
class Indexed(Level):
    """Another level with stored tables: for each branch (bucket, output, input), or None where the ids tell enough.

    ``forward`` holds the same pairs in buckets of the input's id, if steps forth shall be short too.
    """

    inner: Level = field(default_factory=Level)
    buckets: int = BUCKETS
    tables: tuple[DataFrame | None, ...] = ()
    forward: tuple[DataFrame | None, ...] = ()

    def matching(self, table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
        """The pairs whose ``column`` is among the ids; only their buckets are read. Few ids are sent to all tasks."""
        numbers = dict(ids.groupBy(bucket_of(F.col(ID), self.buckets)).count().collect())
        wanted = F.broadcast(ids) if sum(numbers.values()) <= FEW_KEYS else ids
        return keeping(table.where(F.col("bucket").isin(sorted(numbers))), F.col(column), wanted)

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        if self.tables[branch] is None:
            return self.inner.back(ids, branch)
        return self.matching(self.tables[branch], ids, "output").select(F.col("input").alias(ID)).distinct()

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        if self.forward[branch] is not None:
            return self.matching(self.forward[branch], ids, "input").select(F.col("output").alias(ID)).distinct()
        if self.tables[branch] is not None:
            return keeping(self.tables[branch], F.col("input"), ids).select(F.col("output").alias(ID)).distinct()
        return self.inner.forth(ids, branch)

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        if self.tables[branch] is None:
            return self.inner.associations(ids, branch)
        return self.matching(self.tables[branch], ids, "output").select("output", "input")

    def describe(self) -> str:
        return f"{self.inner.describe()}, indexed"


def indexed(level: Level, result: DataFrame, buckets: int, forward: bool, write: Callable[[DataFrame, str], DataFrame]) -> Level:
    """The level and those below it, with tables for steps that would compute rows anew.

    ``result`` has the rows of the level that are asked for; ``write`` stores a table by its bucket.
    """
    if isinstance(level, Source):
        return level
    parents = tuple(replace(p, level=indexed(p.level, p.df, buckets, forward, write), intact=False) for p in level.parents)

    def table(branch: int, by: str) -> DataFrame:
        pairs = level.associations_of(result, branch)
        return write(pairs.withColumn("bucket", bucket_of(F.col(by), buckets)), "index")

    kept = [isinstance(level, Keyed) or isinstance(level, Joined) and level.how == "left_semi" and i == 1 for i in range(len(parents))]
    tables = tuple(table(i, "output") if k else None for i, k in enumerate(kept))
    backwards = tuple(table(i, "input") if k and forward else None for i, k in enumerate(kept))
    return Indexed(parents, rows=level.rows, inner=level, buckets=buckets, tables=tables, forward=backwards)


def tables_of(level: Level) -> list[DataFrame]:
    """All tables of the level and those below it."""
    own = [t for t in (*level.tables, *level.forward) if t is not None] if isinstance(level, Indexed) else []
    return [*own, *(t for p in level.parents for t in tables_of(p.level))]
