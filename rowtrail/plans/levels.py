"""Levels: the places at which a trace can stand.

A narrow operator (filter, projection, explode, UDF, sort, limit) passes row ids
through. Every other operator opens a level, whose rows have ids of their own:
the group key, the pair of joined ids, the branch and id of a union. Such ids are
values of the data, so nothing has to be stored while a query runs; a step back or
forth is a semi-join that Catalyst plans like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ID, distinct_ids, keeping, key_struct, visible

if TYPE_CHECKING:
    from ..operators.traced import Traced


@contextmanager
def quiet() -> Iterator[None]:
    """Keeps PySpark from logging an analysis error that is caught."""
    # by PySpark's own class: a plain logger made first under these names would fail on what PySpark logs later
    loggers = [PySparkLogger.getLogger(name) for name in ("DataFrameQueryContextLogger", "SQLQueryContextLogger")]
    before = [x.disabled for x in loggers]
    try:
        for x in loggers:
            x.disabled = True
        yield
    finally:
        for x, was in zip(loggers, before, strict=True):
            x.disabled = was


#: Keys of groups up to which a step back sends them to all tasks instead of dealing rows by key.
FEW_KEYS = 10_000


class TraceError(ValueError):
    """A step that the trace cannot take."""


class UnsupportedOperatorError(TypeError):
    """An operator whose provenance is unknown; raised rather than a wrong answer."""


@dataclass(eq=False)
class Level:
    parents: tuple[Traced, ...] = ()
    rows: DataFrame | None = field(default=None, kw_only=True)  #: the level's own rows with their ids

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        """Ids of the parent's rows behind the given rows of this level."""
        raise NotImplementedError

    def rows_back(self, ids: DataFrame, branch: int) -> DataFrame | None:
        """The parent's rows themselves, each once, where one join finds them."""
        return None

    def behind(self, result: DataFrame, where: str | Column | None) -> Callable[[int], DataFrame | None] | None:
        """By branch, the parent's rows behind those of ``result`` for which ``where`` holds, if the condition tells them without ids."""
        return None

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        """Ids of this level's rows to which the parent's rows contribute."""
        raise NotImplementedError

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        """(output, input): the given rows of this level, each with the parent's rows behind it."""
        raise NotImplementedError

    def associations_of(self, result: DataFrame, branch: int) -> DataFrame:
        """(output, input) for all rows of ``result``."""
        return self.associations(result.select(ID), branch)

    def keys_of(self, ids: DataFrame) -> DataFrame:
        """The ids of groups, to be sent to all tasks if they are few, which one job tells.

        Else Spark deals rows by key, and one task gets all rows of a large group: adaptive
        execution broadcasts no side most of whose partitions are empty, as those of a few keys are.
        """
        return F.broadcast(ids) if ids.limit(FEW_KEYS + 1).count() <= FEW_KEYS else ids

    def describe(self) -> str:
        return type(self).__name__.lower()

    def tree(self, depth: int = 0) -> str:
        """The capture graph, one line for each level."""
        return "\n".join(["  " * depth + self.describe(), *(p.level.tree(depth + 1) for p in self.parents)])


@dataclass(eq=False)
class Source(Level):
    name: str = ""
    cut: Callable[[list[int]], DataFrame] | None = None  #: the rows of some files only, where ids have a ``file``

    def describe(self) -> str:
        return f"source {self.name}"


@dataclass(eq=False)
class Keyed(Level):
    """Rows of the parents that share a key with a row of this level: groups, distinct rows, set operations.

    ``keys`` has the key columns for each parent, or None for a parent that leaves
    no witness (the right side of EXCEPT).
    """

    keys: Sequence[Sequence[Column] | None] = ()
    what: str = "aggregate"
    names: Sequence[str] | None = None  #: of the keys in ``out``, the level's own result
    takes_all = False  #: without names too, each of the parent's rows is behind some row
    out: DataFrame | None = None

    def behind(self, result: DataFrame, where: str | Column | None) -> Callable[[int], DataFrame] | None:
        """The parent's rows of the groups for which ``where`` holds, if it speaks of the keys alone; without it, of all groups."""
        if result is not self.out or (self.names is None and not (where is None and self.takes_all)):
            return None
        rows = self.parents[0].df
        if where is None:
            return lambda branch: rows
        named = rows.select(F.struct("*").alias("__row"), *(k.alias(n) for k, n in zip(self.keys[0], self.names, strict=True)))
        with quiet():
            try:
                named.drop("__row").where(where)
            except AnalysisException:  # it speaks of an aggregate
                return None
        return lambda branch: named.where(where).select("__row.*")

    def whole(self, result: DataFrame) -> bool:
        """Whether ``result`` has a row for each group and no other, so each id once."""
        return result is self.out and self.what in ("aggregate", "distinct")

    def associations_of(self, result: DataFrame, branch: int) -> DataFrame:
        """Where all groups are asked for, the parent's rows are neither looked up nor, if each has an id of its own, made distinct."""
        if not self.whole(result):
            return super().associations_of(result, branch)
        parent = self.parents[branch]
        pairs = self.pairs(branch).select(F.col("__key").alias("output"), F.col(ID).alias("input"))
        single = parent.shows_source or isinstance(parent.level, Keyed) and parent.level.whole(parent.df)
        return pairs if single else pairs.distinct()

    def rows_back(self, ids: DataFrame, branch: int) -> DataFrame | None:
        if self.keys[branch] is None:
            return None
        return keeping(self.parents[branch].df.withColumn("__key", key_struct(self.keys[branch])), F.col("__key"), self.keys_of(ids)).drop("__key")

    def pairs(self, branch: int) -> DataFrame:
        """(key, id) of the parent's rows."""
        rows = self.parents[branch].df
        keys = self.keys[branch]
        made = rows.select(key_struct(keys or ()).alias("__key"), ID)
        return made if keys is not None else made.where(F.lit(False))

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        return distinct_ids(keeping(self.pairs(branch), F.col("__key"), self.keys_of(ids)))

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        return keeping(self.pairs(branch), F.col(ID), ids).select(F.col("__key").alias(ID)).distinct()

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        return keeping(self.pairs(branch), F.col("__key"), self.keys_of(ids)).select(F.col("__key").alias("output"), F.col(ID).alias("input")).distinct()

    def describe(self) -> str:
        return self.what


@dataclass(eq=False)
class GroupingSets(Keyed):
    """Groups by several sets of the same columns; the set's number is part of the key.

    So a total and a group whose key is null stay apart. A step back asks first which sets
    the chosen groups are of, at most as many numbers as there are sets, and then
    looks for rows by the columns of those sets only.
    """

    columns: Sequence[Column] = ()
    sets: Sequence[Sequence[int]] = ()
    takes_all = True

    def numbers(self, ids: DataFrame) -> list[int]:
        return sorted(r[0] for r in ids.select(f"{ID}.k{len(self.columns)}").distinct().collect())

    def of_set(self, number: int, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows in the chosen groups of one set, with their ``__key``."""
        chosen, of = self.sets[number], f"{ID}.k{len(self.columns)}"
        if not chosen:  # the total: every row, if it is asked for at all
            return rows.withColumn("__key", key_struct([*(F.when(F.lit(False), c) for c in self.columns), F.lit(number)]))
        wanted = ids.where(F.col(of) == number).select(F.struct(*(F.col(f"{ID}.k{i}").alias(f"k{i}") for i in chosen)).alias(ID))
        met = keeping(rows.withColumn("__of_set", F.struct(*(self.columns[i].alias(f"k{i}") for i in chosen))), F.col("__of_set"), wanted).drop("__of_set")
        return met.withColumn("__key", self.key(number))

    def key(self, number: int) -> Column:
        # a column that the set leaves out is null, with the type it has
        return key_struct([*(c if i in self.sets[number] else F.when(F.lit(False), c) for i, c in enumerate(self.columns)), F.lit(number)])

    def rows_back(self, ids: DataFrame, branch: int) -> DataFrame | None:
        ids = self.keys_of(ids)
        numbers = self.numbers(ids)
        if len(numbers) != 1:
            return None  # a row may belong to groups of several sets
        return self.of_set(numbers[0], self.parents[0].df, ids).drop("__key")

    def met(self, ids: DataFrame) -> DataFrame:
        rows, ids = self.parents[0].df, self.keys_of(ids)
        found = [self.of_set(n, rows, ids).select("__key", ID) for n in self.numbers(ids)]
        return reduce(DataFrame.unionByName, found) if found else rows.select(self.key(0).alias("__key"), ID).where(F.lit(False))

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        return distinct_ids(self.met(ids))

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        return self.met(ids).select(F.col("__key").alias("output"), F.col(ID).alias("input")).distinct()

    def pairs(self, branch: int) -> DataFrame:
        """All groups of each row; a step forth asks for a few rows only."""
        return self.parents[0].df.select(F.explode(F.array(*map(self.key, range(len(self.sets))))).alias("__key"), ID)

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        chosen = keeping(self.parents[0].df, F.col(ID), ids)
        return chosen.select(F.explode(F.array(*map(self.key, range(len(self.sets))))).alias(ID)).distinct()


@dataclass(eq=False)
class Scalar(Level):
    """A value of a subquery's one row beside every row; rows keep their own ids.

    Behind a row stand its own and, on branch 1, the subquery's row if it has one.
    """

    def one(self, ids: DataFrame) -> DataFrame:
        """The subquery's id, if there is any row whose witness it could be."""
        return self.parents[1].df.select(ID).join(ids.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_semi")

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        return ids if branch == 0 else self.one(ids)

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        if branch == 0:
            return ids
        return self.rows.select(ID).join(ids.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_semi")

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        outputs = ids.select(F.col(ID).alias("output"))
        if branch == 0:
            return outputs.withColumn("input", F.col("output"))
        # one value at most, set beside each output
        return outputs.withColumn("input", self.parents[1].df.select(ID).scalar()).where("input is not null")

    def describe(self) -> str:
        return "scalar subquery"


@dataclass(eq=False)
class Joined(Level):
    """A join: ids are pairs. ``joined`` holds them all, null on the side without a partner.

    With key granularity a step back takes all rows of the side that share the join
    keys, as a shuffled join without row ids would have to.
    """

    joined: DataFrame | None = None
    how: str = "inner"
    on: Sequence[str] = ()
    matches: DataFrame | None = None  #: of a semi join, the pairs behind it
    granularity: str = "exact"

    def side(self, branch: int) -> Column:
        return F.col(f"{ID}.{'lr'[branch]}")

    def pairs(self, branch: int) -> DataFrame:
        if self.how == "left_anti" and branch == 1:
            return self.joined.where(F.lit(False)).select(ID, F.lit(None).cast(self.parents[1].df.schema[ID].dataType).alias("__side"))
        if self.how == "left_semi" and branch == 1:
            return self.matches.select(F.struct(self.side(0).alias("l")).alias(ID), self.side(1).alias("__side"))
        return self.joined.select(ID, self.side(branch).alias("__side")).where("__side is not null")

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        if branch == 1 and self.how in ("left_semi", "left_anti"):  # only here an id lacks the side asked for
            exact = keeping(self.pairs(branch), F.col(ID), ids).select(F.col("__side").alias(ID)).distinct()
        else:
            exact = ids.select(self.side(branch).alias(ID)).where(F.col(ID).isNotNull()).distinct()
        if self.granularity == "exact" or not self.on:
            return exact
        rows = self.parents[branch].df
        shared = keeping(rows, F.col(ID), exact).select(key_struct([F.col(c) for c in self.on]).alias(ID)).distinct()
        return distinct_ids(keeping(rows.withColumn("__key", key_struct([F.col(c) for c in self.on])), F.col("__key"), shared))

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        return distinct_ids(keeping(self.pairs(branch), F.col("__side"), ids))

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        """With exact granularity, whatever the cursor's own."""
        return keeping(self.pairs(branch), F.col(ID), ids).select(F.col(ID).alias("output"), F.col("__side").alias("input")).distinct()

    def describe(self) -> str:
        return f"join {self.how}"


@dataclass(eq=False)
class Unioned(Level):
    """UNION ALL: an id is the branch's number and, in the branch's place, the child's id."""

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        return ids.where(F.col(f"{ID}.b") == branch).select(F.col(f"{ID}.i{branch}").alias(ID)).distinct()

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        return ids.select(self.wrapped(branch).alias(ID))

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        return ids.where(F.col(f"{ID}.b") == branch).select(F.col(ID).alias("output"), F.col(f"{ID}.i{branch}").alias("input")).distinct()

    def wrapped(self, branch: int) -> Column:
        inner = [F.col(ID) if i == branch else F.lit(None).cast(p.df.schema[ID].dataType) for i, p in enumerate(self.parents)]
        return F.struct(F.lit(branch).alias("b"), *(c.alias(f"i{i}") for i, c in enumerate(inner)))

    def describe(self) -> str:
        return "union"


@dataclass(eq=False)
class Peers(Level):
    """Windows and top-k: a row keeps its own id beside the key it shares with its peers.

    With key granularity a step back takes the whole window partition, or all rows
    with equal sort keys; with exact granularity the row itself.
    """

    keys: Sequence[Column] = ()
    what: str = "window"
    granularity: str = "key"
    chosen: DataFrame | None = field(default=None)

    def rows_back(self, ids: DataFrame, branch: int) -> DataFrame | None:
        if self.granularity == "exact":
            return None
        keys = self.keys_of(ids.select(F.col(f"{ID}.key").alias(ID)).distinct())
        return keeping(self.parents[0].df.withColumn("__key", key_struct(self.keys)), F.col("__key"), keys).drop("__key")

    def pairs(self) -> DataFrame:
        return self.parents[0].df.select(key_struct(self.keys).alias("__key"), ID)

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        if self.granularity == "exact":
            return ids.select(F.col(f"{ID}.own").alias(ID)).distinct()
        keys = self.keys_of(ids.select(F.col(f"{ID}.key").alias(ID)).distinct())
        return distinct_ids(keeping(self.pairs(), F.col("__key"), keys))

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        if self.granularity == "exact":
            return ids.select(F.col(ID).alias("output"), F.col(f"{ID}.own").alias("input")).distinct()
        wanted = ids.select(F.col(ID).alias("output"), F.col(f"{ID}.key").alias("__of"))
        return wanted.join(self.pairs(), F.col("__of") == F.col("__key")).select("output", F.col(ID).alias("input")).distinct()

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        own = self.pairs().select("__key", F.col(ID).alias("__own"))
        if self.granularity == "exact":
            reached = keeping(own, F.col("__own"), ids)
        else:
            keys = self.keys_of(keeping(own, F.col("__own"), ids).select(F.col("__key").alias(ID)).distinct())
            reached = keeping(own, F.col("__key"), keys)
        made = reached.select(F.struct(F.col("__key").alias("key"), F.col("__own").alias("own")).alias(ID)).distinct()
        return made if self.chosen is None else keeping(made, F.col(ID), self.chosen.select(ID))

    def describe(self) -> str:
        return self.what


def sources(level: Level) -> list[Source]:
    """The sources below a level, left to right, each occurrence once."""
    if isinstance(level, Source):
        return [level]
    return [s for p in level.parents for s in sources(p.level)]


__all__ = ["GroupingSets", "Joined", "Keyed", "Level", "Peers", "Scalar", "Source", "TraceError", "Unioned", "UnsupportedOperatorError", "sources", "visible"]
