"""Many parts of an input through one run of a query.

Each row carries the number of a part in place of an id. Whatever groups rows,
groups them by part too, and rows of different parts never meet, so one scan and one
aggregation judge all parts. Operators for which that is not so (limits, top-k, a
global aggregate, which has a row even over nothing, opaque functions) are refused,
and the parts are then tried one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ID, visible
from ..operators.traced import JOINS, Traced, as_column
from ..plans.levels import UnsupportedOperatorError


@dataclass(frozen=True)
class Parted:
    """Mirrors those operators of ``Traced`` that keep parts apart; ``df`` has the visible columns and the part as ``__id``."""

    df: DataFrame

    def select(self, *columns: str | Column) -> Parted:
        wanted = [c for x in columns for c in (visible(self.df) if isinstance(x, str) and x == "*" else [x])]
        return Parted(self.df.select(*wanted, ID))

    def with_column(self, name: str, column: Column) -> Parted:
        return Parted(self.df.withColumn(name, column))

    def where(self, condition: str | Column) -> Parted:
        return Parted(self.df.where(condition))

    filter = having = where

    def drop(self, *columns: str) -> Parted:
        return Parted(self.df.drop(*columns))

    def rename(self, old: str, new: str) -> Parted:
        return Parted(self.df.withColumnRenamed(old, new))

    def explode(self, name: str, array: Column, outer: bool = False) -> Parted:
        return Parted(self.df.withColumn(name, (F.explode_outer if outer else F.explode)(array)))

    def order_by(self, *columns: str | Column) -> Parted:
        return self

    def repartition(self, n: int, *columns: str | Column) -> Parted:
        return Parted(self.df.repartition(n, *columns))

    def group_by(self, *keys: str | Column) -> PartedGroups:
        if not keys:
            raise UnsupportedOperatorError("a global aggregate has a row over no rows")
        return PartedGroups(self, [as_column(k) for k in keys])

    def distinct(self) -> Parted:
        return Parted(self.df.distinct())

    def join(self, other: Parted | Traced, on: str | Sequence[str] | Column, how: str = "inner") -> Parted:
        """With another part's rows only within the part; rows of other tables meet every part."""
        kind = JOINS[how.lower()]
        if isinstance(other, Traced):
            if kind in ("right", "full"):
                raise UnsupportedOperatorError("rows without a partner would be in every part")
            return Parted(self.df.join(other.df.drop(ID), on, kind))
        if isinstance(on, Column):
            right = other.df.withColumnRenamed(ID, "__part")
            joined = self.df.join(right, on & (F.col(ID) == F.col("__part")), kind)
            return Parted(joined if kind in ("left_semi", "left_anti") else joined.withColumn(ID, F.coalesce(ID, "__part")).drop("__part"))
        return Parted(self.df.join(other.df, [*([on] if isinstance(on, str) else on), ID], kind))

    def met_by(self, other: Traced, on: str | Sequence[str] | Column, how: str) -> Parted:
        """The join of another table with the parts, which then are on its right."""
        if JOINS[how.lower()] not in ("inner", "right"):
            raise UnsupportedOperatorError("the other table's rows would be in every part")
        return Parted(other.df.drop(ID).join(self.df, on, JOINS[how.lower()]))

    def union(self, *others: Parted) -> Parted:
        names, out = visible(self.df), self.df
        for other in others:
            if not isinstance(other, Parted):
                raise UnsupportedOperatorError("another table's rows would be in every part")
            out = out.unionByName(other.df.select(*(F.col(c).alias(n) for c, n in zip(visible(other.df), names, strict=True)), ID))
        return Parted(out)

    def with_windows(self, partition_by: Sequence[str | Column], order_by: Sequence[str | Column] = (), own_row: bool = False, **columns: Callable | Column) -> Parted:
        window = Window.partitionBy(ID, *partition_by)
        window = window.orderBy(*order_by) if order_by else window
        return Parted(self.df.withColumns({n: c.over(window) if isinstance(c, Column) else c(window) for n, c in columns.items()}))


@dataclass(frozen=True)
class PartedGroups:
    parent: Parted
    keys: list[Column]

    def agg(self, *aggregates: Column) -> Parted:
        return Parted(self.parent.df.groupBy(ID, *self.keys).agg(*aggregates))

    def count(self) -> Parted:
        return self.agg(F.count(F.lit(1)).alias("count"))


def fits(query: Callable, rows: DataFrame) -> bool:
    """Whether the query has only operators that keep parts apart; nothing is run."""
    try:
        return isinstance(query(Parted(rows.withColumn(ID, F.lit(0)))), Parted)
    except (AttributeError, TypeError, UnsupportedOperatorError):
        return False
