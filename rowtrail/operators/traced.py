"""DataFrames that know where their rows come from.

``Traced`` mirrors the DataFrame API. Its frame carries one hidden id column; all
work is done by the ordinary DataFrame operators, so pushdown, join selection,
code generation and adaptive execution stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import ID, distinct_ids, key_struct, visible
from ..plans import frames, index
from ..plans.levels import GroupingSets, Joined, Keyed, Level, Peers, Scalar, Source, Unioned, UnsupportedOperatorError, sources
from ..sources.scratch import dropped, written, written_by
from . import ordered_joins
from .cursor import Cursor

JOINS = {"inner": "inner", "left": "left", "leftouter": "left", "left_outer": "left", "right": "right", "rightouter": "right", "right_outer": "right", "full": "full", "outer": "full", "fullouter": "full", "full_outer": "full", "semi": "left_semi", "leftsemi": "left_semi", "left_semi": "left_semi", "anti": "left_anti", "leftanti": "left_anti", "left_anti": "left_anti", "cross": "inner"}


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Traced:
    """``df`` has the visible columns and ``__id``; ``granularity`` is "exact" or "key".

    ``intact``: each row has its source's columns unchanged and stands for it alone,
    so traces can show it without looking it up again.
    """

    df: DataFrame
    level: Level
    granularity: str = "exact"
    held: list = field(default_factory=list, compare=False, repr=False)  #: the session's list of what was written
    intact: bool = False

    @property
    def shows_source(self) -> bool:
        return self.intact and isinstance(self.level, Source)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        copy = written(df, name)
        self.held.append(copy)
        return copy

    # narrow operators: ids pass through

    def _same(self, df: DataFrame, intact: bool = False) -> Traced:
        return replace(self, df=df, intact=intact and self.intact)

    def select(self, *columns: str | Column) -> Traced:
        wanted = [c for x in columns for c in (visible(self.df) if isinstance(x, str) and x == "*" else [x])]
        return self._same(self.df.select(*wanted, ID))

    def with_column(self, name: str, column: Column) -> Traced:
        return self._same(self.df.withColumn(name, column), name not in self.df.columns)

    def where(self, condition: str | Column) -> Traced:
        return self._same(self.df.where(condition), True)

    filter = having = where

    def drop(self, *columns: str) -> Traced:
        return self._same(self.df.drop(*columns))

    def rename(self, old: str, new: str) -> Traced:
        return self._same(self.df.withColumnRenamed(old, new))

    def explode(self, name: str, array: Column, outer: bool = False) -> Traced:
        """One row for each element; each has the id of the row it comes from."""
        return self._same(self.df.withColumn(name, (F.explode_outer if outer else F.explode)(array)))

    def order_by(self, *columns: str | Column) -> Traced:
        return self._same(self.df.orderBy(*columns), True)

    def repartition(self, n: int, *columns: str | Column) -> Traced:
        return self._same(self.df.repartition(n, *columns), True)

    def limit(self, n: int) -> Traced:
        """Any n rows, written once so that later traces see the same ones."""
        return self._same(self._written(self.df.limit(n), "limit"))

    def sample(self, fraction: float, seed: int) -> Traced:
        return self._same(self.df.sample(fraction, seed))

    def cache(self) -> Traced:
        return self._same(self.df.cache())

    def stored(self) -> Traced:
        """Write the rows with their ids; for operators that do not give the same rows each time."""
        return self._same(self._written(self.df, "stored"))

    def indexed(self, buckets: int = index.BUCKETS, forward: bool = False) -> Traced:
        """The same result, stored with a lineage index, so that traces compute nothing anew.

        A trace reads the stored result, and a step back the buckets of the chosen ids. With
        ``forward`` steps forth have buckets of their own. ``release`` deletes all of it,
        the session's ``size`` counts it.
        """

        def write(pairs: DataFrame, name: str) -> DataFrame:
            table = written_by(pairs, name, "bucket")
            self.held.append(table)
            return table

        level = index.indexed(self.level, self.df, buckets, forward, write)
        return replace(self, df=self._written(self.df, "result"), level=level, intact=False)

    def map_in_pandas(self, function: Callable, schema: str, granularity: str | None = None) -> Traced:
        """Refused unless it is declared which input rows stand behind an output row.

        "all": every row of the input; "partition": the rows of the same partition,
        which are written first, so that partitions stay as they are. ``function``
        then gets each partition as one frame.
        """
        if granularity == "partition":
            parent = self._same(self._written(self.df.withColumn("__part", F.spark_partition_id()), "partitions"))

            def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                return pd.concat([*function(iter([rows.drop(columns="__part")]))]).assign(__part=key[0])

            made = StructType([*StructType.fromDDL(schema).fields, *StructType.fromDDL("__part int").fields])
            out = parent.df.drop(ID).groupBy("__part").applyInPandas(part, made)
            return self._opened(out.withColumn(ID, key_struct([F.col("__part")])).drop("__part"), Keyed((parent,), ([F.col("__part")],), "mapInPandas"))
        if granularity != "all":
            raise UnsupportedOperatorError("mapInPandas hides which rows it uses; declare granularity 'all' or 'partition'")
        out = self.df.drop(ID).mapInPandas(function, schema).withColumn(ID, key_struct([]))
        return self._opened(out, Keyed((self,), ([],), "mapInPandas"))

    def apply_in_pandas(self, keys: Sequence[str | Column], function: Callable, schema: str) -> Traced:
        """Grouped map: all rows of a group stand behind what ``function`` makes of it.

        ``schema`` must hold the keys, by name, as ``function`` returns them; rows are
        known by them.
        """
        named = [as_column(k) for k in keys]
        names = self.df.select(*named).columns
        out = self.df.drop(ID).groupBy(*named).applyInPandas(function, schema)
        return self._opened(out.withColumn(ID, key_struct([F.col(n) for n in names])), Keyed((self,), (named,), "grouped map"))

    def table_function(self, function: Callable, *arguments: Column, keys: Sequence[str] = (), granularity: str | None = None) -> Traced:
        """A Python table function (UDTF) over the rows as its table argument; refused unless its granularity is declared.

        "group": it is called for the rows of each group of ``keys``, which its output holds by
        name; all rows of the group stand behind them. "all": one call gets every row, in one
        task, so it is for small tables. For one call a row see ``lateral_join``.
        """
        table = self.df.drop(ID).asTable() if granularity in ("group", "all") else None
        if granularity == "group" and keys:
            out = function(table.partitionBy(*keys), *arguments)
            return self._opened(out.withColumn(ID, key_struct([F.col(k) for k in keys])), Keyed((self,), ([F.col(k) for k in keys],), "table function", list(keys)))
        if granularity == "all":
            return self._opened(function(table.withSinglePartition(), *arguments).withColumn(ID, key_struct([])), Keyed((self,), ([],), "table function"))
        raise UnsupportedOperatorError("a table function hides which rows it uses; declare granularity 'group' with keys, or 'all'")

    def lateral_join(self, other: Traced | DataFrame, on: Column | None = None, how: str = "inner", granularity: str | None = None) -> Traced:
        """LATERAL: what ``other``, which refers to this side by ``col.outer()``, gives for each row.

        A traced ``other`` of narrow operators, and ``nearest``, carries its ids: pairs stand
        behind the rows, as in a join. A plain DataFrame, such as a call of a table function, is
        taken if ``granularity`` is declared to be "row": it uses the row's values alone.
        Spark looks names up in ``other`` first, also ones that were renamed there, so
        the outer columns' names must be none of its source's.
        """
        if how not in ("inner", "left"):
            raise UnsupportedOperatorError("a lateral join is inner or left")
        if not isinstance(other, Traced):
            if granularity != "row":
                raise UnsupportedOperatorError("a table function may keep what it has seen; declare granularity 'row' if it uses each row alone")
            return self._same(self.df.lateralJoin(other, on, how))
        joined = self.df.withColumnRenamed(ID, "__l").lateralJoin(other.df.withColumnRenamed(ID, "__r"), on, how)
        rows = joined.withColumn(ID, F.struct(F.col("__l").alias("l"), F.col("__r").alias("r"))).drop("__l", "__r")
        return self._opened(rows, Joined((self, other), rows.select(ID), f"lateral {how}", [], granularity="exact"))

    def nearest(self, n: int, *order_by: Column) -> Traced:
        """The first n rows of a lateral subquery, for each outer row; ties are broken by the rows' ids, so traces see the same ones."""
        return self._same(self.df.orderBy(*order_by, ID).limit(n))

    def _opened(self, df: DataFrame, level: Level) -> Traced:
        level.rows = df
        if isinstance(level, Keyed):
            level.out = df
        return Traced(df, level, self.granularity, self.held)

    # aggregation

    def group_by(self, *keys: str | Column) -> Grouped:
        return Grouped(self, [as_column(k) for k in keys], [list(range(len(keys)))])

    def rollup(self, *keys: str | Column) -> Grouped:
        return Grouped(self, [as_column(k) for k in keys], [list(range(n)) for n in range(len(keys), -1, -1)], plain=False)

    def cube(self, *keys: str | Column) -> Grouped:
        every = range(len(keys))
        return Grouped(self, [as_column(k) for k in keys], [[i for i in every if mask >> i & 1] for mask in range(2 ** len(keys) - 1, -1, -1)], plain=False)

    def grouping_sets(self, sets: Sequence[Sequence[int]], *keys: str | Column) -> Grouped:
        """Groups by several sets, each a list of places in ``keys``."""
        return Grouped(self, [as_column(k) for k in keys], [list(s) for s in sets], plain=False)

    def agg(self, *aggregates: Column) -> Traced:
        """One row from all rows."""
        return self.group_by().agg(*aggregates)

    def distinct(self) -> Traced:
        """Every duplicate stands behind the row that is left."""
        keys = [F.col(c) for c in visible(self.df)]
        out = self.df.drop(ID).distinct().withColumn(ID, key_struct(keys))
        return self._opened(out, Keyed((self,), (keys,), "distinct", visible(self.df)))

    # joins

    def join(self, other: Traced, on: str | Sequence[str] | Column, how: str = "inner") -> Traced:
        """Any join of Spark's; ids of both sides flow through, so all kinds are exact.

        A semi join's right witnesses are found by joining again; an anti join has none.
        """
        if not isinstance(other, Traced):  # parts of a table that are tried together
            return other.met_by(self, on, how)
        kind = JOINS[how.lower()]
        names = [on] if isinstance(on, str) else list(on) if not isinstance(on, Column) else []
        left, right = self.df.withColumnRenamed(ID, "__l"), other.df.withColumnRenamed(ID, "__r")
        condition = names or on
        pair = F.struct(F.col("__l").alias("l"), F.col("__r").alias("r"))
        matches = None
        if kind in ("left_semi", "left_anti"):
            rows = left.join(right, condition, kind).withColumn(ID, F.struct(F.col("__l").alias("l"))).drop("__l")
            if kind == "left_semi":
                matches = left.join(right, condition).select(pair.alias(ID))
        else:
            rows = left.join(right, condition, kind).withColumn(ID, pair).drop("__l", "__r")
        return self._opened(rows, Joined((self, other), rows.select(ID), kind, names, matches, self.granularity))

    def exists(self, other: Traced, on: str | Sequence[str] | Column, name: str = "exists") -> Traced:
        """Every row, with a flag ``name``: whether ``other`` has a partner for it (EXISTS or IN inside an expression).

        The right witnesses of a flagged row are its partners; a row without any has none.
        """
        names = [on] if isinstance(on, str) else list(on) if not isinstance(on, Column) else []
        left, right = self.df.withColumnRenamed(ID, "__l"), other.df.withColumnRenamed(ID, "__r")
        matches = left.join(right, names or on).select(F.struct(F.col("__l").alias("l"), F.col("__r").alias("r")).alias(ID))
        if names:  # one join: keys that are null on either side find no partner
            known = right.select(*names).dropna().distinct().withColumn("__known", F.lit(True))
            rows = left.join(known, names, "left").withColumn(name, F.col("__known").isNotNull()).drop("__known")
        else:
            rows = left.join(right, on, "left_semi").withColumn(name, F.lit(True)).unionByName(left.join(right, on, "left_anti").withColumn(name, F.lit(False)))
        rows = rows.withColumn(ID, F.struct(F.col("__l").alias("l"))).drop("__l")
        return self._opened(rows, Joined((self, other), rows.select(ID), "left_semi", names, matches, self.granularity))

    def scalar(self, name: str, other: Traced, value: str, on: dict[str, str] | None = None) -> Traced:
        """Every row, with a column ``name``: the value of a scalar subquery, for use in ``where`` and ``select``.

        Without ``on`` the subquery must have one row at most (Spark raises an error
        otherwise), and null stands for none. Its row stands behind every row, on branch
        1. With ``on``, own columns by the subquery's, it is correlated: an aggregate grouped
        by just those columns, looked up by key; behind a row stands its own group.
        """
        if on is None:
            return self._opened(self.df.withColumn(name, other.df.select(value).scalar()), Scalar((self, other)))
        if not isinstance(other.level, Keyed) or other.level.what != "aggregate" or set(other.level.names or ()) != set(on.values()):
            raise UnsupportedOperatorError("a correlated scalar subquery is an aggregate grouped by the columns that it is looked up by")
        keys = {inner: f"__on{i}" for i, inner in enumerate(on.values())}
        found = replace(other, df=other.df.select(*(F.col(inner).alias(k) for inner, k in keys.items()), F.col(value).alias(name), ID))
        condition = reduce(Column.__and__, (F.col(own) == F.col(keys[inner]) for own, inner in on.items()))
        joined = self.join(found, condition, "left")
        return joined.drop(*keys.values())

    def range_join(self, other: Traced, at: Column, low: Column, high: Column, on: Sequence[str] = (), how: str = "inner") -> Traced:
        """See ``ordered_joins.range_join``: low <= at <= high by an equi-join on bins."""
        return ordered_joins.range_join(self, other, at, low, high, on, how)

    def less_join(self, other: Traced, low: Column, high: Column, on: Sequence[tuple[str, str]] = ()) -> Traced:
        """See ``ordered_joins.less_join``: low < high and equal keys; traces of one side need no pairs."""
        return ordered_joins.less_join(self, other, low, high, on)

    def asof_join(self, other: Traced, left_at: str, right_at: str, by: Sequence[str] = (), **how) -> Traced:
        """See ``ordered_joins.asof_join``: each row with the other side's last one at or before its time."""
        return ordered_joins.asof_join(self, other, left_at, right_at, by, **how)

    def cross_join(self, other: Traced) -> Traced:
        return self.join(other, F.lit(True))

    # set operations

    def union(self, *others: Traced) -> Traced:
        """UNION ALL by position; names are the first input's."""
        inputs = (self, *others)
        level = Unioned(inputs)
        names = visible(self.df)
        parts = [p.df.select(*(F.col(c).alias(n) for c, n in zip(visible(p.df), names, strict=True)), level.wrapped(i).alias(ID)) for i, p in enumerate(inputs)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return self._opened(out, level)

    def _set_operation(self, other: Traced, name: str, right_counts: bool) -> Traced:
        names = visible(self.df)
        out = getattr(self.df.drop(ID), name)(other.df.drop(ID))
        keys = [F.col(c) for c in names], [F.col(c) for c in visible(other.df)] if right_counts else None
        return self._opened(out.withColumn(ID, key_struct(keys[0])), Keyed((self, other), keys, name))

    def intersect(self, other: Traced) -> Traced:
        return self._set_operation(other, "intersect", True)

    def intersect_all(self, other: Traced) -> Traced:
        return self._set_operation(other, "intersectAll", True)

    def subtract(self, other: Traced) -> Traced:
        return self._set_operation(other, "subtract", False)

    def except_all(self, other: Traced) -> Traced:
        return self._set_operation(other, "exceptAll", False)

    # windows and top-k

    def with_windows(self, partition_by: Sequence[str | Column], order_by: Sequence[str | Column] = (), own_row: bool = False, frame: frames.Frame | None = None, **columns: Callable | Column) -> Traced:
        """Window functions over one partitioning: each of ``columns`` is a function of the window, or a column to take ``over`` it.

        The whole window partition stands behind a row, or with ``own_row`` the row alone.
        With a ``frame``, its rows and the row itself do: columns are taken over the
        frame, while functions get the ordered window without one, as lag and lead
        need it (their frame is the row at their offset).
        """
        keys = [as_column(c) for c in partition_by]
        if frame is not None:
            return self._opened(*frames.opened(self, keys, order_by, frame, columns))
        window = Window.partitionBy(*keys)
        window = window.orderBy(*order_by) if order_by else window
        df = self.df.withColumns({n: c.over(window) if isinstance(c, Column) else c(window) for n, c in columns.items()})
        own = df.withColumn(ID, F.struct(key_struct(keys).alias("key"), F.col(ID).alias("own")))
        return self._opened(own, Peers((self,), keys, "window", "exact" if own_row else "key"))

    def top(self, n: int, *order_by: Column, keys: Sequence[str | Column] = ()) -> Traced:
        """ORDER BY ... LIMIT n; written once. With key granularity ``keys``, the sort columns, name a row's peers."""
        sort_keys = [as_column(k) for k in keys]
        own = self.df.withColumn(ID, F.struct(key_struct(sort_keys).alias("key"), F.col(ID).alias("own")))
        rows = self._written(own.orderBy(*order_by).limit(n), "top")
        return self._opened(rows, Peers((self,), sort_keys, "top", self.granularity if keys else "exact", rows))

    # results and traces

    @property
    def result(self) -> DataFrame:
        """The rows without ids: an ordinary DataFrame, free to be written anywhere."""
        return self.df.drop(ID)

    @property
    def schema(self) -> StructType:
        return self.result.schema

    def collect(self) -> list:
        return self.result.collect()

    def collect_with_lineage(self) -> list[tuple]:
        """(row, id) for each result row."""
        names = visible(self.df)
        made = self.df.select(F.struct(*names).alias("row"), ID).collect()
        return [(r["row"], r[ID]) for r in made]

    def result_ids(self) -> list:
        """The ids of all result rows."""
        return [r[0] for r in self.df.select(ID).collect()]

    def release(self) -> None:
        """Delete what was written for this result, copies of sources aside (limit, top-k, stored, indexes); its traces end here."""
        kept = [s.rows for s in sources(self.level)]
        for table in [self.df, *index.tables_of(self.level)]:
            dropped(table, *kept)

    def trace(self, where: str | Column | None = None) -> Cursor:
        """A cursor at the result's level, on the rows for which ``where`` holds (or all)."""
        rows = self.df if where is None else self.df.where(where)
        return Cursor(self.level, distinct_ids(rows), rows=rows if self.shows_source else None, behind=self.level.behind(self.df, where))

    def trace_ids(self, ids: Sequence) -> Cursor:
        """A cursor on ids from collect_with_lineage()."""
        schema = self.df.select(ID).schema
        return Cursor(self.level, self.df.sparkSession.createDataFrame([(i,) for i in ids], schema).distinct())

    def backward(self, where: str | Column | None = None, branch: int = 0) -> DataFrame:
        """The source rows behind some result rows, along one branch."""
        return self.trace(where).go_back_all(branch).show()

    def graph(self) -> str:
        return self.level.tree()


@dataclass(frozen=True)
class Grouped:
    """What group_by, rollup, cube and grouping_sets return."""

    parent: Traced
    keys: list[Column]
    sets: list[list[int]]
    plain: bool = True

    def agg(self, *aggregates: Column) -> Traced:
        parent, rows = self.parent, self.parent.df
        names = rows.select(*self.keys).columns if self.keys else []
        if self.plain:
            out = rows.withColumns({f"__g{i}": k for i, k in enumerate(self.keys)})
            out = out.groupBy(*(f"__g{i}" for i in range(len(names)))).agg(*aggregates)
            out = out.withColumn(ID, key_struct([F.col(f"__g{i}") for i in range(len(names))]))
            out = out.withColumnsRenamed({f"__g{i}": n for i, n in enumerate(names)})
            return parent._opened(out, Keyed((parent,), (self.keys,), "aggregate", names))
        level = GroupingSets((parent,), (self.keys,), "grouping sets", columns=self.keys, sets=self.sets)
        numbered = []
        for chosen in self.sets:
            numbered.append([F.col(f"__g{i}") for i in chosen])
        out = rows.withColumns({f"__g{i}": k for i, k in enumerate(self.keys)})
        columns = [F.col(f"__g{i}") for i in range(len(names))]
        grouped = out.groupingSets(numbered, *columns).agg(*aggregates, F.grouping_id().alias("__set"))
        # Spark's grouping_id has a one for each column that the set leaves out
        masks = [sum(1 << len(names) - 1 - i for i in range(len(names)) if i not in chosen) for chosen in self.sets]
        number = F.array_position(F.array(*map(F.lit, masks)), F.col("__set").cast("int")).cast("int") - 1
        grouped = grouped.withColumn(ID, key_struct([*columns, number])).drop("__set")
        return parent._opened(grouped.withColumnsRenamed({f"__g{i}": n for i, n in enumerate(names)}), level)

    def agg_distinct(self, distinct: dict[str, str | Column], *aggregates: Column) -> Traced:
        """COUNT(DISTINCT) of several values, with a level of distinct values between the groups and the rows.

        ``distinct`` names the counts and tells what they count. Each is a branch, in
        order: a step back leads to its distinct values, one more to the rows that have
        them. Nulls are not counted and have no place there. Other ``aggregates`` are on
        one more branch, which leads to the rows at once.
        """
        if not self.plain:
            raise UnsupportedOperatorError("distinct values of rollups and grouping sets are traced by agg()")
        parent = self.parent
        counts = [F.count_distinct(as_column(c)).alias(n) for n, c in distinct.items()]
        made = self.agg(*counts, *aggregates)
        names = made.level.names
        keys = [F.col(f"__k{i}") for i in range(len(names))]
        values = parent.df.withColumns({f"__k{i}": k for i, k in enumerate(self.keys)})
        branches, found = [], []
        for name, counted in distinct.items():
            # Keyed steps compare keys as columns of the parent's rows
            rows = replace(parent, df=values.withColumn("__value", as_column(counted)).where("__value is not null"), intact=False)
            own = rows.df.select(*keys, "__value").distinct().withColumn(ID, key_struct([*keys, F.col("__value")]))
            level = Keyed((rows,), ([*keys, F.col("__value")],), f"distinct {name}")
            level.rows = own.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.col("__value").alias(name), ID)
            branches.append(replace(parent, df=own, level=level, intact=False))
            found.append(keys)
        if aggregates:
            branches.append(parent)
            found.append(self.keys)
        return parent._opened(made.df, Keyed(tuple(branches), found, "count distinct"))

    def count(self) -> Traced:
        return self.agg(F.count(F.lit(1)).alias("count"))
