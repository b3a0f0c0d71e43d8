"""Range and as-of joins without nested loops, with the ids of both sides.

A range join puts each interval into bins of a width near its own length: the power of
two that is at least as long, so that an interval lies in at most two bins. A point looks
into one bin of each width that occurs. The join itself is an ordinary equi-join on width
and bin. A bin that holds many points and many intervals, as those of wide intervals do, is
cut into pieces on both sides, and each pair of pieces meets in a tile of its own. In a tile the
points are packed into blocks of neighbours, and intervals meet blocks: a block's points come
one after another for each interval, so files that the pairs are written to hold
the same short runs again and again, which pack to a tenth of a byte a pair.

Which points lie in any interval, and which intervals hold any point, is found without the
pairs: both are sorted together, in cells between quantiles, and a running maximum of the ends
(or the next point) is carried along and from cell to cell.

An as-of join sorts both sides together and carries the last row of the right side
along. Where keys are hot, ``every`` cuts time into pieces that are sorted apart; what the
pieces before one leave behind is carried over as one row a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import isfinite
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import ID, visible
from ..plans.levels import Joined, quiet

if TYPE_CHECKING:
    from .traced import Traced

#: The exponent that stands for intervals of one point, which are their own bins, and the largest exponent of a double.
POINT, MOST_POWER = -1100, 1023
#: Rows of a piece. A bin is cut if it has more than TILE * TILE pairs, so there are fewer such bins than rows / TILE.
TILE = 8192
#: Points of a block.
BLOCK = 256
#: Into how many cells a sweep cuts the numbers.
CELLS = 128


def bin_of(at: Column, power: Column) -> Column:
    # the sum makes -0.0 equal to 0.0, which array_distinct tells apart
    return F.when(power == POINT, at + F.lit(0.0)).otherwise(F.floor(at / F.pow(F.lit(2.0), power.cast("double"))).cast("double"))


def binned(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """The intervals with ``__power`` and ``__bin``, once for each bin that they touch; empty ones, nulls and NaN touch none."""
    placed = intervals.withColumns({"__low": low, "__high": high}).where("__low <= __high and not isnan(__low) and not isnan(__high)")
    first, last = F.col("__low").cast("double"), F.col("__high").cast("double")
    # one more than needed, against rounding
    power = F.when(last > first, F.least(F.lit(MOST_POWER), F.ceil(F.log2(last - first)).cast("int") + 1)).otherwise(POINT)
    placed = placed.withColumn("__power", power)
    ends = F.array_distinct(F.array(bin_of(first, F.col("__power")), bin_of(last, F.col("__power"))))
    return placed.withColumn("__bin", F.explode(ends))


def in_blocks(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys``, by ``__at`` and at most BLOCK in one: an array for each other column, __places, __least and __most.

    They are dealt by ``keys`` already and stay where they are. Each column has an array of its own,
    so that Catalyst leaves out those that nobody asks for; null is kept, as a struct that holds it.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))
    arrays = [F.collect_list(F.struct(F.col(c).alias("value"))).alias(c) for c in points.columns if c not in keys]
    blocks = points.withColumn("__block", F.floor((place - 1) / BLOCK)).groupBy(*keys, "__block")
    blocks = blocks.agg(*arrays, F.min("__at").alias("__least"), F.max("__at").alias("__most"), F.count(F.lit(1)).cast("int").alias("__places"))
    return blocks.withColumn("__places", F.sequence(F.lit(0), F.col("__places") - 1)).drop("__block")


def cuts_of(points: DataFrame, at: Column, least: int = 0) -> list[float]:
    """Numbers that cut the points into CELLS parts about as large, or into fewer of ``least`` points or more. They change the balance alone."""
    told = points.select(at.cast("double").alias("x")).where("not isnan(x)")
    told = told.agg(F.percentile_approx("x", [i / CELLS for i in range(1, CELLS)], 2 * CELLS).alias("cuts"), F.count("x").alias("n")).first()
    parts = min(CELLS, told.n // least) if least else CELLS
    cuts = [told.cuts[i * CELLS // parts - 1] for i in range(1, parts)] if told.n else []
    return sorted({c for c in cuts if isfinite(c)})


def cell_of(column: str, cuts: Sequence[float]) -> Column:
    """How many cuts lie at or below the number."""

    def within(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN cast(`{column}` AS double) >= {cuts[middle]!r}D THEN {within(middle + 1, high)} ELSE {within(low, middle)} END"

    return F.expr(within(0, len(cuts)))


def met_in_tiles(probes: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of equal ``keys`` with ``__at`` from ``__low`` to ``__high``; those of hot keys are dealt to tiles, which changes the balance alone."""
    counts = probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")), keys)
    hot = counts.where(F.col("__n").cast("double") * F.col("__m") > TILE * TILE)
    hot = hot.select(*keys, *(F.ceil(F.col(c) / TILE).cast("int").alias(s) for c, s in (("__n", "__rows"), ("__m", "__columns"))))
    tiles, tasks = [], int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side, id_, own, other in ((probes, "__l", "__rows", "__columns"), (intervals, "__r", "__columns", "__rows")):
        # few, by their definition
        cut = side.join(F.broadcast(hot), keys, "left")
        cut = cut.withColumn("__own", F.pmod(F.xxhash64(id_, "__at" if side is probes else "__low"), F.coalesce(own, F.lit(1))))
        cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        rows, columns = ("__own", "__other") if side is probes else ("__other", "__own")
        dealt = cut.drop("__rows", "__columns").withColumnsRenamed({rows: "__row", columns: "__column"})
        dealt = dealt.withColumns({c: F.col(c).cast("long") for c in ("__row", "__column")})
        # dealt over all tasks: a tile has few bytes and many pairs, which adaptive execution does not see
        tiles.append(dealt.repartition(tasks, *keys, "__row", "__column"))
    keys = [*keys, "__row", "__column"]
    overlapping = (F.col("__least") <= F.col("__high")) & (F.col("__most") >= F.col("__low"))
    met = in_blocks(tiles[0], keys).hint("merge").join(tiles[1], keys).where(overlapping).withColumn("__place", F.explode("__places"))
    met = met.withColumns({c: F.get(c, F.col("__place"))["value"] for c in tiles[0].columns if c not in keys})
    # numbers meet as doubles, and are compared as what they are
    return met.where("__at >= __low and __at <= __high")


def compared_as(spark: SparkSession, at: str, low: str, high: str) -> str | None:
    """The one type in which ``at`` is compared with both ends; None if there are two, or the types of decimals differ."""
    if at == low == high:
        return at
    both = [spark.range(0).select(F.coalesce(F.lit(None).cast(at), F.lit(None).cast(end)).alias("x")).schema["x"].dataType.simpleString() for end in (low, high)]
    return both[0] if both[0] == both[1] and not any(t.startswith("decimal") for t in (at, low, high)) else None


@dataclass(frozen=True)
class Sides:
    """Both sides of a range join, and their sweeps. Rows of the sides are named by the frames ``left`` and ``right`` or cut from them."""

    left: DataFrame
    right: DataFrame
    at: Column
    low: Column
    high: Column
    on: Sequence[str]

    def kind(self) -> str | None:
        types = [df.select(c.alias("x")).schema["x"].dataType.simpleString() for df, c in ((self.left, self.at), (self.right, self.low), (self.right, self.high))]
        return compared_as(self.left.sparkSession, *types)

    def points(self, left: DataFrame) -> DataFrame:
        return left.withColumn("__pos", self.at.cast(self.kind())).where(" and ".join(f"`{c}` is not null" for c in ["__pos", *self.on]) + " and not isnan(`__pos`)")

    def intervals(self, right: DataFrame) -> DataFrame:
        kind = self.kind()
        placed = right.withColumns({"__pos": self.low.cast(kind), "__high": self.high.cast(kind)})
        return placed.where("__pos <= __high and not isnan(__pos) and not isnan(__high)" + "".join(f" and `{c}` is not null" for c in self.on))

    def cell(self) -> Column:
        """The number of the cell of ``__pos``."""
        return cell_of("__pos", cuts_of(self.left, self.at))

    def swept(self, points: DataFrame, intervals: DataFrame, to_points: bool) -> DataFrame:
        """(on, __pos, __seen): for each point the largest end of the intervals that begin at or before it, or for each begin the next point."""
        told = [points.select(*self.on, "__pos").distinct().withColumns({"__turn": F.lit(1), "__told": F.lit(None).cast(self.kind()) if to_points else F.col("__pos")})]
        begins = intervals.groupBy(*self.on, "__pos").agg((F.max("__high") if to_points else F.lit(None).cast(self.kind())).alias("__told"))
        told.append(begins.withColumn("__turn", F.lit(0)))
        both = told[0].unionByName(told[1]).withColumn("__cell", self.cell())
        turned, best = (F.asc, F.max) if to_points else (F.desc, F.min)
        upto = Window.partitionBy(*self.on, "__cell").orderBy(turned("__pos"), turned("__turn")).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*self.on).orderBy(turned("__cell")).rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*self.on, "__cell").agg(best("__told").alias("__best")).withColumn("__carried", best("__best").over(before)).drop("__best")
        seen = both.withColumn("__own", best("__told").over(upto)).where(F.col("__turn") == int(to_points)).join(carried, [*self.on, "__cell"])
        return seen.select(*self.on, "__pos", (F.greatest if to_points else F.least)("__own", "__carried").alias("__seen"))

    def lefts(self, left: DataFrame, right: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows of ``left`` that lie in some interval of ``right``, or with "left_anti" in none."""
        inside = self.swept(self.points(left), self.intervals(right), True).where("__seen >= __pos").drop("__seen")
        return left.withColumn("__pos", self.at.cast(self.kind())).join(inside, [*self.on, "__pos"], how).select(*left.columns)

    def rights(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The rows of ``right`` whose interval holds some point of ``left``."""
        following = self.swept(self.points(left), self.intervals(right), False)
        return self.intervals(right).join(following, [*self.on, "__pos"]).where("__seen <= __high").select(*right.columns)


@dataclass(eq=False)
class Ranged(Joined):
    """A range join: a step back from rows that a condition on one side tells needs no pairs."""

    sides: Sides | None = None

    def behind(self, result: DataFrame, where: str | Column | None) -> Callable[[int], DataFrame | None] | None:
        if result is not self.rows or self.sides.kind() is None:
            return None
        left, right = self.sides.left, self.sides.right
        gained = [c for c in visible(right) if c not in self.on]
        if where is None:
            return self.of_left(left)
        for rows, columns in ((left, visible(left)), (right, gained)):
            with quiet():
                try:
                    rows.select(*columns).where(where)
                except AnalysisException:  # it speaks of the other side too
                    continue
            return self.of_left(rows.where(where)) if rows is left else self.of_right(rows.where(where), where)
        return None

    def of_left(self, chosen: DataFrame) -> Callable[[int], DataFrame]:
        def found(branch: int) -> DataFrame:
            if branch == 1:
                return self.sides.rights(chosen, self.sides.right)
            return chosen if self.how == "range left" else self.sides.lefts(chosen, self.sides.right)

        return found

    def of_right(self, chosen: DataFrame, where: str | Column) -> Callable[[int], DataFrame]:
        left, right = self.sides.left, self.sides.right

        def found(branch: int) -> DataFrame:
            if branch == 1:
                return self.sides.rights(left, chosen)
            met = self.sides.lefts(left, chosen)
            if self.how != "range left":
                return met
            nulls = {c: F.lit(None).cast(right.schema[c].dataType) for c in visible(right) if c not in self.on}
            alone = self.sides.lefts(left, right, "left_anti").withColumns(nulls).where(where).drop(*nulls)
            return met.unionByName(alone)

        return found


def range_join(left: Traced, right: Traced, at: Column, low: Column, high: Column, on: Sequence[str] = (), how: str = "inner") -> Traced:
    """Rows of ``left`` and ``right`` with low <= at <= high, and equal ``on``.

    ``at`` is a number of the left side, ``low`` and ``high`` of the right. ``how`` is "inner" or
    "left". Null or NaN ends and points meet nothing. Column names other than ``on`` must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError("a range join is inner or left")
    columns, gained = visible(left.df), [c for c in visible(right.df) if c not in on]
    intervals = binned(right.df.withColumnRenamed(ID, "__r"), low, high)
    # the widths that occur: at most some 2,000 numbers, whatever the rows
    widths = sorted(r[0] for r in intervals.select("__power").distinct().collect())
    probes = left.df.withColumnRenamed(ID, "__l").withColumn("__at", at).withColumn("__power", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")))
    probes = probes.withColumn("__bin", bin_of(F.col("__at").cast("double"), F.col("__power")))
    # null and NaN meet nothing, and would all go to one task to learn that
    probes, intervals = probes.dropna(subset=[*on, "__at"]), intervals.dropna(subset=on) if on else intervals
    # neighbours share a cell, so that an interval holds most blocks that it touches as a whole
    cuts = cuts_of(left.df, at, TILE)
    probes = probes.withColumn("__cell", cell_of("__at", cuts))
    intervals = intervals.withColumn("__cell", F.explode(F.sequence(cell_of("__low", cuts), cell_of("__high", cuts))))
    # wide intervals come first: by the first pairs, which should repeat, writers decide on a dictionary
    probes, intervals = (df.withColumn("__narrow", -F.col("__power")).drop("__power") for df in (probes, intervals))
    met = met_in_tiles(probes, intervals, [*on, "__narrow", "__bin", "__cell"])
    rows = met.select(*columns, *gained, F.struct(F.col("__l").alias("l"), F.col("__r").alias("r")).alias(ID))
    sides = Sides(left.df, right.df, at, low, high, list(on))
    if how == "left":
        types = {f.name: f.dataType for f in right.df.schema.fields}
        if sides.kind() is None:
            own = left.df.withColumnRenamed(ID, "__l")
            alone = own.join(met.select(F.col("__l").alias("__met")), F.col("__l") == F.col("__met"), "left_anti")
        else:
            alone = sides.lefts(left.df, right.df, "left_anti").withColumnRenamed(ID, "__l")
        rows = rows.unionByName(alone.select(*columns, *(F.lit(None).cast(types[c]).alias(c) for c in gained), F.struct(F.col("__l").alias("l"), F.lit(None).cast(types[ID]).alias("r")).alias(ID)))
    return left._opened(rows, Ranged((left, right), rows.select(ID), f"range {how}", list(on), sides=sides))


@dataclass(eq=False)
class Less(Joined):
    """A join by equal keys and ``low`` < ``high``.

    Whether a row has a partner is told by the largest or the least number of its key, so a
    step back from rows that a condition on one side tells needs no pairs.
    """

    low: Column | None = None
    high: Column | None = None
    keys: Sequence[tuple[str, str]] = ()

    def behind(self, result: DataFrame, where: str | Column | None) -> Callable[[int], DataFrame] | None:
        sides = [p.df for p in self.parents]
        # numbers of two types are compared as a third, which may order them in another way
        if result is not self.rows or sides[0].select(self.low.alias("x")).schema["x"].dataType != sides[1].select(self.high.alias("x")).schema["x"].dataType:
            return None
        if where is None:
            return lambda branch: self.partnered(sides, branch)
        for i, rows in enumerate(sides):
            with quiet():
                try:
                    rows.drop(ID).where(where)
                except AnalysisException:  # it speaks of the other side too
                    continue
            chosen = [*sides[:i], rows.where(where), *sides[i + 1 :]]
            return lambda branch: self.partnered(chosen, branch)
        return None

    def partnered(self, sides: Sequence[DataFrame], branch: int) -> DataFrame:
        """The rows of one side that have a partner on the other."""
        best, meets = ((F.max(self.high), self.low < F.col("__best")), (F.min(self.low), F.col("__best") < self.high))[branch]
        named = [F.col(k[1 - branch]).alias(f"__on{i}") for i, k in enumerate(self.keys)]
        told = self.keys_of(sides[1 - branch].groupBy(*named).agg(best.alias("__best")))
        for i, k in enumerate(self.keys):
            meets = (F.col(k[branch]) == F.col(f"__on{i}")) & meets
        return sides[branch].join(told, meets, "left_semi")


def less_join(left: Traced, right: Traced, low: Column, high: Column, on: Sequence[tuple[str, str]] = ()) -> Traced:
    """Pairs of ``left`` and ``right`` with low < high, as Spark compares them, and equal keys.

    ``low`` is of the left side, ``high`` of the right; ``on`` has pairs of a left and a right
    column. Column names of both sides must differ.
    """
    meets = low < high
    for own, other in on:
        meets = (F.col(own) == F.col(other)) & meets
    joined = left.join(right, meets)
    level = Less(joined.level.parents, joined.level.joined, joined.level.how, granularity=left.granularity, low=low, high=high, keys=list(on))
    return left._opened(joined.df, level)


def seconds(df: DataFrame, name: str) -> Column:
    """A number that rises with the time: seconds, or the number itself. Times without a zone are taken as they stand."""
    kind, at = df.schema[name].dataType.simpleString(), F.col(name)
    if kind == "timestamp":
        return F.unix_micros(at) / 1e6
    if kind == "timestamp_ntz":
        return F.datediff(at, F.lit("1970-01-01").cast("date")) * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.unix_date(at) * 86400 if kind == "date" else at


def asof_join(left: Traced, right: Traced, left_at: str, right_at: str, by: Sequence[str] = (), forward: bool = False, strict: bool = False, ties: Sequence[str] = (), every: float | None = None, how: str = "left") -> Traced:
    """Each left row with the last right row at or before its time, or with ``forward`` the first at or after it.

    Rows meet within equal ``by``. ``strict`` leaves out equal times. Of right rows at one time the
    one with the largest ``ties``, then the largest id, counts (with ``forward`` the smallest). A left
    row without a partner has nulls, or is left out if ``how`` is "inner". Null times and keys
    meet nothing. ``every`` cuts time into pieces of so many seconds, or units of a number;
    it spreads hot keys and changes no row. Column names other than ``by`` must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError("an as-of join is inner or left")
    columns, gained = visible(left.df), [c for c in visible(right.df) if c not in by]
    whole, held, tie = F.struct(*(F.col(c) for c in left.df.columns)), F.struct(F.col(ID), *(F.col(c) for c in gained)), F.struct(*(F.col(c) for c in ties), F.col(ID))
    empty = lambda df, column: F.lit(None).cast(df.select(column.alias("x")).schema["x"].dataType)
    complete = lambda at: " and ".join(f"`{c}` is not null" for c in [at, *by])
    piece = lambda df, at: F.floor(seconds(df, at) / every) if every else F.lit(0).cast("long")
    # at equal times a right row passes before the left rows, or behind them if it must not count
    side = F.lit(1 if forward != strict else -1)
    own = left.df.where(complete(left_at)).select(*by, piece(left.df, left_at).alias("__piece"), F.col(left_at).alias("__at"), F.lit(0).alias("__side"), whole.alias("__own"), empty(right.df, held).alias("__held"), empty(right.df, tie).alias("__tie"))
    others = right.df.where(complete(right_at)).select(*by, piece(right.df, right_at).alias("__piece"), F.col(right_at).alias("__at"), side.alias("__side"), empty(left.df, whole).alias("__own"), held.alias("__held"), tie.alias("__tie"))
    both = own.unionByName(others)
    sorted_by = [F.desc(c) if forward else F.asc(c) for c in ("__at", "__side", "__tie")]
    upto = Window.partitionBy(*by, "__piece").orderBy(*sorted_by).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__met", F.last("__held", ignorenulls=True).over(upto)).where("__own is not null")
    if every:
        latest = (F.min_by if forward else F.max_by)("__held", F.when(F.col("__held").isNotNull(), F.struct("__at", "__tie")))
        earlier = Window.partitionBy(*by).orderBy(F.desc("__piece") if forward else F.asc("__piece")).rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*by, "__piece").agg(latest.alias("__latest")).withColumn("__carried", F.last("__latest", ignorenulls=True).over(earlier))
        found = found.join(carried.where("__carried is not null").select(*by, "__piece", "__carried"), [*by, "__piece"], "left").withColumn("__met", F.coalesce("__met", "__carried"))
    made = found.select(F.col("__own"), F.col("__met"))
    if how == "left":
        made = made.unionByName(left.df.where(f"not ({complete(left_at)})").select(whole.alias("__own"), empty(right.df, held).alias("__met")))
    else:
        made = made.where("__met is not null")
    pair = F.struct(F.col("__own")[ID].alias("l"), F.col("__met")[ID].alias("r"))
    rows = made.select(*(F.col("__own")[c].alias(c) for c in columns), *(F.col("__met")[c].alias(c) for c in gained), pair.alias(ID))
    return left._opened(rows, Joined((left, right), rows.select(ID), f"as of {how}", list(by)))
