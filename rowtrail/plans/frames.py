"""Windows whose witnesses are the rows of the frame.

Every row of a window partition has a position: its number (ROWS), the rank of its
sort values (RANGE up to peers), or the sort value itself (RANGE by offsets). A frame is
an interval of positions around the row's own. Which rows lie in any of the chosen
frames is found by one sweep over a partition: frames open and close at their ends, and a
row is a witness while some frame is open. So a trace sorts the partitions that it needs
once, whatever the number and length of the frames.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ids import ID, keeping, key_struct
from .levels import Level

PRECEDING, FOLLOWING = Window.unboundedPreceding, Window.unboundedFollowing
#: Order of what meets at one position: frames open, rows pass, frames close.
OPEN, ROW, CLOSE = 0, 1, 2
#: Order of positions: before all, nulls, values, after all.
FIRST, NULLS, VALUES, LAST = 0, 1, 2, 3


@dataclass(frozen=True)
class Frame:
    """ROWS or RANGE BETWEEN start AND end; bounds as in Spark's rowsBetween and rangeBetween.

    With offsets, RANGE needs one sort column; ``descending`` says that the window sorts it so.
    """

    kind: str
    start: int = PRECEDING
    end: int = 0
    descending: bool = False

    @property
    def by_value(self) -> bool:
        return self.kind == "range" and any(b not in (PRECEDING, FOLLOWING, 0) for b in (self.start, self.end))

    def windows(self, keys: Sequence[Column], order_by: Sequence[str | Column]) -> tuple[WindowSpec, WindowSpec]:
        """The ordered window without and with the frame. Rows with equal sort values are told apart by their ids in ROWS frames."""
        order = [c.desc() if self.descending else c for c in (F.col(c) if isinstance(c, str) else c for c in order_by)]
        if self.by_value and len(order) != 1:
            raise ValueError("a RANGE frame with offsets has one sort column")
        window = Window.partitionBy(*keys).orderBy(*order, *([ID] if self.kind == "rows" else []))
        return window, window.rowsBetween(self.start, self.end) if self.kind == "rows" else window.rangeBetween(self.start, self.end)

    def position(self, window: WindowSpec, order_by: Sequence[str | Column]) -> Column:
        if self.kind == "rows":
            return F.row_number().over(window)
        if not self.by_value:
            return F.dense_rank().over(window)
        value = F.col(order_by[0]) if isinstance(order_by[0], str) else order_by[0]
        return -value if self.descending else value


def rows_frame(start: int = PRECEDING, end: int = 0) -> Frame:
    return Frame("rows", start, end)


def range_frame(start: int = PRECEDING, end: int = 0, descending: bool = False) -> Frame:
    return Frame("range", start, end, descending)


@dataclass(eq=False)
class Framed(Level):
    """A window: behind a row stand the rows of its frame, and the row itself, whose columns it keeps.

    An id has the partition's key, the position and the row's own id.
    """

    keys: Sequence[Column] = ()
    order_by: Sequence[str | Column] = ()
    frame: Frame = Frame("rows")

    def placed(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, at, own) of the parent's rows, or of those in the given partitions."""
        rows = self.parents[0].df.withColumn("__key", key_struct(self.keys))
        if keys is not None:
            rows = keeping(rows, F.col("__key"), keys)
        window, _ = self.frame.windows([F.col("__key")], self.order_by)
        return rows.select(F.col("__key").alias("key"), self.frame.position(window, self.order_by).alias("at"), F.col(ID).alias("own"))

    def ends(self, backwards: bool) -> tuple[Column, Column]:
        """Where the frame around a row opens and closes, or where those open and close that hold it."""
        start, end = (self.frame.start, self.frame.end) if not backwards else (-self.frame.end, -self.frame.start)

        def bound(offset: int, phase: int) -> Column:
            null = F.when(F.lit(False), F.col("at"))
            if abs(offset) >= FOLLOWING:
                return F.struct(F.lit(FIRST if offset < 0 else LAST).alias("area"), null.alias("at"), F.lit(phase).alias("phase"))
            moved = F.col("at") + F.lit(offset) if offset else F.col("at")
            return F.struct(F.when(F.col("at").isNull(), NULLS).otherwise(VALUES).alias("area"), moved.alias("at"), F.lit(phase).alias("phase"))

        return bound(start, OPEN), bound(end, CLOSE)

    def swept(self, wanted: DataFrame, rows: DataFrame, backwards: bool) -> DataFrame:
        """Events of the frames around ``wanted`` (key, at, own), and ``rows``, in one table."""
        opens, closes = self.ends(backwards)
        nobody = F.when(F.lit(False), F.col("own"))
        event = lambda place, step: F.struct(place.alias("place"), F.lit(step).alias("step"))
        events = wanted.select("key", F.col("own").alias("of"), F.explode(F.array(event(opens, 1), event(closes, -1))).alias("e"), nobody.alias("own"))
        here = F.struct(F.when(F.col("at").isNull(), NULLS).otherwise(VALUES).alias("area"), F.col("at"), F.lit(ROW).alias("phase"))
        passing = rows.select("key", nobody.alias("of"), event(here, 0).alias("e"), "own")
        return events.select("key", "of", "e.place", "e.step", "own").unionByName(passing.select("key", "of", "e.place", "e.step", "own"))

    def covered(self, wanted: DataFrame, backwards: bool) -> DataFrame:
        """(key, at, own) of the rows in a frame around one of ``wanted``, and these themselves."""
        rows = self.placed(wanted.select(F.col("key").alias(ID)).distinct())
        upto = Window.partitionBy("key").orderBy("place").rowsBetween(PRECEDING, 0)
        met = self.swept(wanted, rows, backwards).withColumn("open", F.sum("step").over(upto)).where("own is not null and open > 0")
        return met.select("key", F.col("place.at").alias("at"), "own").unionByName(wanted.select("key", "at", "own")).distinct()

    def back(self, ids: DataFrame, branch: int) -> DataFrame:
        return self.covered(ids.select(f"{ID}.*"), False).select(F.col("own").alias(ID)).distinct()

    def forth(self, ids: DataFrame, branch: int) -> DataFrame:
        met = keeping(self.parents[0].df.withColumn("__key", key_struct(self.keys)), F.col(ID), ids)
        wanted = keeping(self.placed(met.select(F.col("__key").alias(ID)).distinct()), F.col("own"), ids)
        return self.covered(wanted, True).select(F.struct("key", "at", "own").alias(ID)).distinct()

    def associations(self, ids: DataFrame, branch: int) -> DataFrame:
        """Each frame's first and last row number, from counts of the rows passed, and the rows between."""
        wanted = ids.select(f"{ID}.*")
        rows = self.placed(wanted.select(F.col("key").alias(ID)).distinct())
        upto = Window.partitionBy("key").orderBy("place", "own").rowsBetween(PRECEDING, 0)
        swept = self.swept(wanted, rows, False).withColumn("passed", F.count("own").over(upto))
        numbered = swept.where("own is not null").select("key", F.col("passed").alias("number"), "own")
        limits = swept.where("own is null").groupBy("key", "of").agg(F.max(F.when(F.col("step") == 1, F.col("passed") + 1)).alias("first"), F.max(F.when(F.col("step") == -1, F.col("passed"))).alias("last"))
        each = limits.where("first <= last").withColumn("number", F.explode(F.sequence("first", "last")))
        pairs = each.join(numbered, ["key", "number"]).select("of", F.col("own").alias("input"))
        pairs = pairs.unionByName(wanted.select(F.col("own").alias("of"), F.col("own").alias("input"))).distinct()
        outputs = ids.select(F.col(ID).alias("output"), F.col(f"{ID}.own").alias("of"))
        return pairs.join(outputs, "of").select("output", "input")

    def describe(self) -> str:
        return f"window {self.frame.kind}"


def opened(parent, keys: Sequence[Column], order_by: Sequence[str | Column], frame: Frame, columns: dict) -> tuple[DataFrame, Framed]:
    """The rows with the window columns and ids, and their level."""
    window, framed = frame.windows(keys, order_by)
    # lag, lead and the rankings take the window without a frame
    made = {n: c.over(framed) if isinstance(c, Column) else c(window) for n, c in columns.items()}
    df = parent.df.withColumns(made | {"__at": frame.position(window, order_by)})
    df = df.withColumn(ID, F.struct(key_struct(keys).alias("key"), F.col("__at").alias("at"), F.col(ID).alias("own"))).drop("__at")
    return df, Framed((parent,), keys, order_by, frame)

