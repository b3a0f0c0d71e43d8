"""Fault isolation: from a wrong output row to the fewest input rows that cause it.

The wrong rows are traced to their sources. The candidates stay distributed: each
row carries the number of a bucket, and delta debugging runs over these numbers, so
the driver never sees a row. Several parts are tried in one job. Rows are dealt
anew, into more buckets where every bucket is needed, until each has one of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ID, keeping
from ..operators.cursor import Cursor
from ..operators.traced import Traced
from ..plans.levels import Level, Source
from ..session import RowTrail
from ..sources.scratch import written
from .ddmin import Part, remembering, smallest
from .parted import Parted, fits

BUCKETS, MOST_BUCKETS = 64, 4096
#: So few candidates get a bucket each.
FEW = 256
#: Parts that one job tries.
AT_ONCE = 8
#: Different numbers of faulty rows reached that are looked at.
MOST_RANKS = 1000


@dataclass
class Isolated:
    """``culprits``: the rows that cause the fault; ``faulty``: the wrong output rows, ``n_faulty`` of them.

    ``minimal`` is false if a cause needs so many rows together that it was not
    taken apart row by row; ``culprits`` then fail, but some may not be needed.
    """

    culprits: DataFrame
    faulty: DataFrame
    n_faulty: int
    provenance_size: int
    runs: int
    minimal: bool = True


def members(dealt: DataFrame, parts: list[Part]) -> DataFrame:
    """The rows of each part, with its number: a small table tells which parts a bucket is in."""
    of: dict[int, list[int]] = {}
    for number, part in enumerate(parts):
        for bucket in part:
            of.setdefault(bucket, []).append(number)
    # at most as many rows as there are buckets
    table = dealt.sparkSession.createDataFrame(list(of.items()), "__bucket int, __parts array<int>")
    return dealt.join(F.broadcast(table), "__bucket").withColumn("__part", F.explode("__parts")).drop("__bucket", "__parts")


def chosen(dealt: DataFrame, part: Part) -> DataFrame:
    return members(dealt, [part]).drop("__part")


class Trials:
    """Tries parts of an input, each a set of buckets: whether some output row of each is faulty.

    ``runs`` counts how often the query was run.
    """

    at_once = False  #: whether any number of parts without common buckets is tried in one run

    def __init__(self, faulty_rows: Callable[[DataFrame], DataFrame]):
        self.faulty_rows, self.runs = faulty_rows, 0

    def fail(self, dealt: DataFrame, parts: list[Part]) -> list[bool]:
        """One job for all parts."""
        self.runs += len(parts)
        each = [self.faulty_rows(chosen(dealt, part)).limit(1).select(F.lit(i).alias("part")) for i, part in enumerate(parts)]
        hit = {r.part for r in reduce(DataFrame.union, each).collect()}  # a number for each part at most
        return [i in hit for i in range(len(parts))]

    def fails(self, rows: DataFrame) -> bool:
        self.runs += 1
        return not self.faulty_rows(rows).isEmpty()


class PartedTrials(Trials):
    """The same in one run of the query over all parts, for queries that keep parts apart."""

    def __init__(self, faulty_rows: Callable[[DataFrame], DataFrame], query: Callable, test: Column):
        super().__init__(faulty_rows)
        self.query, self.test = query, test

    at_once = True

    def fail(self, dealt: DataFrame, parts: list[Part]) -> list[bool]:
        self.runs += 1
        rows = members(dealt.drop(ID), parts).withColumnRenamed("__part", ID)
        hit = {r[0] for r in self.query(Parted(rows)).df.where(self.test).select(ID).distinct().collect()}
        return [i in hit for i in range(len(parts))]


class ViewTrials(Trials):
    """The same for SQL text over a view, which holds one part at a time."""

    def fail(self, dealt: DataFrame, parts: list[Part]) -> list[bool]:
        return [self.fails(chosen(dealt, part)) for part in parts]


def minimised(rows: DataFrame, trials: Trials, on_progress: Callable[[int], None] | None = None) -> tuple[DataFrame, bool]:
    """The 1-minimal part of ``rows`` (with ids) that fails, and whether it is known to be minimal."""
    size, round_, buckets = rows.count(), 0, BUCKETS
    while True:
        alone = size <= FEW
        if alone:  # few rows, so one window over all of them is small
            number, count = F.row_number().over(Window.orderBy(ID)) - 1, size
        else:
            number, count = F.pmod(F.xxhash64(F.lit(round_), ID), F.lit(buckets)), buckets
        dealt = written(rows.withColumn("__bucket", number.cast("int")), "candidates")
        failing = trials.fail(dealt, [(i,) for i in range(count)]) if trials.at_once else [False]
        if any(failing):  # one bucket does it alone
            kept = (failing.index(True),)
            if on_progress and alone:
                on_progress(1)
        else:
            first = remembering(lambda parts, of=dealt: trials.fail(of, parts), AT_ONCE)
            kept = smallest(count, first, on_progress if alone else None)
        rows = chosen(dealt, kept)
        if alone:
            return rows.drop(ID), True
        left, round_ = rows.count(), round_ + 1
        if on_progress:
            on_progress(left)
        if left > size // 2:  # most buckets are needed
            if buckets >= MOST_BUCKETS:
                return rows.drop(ID), False
            buckets *= 8
        size = left


def isolate_frame(trail: RowTrail, base: Traced, query: Callable[[Traced], Traced], test: Column, on_progress: Callable[[int], None] | None = None, ranked: bool = True) -> Isolated:
    """The rows of ``base`` that make ``test`` true for some output row of ``query``.

    All branches that lead to ``base`` count. If the witnesses alone do not fail,
    the whole table is searched. Without a faulty row nothing is a culprit. Where several
    output rows are faulty, rows that reach most of them are searched first, unless
    ``ranked`` is false. A query of joins, unions, groups, windows and narrow operators
    tries several parts in one scan.
    """
    faulty_rows = lambda rows: query(Traced(rows, Source((), "part", rows=rows), base.granularity)).result.where(test)
    trials = PartedTrials(faulty_rows, query, test) if fits(query, base.df) else Trials(faulty_rows)
    output = query(base)
    faulty = written(output.result.where(test), "faulty")
    n = faulty.count()
    if not n:
        return Isolated(base.result.limit(0), faulty, 0, 0, 0)
    witnesses = None
    for ids in reaching(output.trace(test), base.level):
        witnesses = ids if witnesses is None else witnesses.union(ids)
    candidates = written(keeping(base.df, F.col(ID), witnesses.distinct()), "witnesses") if witnesses is not None else base.df
    size = candidates.count()
    if witnesses is not None and not trials.fails(candidates):
        candidates = base.df
    elif witnesses is not None and n > 1 and ranked:
        candidates = reaching_most(candidates, output.trace(test), base.level, trials)
    culprits, minimal = minimised(candidates, trials, on_progress)
    return Isolated(culprits, faulty, n, size, trials.runs, minimal)


def reaching_most(candidates: DataFrame, cursor: Cursor, level: Level, trials: Trials) -> DataFrame:
    """Of the candidates those that reach so many faulty output rows that they fail by themselves, or all.

    Rows are ranked by the number of faulty rows they reach. The ranks are tried from the
    highest down, with each step as many again as before.
    """
    found = reduce(DataFrame.union, pairs_reaching(cursor.ids.select(F.col(ID).alias("faulty"), ID), cursor.level, level))
    reach = written(found.groupBy(ID).agg(F.count_distinct("faulty").alias("__reach")), "reach")
    ranks = [r[0] for r in reach.select("__reach").distinct().orderBy(F.desc("__reach")).limit(MOST_RANKS).collect()]
    step = 1
    while step < len(ranks):
        most = candidates.join(reach.where(F.col("__reach") >= ranks[step - 1]).select(F.col(ID).alias("__most")), F.col(ID) == F.col("__most"), "left_semi")
        if trials.fails(most):
            return written(most, "reaching-most")
        step *= 2
    return candidates


def pairs_reaching(pairs: DataFrame, at: Level, level: Level) -> list[DataFrame]:
    """(faulty, id) at ``level`` over every path that leads there, from pairs at another level."""
    if at is level:
        return [pairs]
    found = []
    for branch, parent in enumerate(at.parents):
        steps = at.associations(pairs.select(ID).distinct(), branch)
        below = pairs.join(steps, F.col(ID) == F.col("output")).select("faulty", F.col("input").alias(ID)).distinct()
        found += pairs_reaching(below, parent.level, level)
    return found


def reaching(cursor, level) -> list[DataFrame]:
    """The ids at ``level`` over every path that leads there."""
    return [at.ids for at in cursors_at(cursor, level)]


def cursors_at(cursor, level) -> list[Cursor]:
    """The cursor at ``level`` at the end of every path that leads there."""
    if cursor.level is level:
        return [cursor]
    # a step may ask for the number of its keys, so no other path is walked
    leading = [i for i, p in enumerate(cursor.level.parents) if leads_to(p.level, level)]
    return [found for i in leading for found in cursors_at(cursor.go_back(i), level)]


def leads_to(at: Level, level: Level) -> bool:
    return at is level or any(leads_to(p.level, level) for p in at.parents)


def isolate_sql(trail: RowTrail, table: str, base: DataFrame, sql: str, test: Column, on_progress: Callable[[int], None] | None = None, witnesses: str | Column | None = None) -> Isolated:
    """The same for SQL text over the temporary view ``table``.

    SQL text is not traced: the search starts from the rows for which ``witnesses``
    holds, if these fail, or else from the whole table. The view is put back at the
    end.
    """
    spark, rows = trail.spark, trail.frame(base, table).df

    def faulty_rows(part: DataFrame) -> DataFrame:
        part.drop(ID).createOrReplaceTempView(table)
        return spark.sql(sql).where(test)

    trials = ViewTrials(faulty_rows)
    try:
        base.createOrReplaceTempView(table)
        faulty = written(spark.sql(sql).where(test), "faulty")
        n = faulty.count()
        if not n:
            return Isolated(base.limit(0), faulty, 0, 0, 0)
        candidates = rows if witnesses is None else rows.where(witnesses)
        size = candidates.count()
        if witnesses is not None and not trials.fails(candidates):
            candidates = rows
        culprits, minimal = minimised(candidates, trials, on_progress)
        return Isolated(culprits, faulty, n, size, trials.runs, minimal)
    finally:
        base.createOrReplaceTempView(table)
