"""The re-execution oracle: witnesses alone must give the result row again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ID, keeping
from ..operators.traced import Traced
from ..plans.levels import Source
from ..session import RowTrail

Query = Callable[[dict[str, Traced]], Traced]


def witnesses(sources: dict[str, Traced], output: Traced, where: str | Column | None) -> dict[str, DataFrame]:
    """For each source the rows, with ids, behind the chosen output rows (or all), over all paths."""
    from ..faults.isolate import cursors_at

    found = {}
    for name, source in sources.items():
        paths = cursors_at(output.trace(where), source.level)
        # rows that a step has met already are looked up no more
        parts = [keeping(source.df, F.col(ID), at.ids) if at.rows is None else at.rows.select(source.df.columns) for at in paths]
        rows = reduce(DataFrame.union, parts) if parts else source.df.where(F.lit(False))
        found[name] = rows.dropDuplicates([ID]) if len(parts) > 1 else rows
    return found


def recalled(trail: RowTrail, sources: dict[str, Traced], query: Query, where: str | Column | None) -> DataFrame:
    """Run ``query`` again with each source cut to its witnesses, and return the chosen rows (or all)."""
    cut = witnesses(sources, query(sources), where)
    again = {n: Traced(rows, Source((), n, rows=rows), sources[n].granularity) for n, rows in cut.items()}
    result = query(again).result
    return result if where is None else result.where(where)


def recall_holds(trail: RowTrail, sources: dict[str, Traced], query: Query, where: str | Column | None) -> bool:
    """Whether every chosen row reappears from its witnesses."""
    want = query(sources).result if where is None else query(sources).result.where(where)
    return want.exceptAll(recalled(trail, sources, query, where)).isEmpty()


def leave_one_out(trail: RowTrail, sources: dict[str, Traced], query: Query, where: str | Column, source: str) -> bool:
    """Whether the chosen rows change when the least witness of one source is left out."""
    cut = witnesses(sources, query(sources), where)
    least = cut[source].select(F.min(ID).alias(ID))
    cut[source] = cut[source].join(least.withColumnRenamed(ID, "__least"), F.col(ID) == F.col("__least"), "left_anti")
    again = {n: Traced(rows, Source((), n, rows=rows), sources[n].granularity) for n, rows in cut.items()}
    return not query(sources).result.where(where).exceptAll(query(again).result.where(where)).isEmpty()
