"""A cursor stands at a level with a set of row ids and walks back to the sources and forth again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ID, distinct_ids, keeping
from ..plans.levels import Level, Source, TraceError

#: Files up to which a source's rows are looked up in these alone.
MOST_FILES = 1000


@dataclass(frozen=True)
class Cursor:
    """``ids`` has one column of distinct ids. ``path`` holds the levels passed and the branches taken.

    ``rows`` are the chosen source rows where a step has met them already, and
    ``behind`` gives an input's rows behind the chosen ones where a condition told them
    without looking for ids: one on a group's key, or on one side of a range join.
    """

    level: Level
    ids: DataFrame
    path: tuple[tuple[Level, int], ...] = ()
    rows: DataFrame | None = None
    behind: Callable[[int], DataFrame | None] | None = None

    @property
    def at_scan(self) -> bool:
        return isinstance(self.level, Source)

    def collect_ids(self) -> list:
        return [r[0] for r in self.ids.collect()]

    def go_back(self, branch: int = 0) -> Cursor:
        """One level towards the sources; ``branch`` chooses a join's or union's input."""
        if self.at_scan:
            raise TraceError("the cursor is at a source already")
        if not 0 <= branch < len(self.level.parents):
            raise TraceError(f"this level has {len(self.level.parents)} inputs")
        parent, path = self.level.parents[branch], (*self.path, (self.level, branch))
        found = self.behind(branch) if self.behind is not None else self.level.rows_back(self.ids, branch) if parent.shows_source else None
        if found is None:
            return Cursor(parent.level, self.level.back(self.ids, branch), path)
        # all of the parent's rows: what stands behind them may be told without their ids too
        behind = parent.level.behind(found, None) if found is parent.df else None
        return Cursor(parent.level, distinct_ids(found), path, found if parent.shows_source else None, behind)

    def go_next(self) -> Cursor:
        """One level towards the result, along the branch last taken."""
        if not self.path:
            raise TraceError("the cursor is at the result already")
        level, branch = self.path[-1]
        return Cursor(level, level.forth(self.ids, branch), self.path[:-1])

    def go_back_all(self, branch: int = 0) -> Cursor:
        """Back to a source; at each level the given branch, or the first where there is only one."""
        at = self
        while not at.at_scan:
            at = at.go_back(branch if branch < len(at.level.parents) else 0)
        return at

    def go_next_all(self) -> Cursor:
        at = self
        while at.path:
            at = at.go_next()
        return at

    def where(self, predicate) -> Cursor:
        """Only those of the level's rows for which the predicate holds."""
        rows = self._rows().where(predicate)
        return Cursor(self.level, rows.select(ID).distinct(), self.path)

    def intersection(self, other: Cursor) -> Cursor:
        """The ids that both cursors hold; they must stand at the same level."""
        if other.level is not self.level:
            raise TraceError("the cursors stand at different levels")
        return Cursor(self.level, self.ids.intersect(other.ids), self.path)

    def _rows(self, pruned: bool = False) -> DataFrame:
        if self.level.rows is None:
            raise TraceError("this level's rows are not known")
        if self.rows is not None:
            return self.rows.select(self.level.rows.columns)
        if pruned and self.at_scan and self.level.cut:
            files = [r[0] for r in self.ids.select(f"{ID}.file").distinct().limit(MOST_FILES + 1).collect()]
            if len(files) <= MOST_FILES:
                return keeping(self.level.cut(files), F.col(ID), self.ids)
        return keeping(self.level.rows, F.col(ID), self.ids)

    def show(self, *columns: str, pruned: bool = False) -> DataFrame:
        """The rows at which the cursor stands, whole or cut to some columns: a source's, or those of a level between.

        ``pruned`` asks first in which files of a source the rows lie, and reads only these; of
        use where the ids cost little, as from an index, and lie in few files.
        """
        rows = self._rows(pruned).drop(ID)
        return rows.select(*columns) if columns else rows

    def show_json(self, *columns: str) -> DataFrame:
        """The rows as one JSON text each."""
        return self.show(*columns).select(F.to_json(F.struct("*")).alias("json"))

    def all_sources(self) -> list[tuple[str, DataFrame]]:
        """(name, source rows) for each source below, over every branch."""
        if self.at_scan:
            return [(self.level.name, self.show())]
        return [found for i in range(len(self.level.parents)) for found in self.go_back(i).all_sources()]

    def associations(self, branch: int = 0) -> DataFrame:
        """(output, input): each chosen row of this level with each row of the given input behind it."""
        if self.at_scan:
            raise TraceError("the cursor is at a source already")
        return self.level.associations(self.ids, branch)

    def save_csv(self, path: str) -> None:
        """Write the ids, as JSON, as CSV files in ``path``."""
        self.ids.select(F.to_json(ID).alias("id")).write.option("header", True).csv(path)

    def save_jdbc(self, url: str, table: str, properties: dict | None = None) -> None:
        self.ids.select(F.to_json(ID).alias("id")).write.option("batchsize", 1000).jdbc(url, table, mode="append", properties=properties or {})

    def save_associations_csv(self, path: str, branch: int = 0) -> None:
        """Write the pairs of output and input ids, as JSON, as CSV files in ``path``."""
        self._json_pairs(branch).write.option("header", True).csv(path)

    def save_associations_jdbc(self, url: str, table: str, branch: int = 0, properties: dict | None = None) -> None:
        self._json_pairs(branch).write.option("batchsize", 1000).jdbc(url, table, mode="append", properties=properties or {})

    def _json_pairs(self, branch: int) -> DataFrame:
        return self.associations(branch).select(F.to_json("output").alias("output"), F.to_json("input").alias("input"))
