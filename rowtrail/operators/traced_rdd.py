"""Provenance for RDD pipelines, for code that cannot be a DataFrame.

Records travel as (id, value). As with traced frames, a shuffle opens a level whose
ids are the keys themselves, and a step back or forth is a semi-join. Few ids are sent to
all tasks; with many, both sides are dealt to as many tasks as their number asks for, so
what a task's Python holds does not grow with the input. A step back to a source takes the
source's own records along, where map and filter alone lie between.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

from pyspark import RDD, SparkContext
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import hot_keys
from ..plans.levels import TraceError, UnsupportedOperatorError


#: About how many records a task gets where they are dealt to tasks.
RECORDS = 100_000
#: Ids up to which a step sends them to all tasks instead of dealing records by id.
FEW_IDS = 10_000
#: Records up to which a join sends a side to all tasks; their values may be long.
FEW_RECORDS = 1_000


def tasks_for(size: int | None, *rdds: RDD) -> int:
    """How many tasks to deal ``size`` records to: no fewer than one of the RDDs has."""
    return max(1, -(-(size or 0) // RECORDS), *(r.getNumPartitions() for r in rdds))


@dataclass(frozen=True)
class RddCursor:
    """``rdd`` at the cursor's level, the ids chosen there (an RDD of distinct ids) and the way taken.

    ``rows`` are the chosen (id, record) of a source, where a step has met them already.
    """

    at: TracedRDD
    ids: RDD
    path: tuple[tuple[TracedRDD, int], ...] = ()
    rows: RDD | None = None

    @property
    def at_source(self) -> bool:
        return not self.at.parents

    def show(self) -> RDD:
        """The records with the chosen ids; also at levels between result and source."""
        return among(self.at.rdd, self.ids, self.at.size).values()

    def show_source(self) -> RDD:
        """The source's own records, as they were before any narrow operator."""
        if not self.at_source:
            raise TraceError("only at a source")
        return (among(self.at.root.rdd, self.ids, self.at.size) if self.rows is None else self.rows).values()

    def filter(self, predicate: Callable[[Any], bool]) -> RddCursor:
        """Only those chosen records for which the predicate holds."""
        kept = among(self.at.rdd, self.ids, self.at.size).filter(lambda r: predicate(r[1])).keys().distinct(self.at.tasks)
        return RddCursor(self.at, kept, self.path)

    def go_back(self, branch: int = 0) -> RddCursor:
        if self.at_source:
            raise TraceError("the cursor is at a source already")
        parent = self.at.parents[branch]
        path = (*self.path, (self.at, branch))
        rows_link = self.at.rows_link(branch) if self.at.rows_link and not parent.parents else None
        if rows_link is not None:
            rows = among(rows_link, self.ids, parent.size).values()
            return RddCursor(parent, rows.keys(), path, rows)
        links = self.at.links(branch)  # (own id, parent's id)
        return RddCursor(parent, among(links, self.ids, parent.size).values().distinct(parent.tasks), path)

    def go_next(self) -> RddCursor:
        if not self.path:
            raise TraceError("the cursor is at the result already")
        at, branch = self.path[-1]
        flipped = at.links(branch).map(lambda x: (x[1], x[0]))
        return RddCursor(at, among(flipped, self.ids, self.at.size).values().distinct(self.at.tasks), self.path[:-1])

    def go_back_all(self, branch: int = 0, times: int | None = None) -> RddCursor:
        """Back to a source, or at most ``times`` steps; at each level the given branch, or the first where there is only one."""
        at = self
        while not at.at_source and (times is None or times > 0):
            at = at.go_back(branch if branch < len(at.at.parents) else 0)
            times = None if times is None else times - 1
        return at

    def go_next_all(self, times: int | None = None) -> RddCursor:
        """To the result, or at most ``times`` steps towards it."""
        at = self
        while at.path and (times is None or times > 0):
            at = at.go_next()
            times = None if times is None else times - 1
        return at

    def get_back(self, branch: int = 0) -> RddCursor:
        """The parent's place with all its records: a step back without looking for the chosen ones."""
        if self.at_source:
            raise TraceError("the cursor is at a source already")
        parent = self.at.parents[branch]
        return RddCursor(parent, parent.rdd.keys().distinct(parent.tasks), (*self.path, (self.at, branch)))

    def associations(self, branch: int = 0) -> RDD:
        """(own id, parent's id) for the chosen records."""
        return among(self.at.links(branch), self.ids, self.at.parents[branch].size)

    def intersection(self, other: RddCursor) -> RddCursor:
        if other.at is not self.at:
            raise TraceError("the cursors stand at different levels")
        return RddCursor(self.at, self.ids.intersection(other.ids), self.path)


def among(pairs: RDD, ids: RDD, size: int | None = None) -> RDD:
    """The pairs, about ``size``, whose key is among the ids, which are distinct.

    If the ids are few, which a job over no more of them tells, all tasks get them and the
    pairs stay where they are. Else both are dealt and sorted by the key's hash, ids first, so a task holds the ids of one
    hash and never the pairs, however many share a key.
    """
    known = ids.take(FEW_IDS + 1)
    if len(known) <= FEW_IDS:
        held = pairs.context.broadcast(frozenset(known))

        def kept(records) -> Iterator[tuple]:
            chosen = held.value
            return (p for p in records if p[0] in chosen)

        return pairs.mapPartitions(kept)
    asked = ids.map(lambda i: ((portable_hash(i), 0), (i, None)))
    dealt = asked.union(pairs.map(lambda p: ((portable_hash(p[0]), 1), p)))

    def swept(records) -> Iterator[tuple]:
        at, chosen = None, set()
        for (number, turn), (key, value) in records:
            if number != at:
                at, chosen = number, set()
            if turn == 0:
                chosen.add(key)
            elif key in chosen:
                yield key, value

    return dealt.repartitionAndSortWithinPartitions(tasks_for(size, pairs, ids), lambda k: k[0]).mapPartitions(swept)


def met(records, few: dict[Any, list], alone: list, from_left: bool) -> Iterator[tuple]:
    """The pairs of a join of ``records`` with the values of a side of few, by key; ``alone`` stands for no partner."""
    for _, (key, value) in records:
        for other in few.get(key, alone):
            yield key, ((value, other) if from_left else (other, value))


def ids_where(records, predicate: Callable[[Any], bool] | None) -> Iterator[Any]:
    """The ids of the records for which the predicate holds; of those met first, each only once."""
    found: set = set()
    for i, value in records:
        if i not in found and (predicate is None or predicate(value)):
            if len(found) < FEW_IDS:
                found.add(i)
            yield i


def paired(f: Callable, records) -> Iterator[tuple]:
    """(id, new value) in order; holds the ids of those records alone that ``f`` has taken and not answered yet."""
    records, waiting = iter(records), deque()

    def values():
        for i, value in records:
            waiting.append(i)
            yield value

    for value in f(values()):
        if not waiting:
            raise ValueError("more records came out than went in")
        yield waiting.popleft(), value
    if waiting or next(records, None) is not None:
        raise ValueError("fewer records came out than went in")


@dataclass(frozen=True, eq=False)
class TracedRDD:
    """``rdd`` holds (id, value). ``parents`` are empty at a source; ``link`` gives (own id, parent's id) pairs.

    ``root`` is the source or level from which narrow operators made this one. ``size`` is about
    how many records there are, where a source has told it; it changes the balance alone.
    """

    rdd: RDD
    parents: tuple[TracedRDD, ...] = ()
    link: Callable[[int], RDD] | None = None
    origin: TracedRDD | None = None
    size: int | None = None
    seen: RDD | None = None  #: see ``with_source``
    rows_link: Callable[[int], RDD | None] | None = None  #: (own id, (parent's id, source's record)), if the parent is ``with_source``

    @property
    def tasks(self) -> int:
        return tasks_for(self.size, self.rdd)

    @property
    def with_source(self) -> RDD | None:
        """(id, (value, the source's record)), each id once; None unless a source is followed by map and filter alone."""
        if self.seen is None and not self.parents and self.origin is None:
            return self.rdd.mapValues(lambda v: (v, v))
        return self.seen

    @property
    def root(self) -> TracedRDD:
        return self.origin or self

    def links(self, branch: int) -> RDD:
        return self.link(branch)

    # sources

    @staticmethod
    def text_file(sc: SparkContext, path: str, partitions: int | None = None) -> TracedRDD:
        return TracedRDD.of(sc.textFile(path, partitions))

    @staticmethod
    def parallelize(sc: SparkContext, values: list, slices: int | None = None) -> TracedRDD:
        return TracedRDD.of(sc.parallelize(values, slices))

    @staticmethod
    def hadoop_file(sc: SparkContext, path: str, input_format: str, key_class: str, value_class: str) -> TracedRDD:
        return TracedRDD.of(sc.hadoopFile(path, input_format, key_class, value_class))

    @staticmethod
    def of(rdd: RDD) -> TracedRDD:
        """Any RDD that gives the same records in the same order each time; the place is the id."""
        counts = rdd.mapPartitions(lambda records: [sum(1 for _ in records)]).collect()
        starts = [0, *accumulate(counts)]
        return TracedRDD(rdd.mapPartitionsWithIndex(lambda number, records: enumerate(records, starts[number])), size=starts[-1])

    @staticmethod
    def of_frame(df: DataFrame) -> TracedRDD:
        """The rows of a DataFrame as tuples, which come in the same order each time; Spark numbers them.

        Files that have few splits for their rows are dealt to more tasks, with their numbers; so are files whose
        rows lie in few of their splits, as splits go by size and a row group is read by one of them.
        """
        size, most = df.groupBy(F.spark_partition_id().alias("__split")).count().agg(F.sum("count"), F.max("count")).first()
        size, numbered = size or 0, df.select(F.monotonically_increasing_id().alias("__id"), "*")
        tasks = tasks_for(size)
        if tasks > df.rdd.getNumPartitions() or (most or 0) > 2 * RECORDS:
            numbered = numbered.repartition(tasks, "__id")
        return TracedRDD(numbered.rdd.mapPartitions(lambda rows: ((i, tuple(values)) for i, *values in rows)), size=size)

    # narrow: ids pass through

    def _same(self, rdd: RDD, seen: RDD | None = None) -> TracedRDD:
        return TracedRDD(rdd, self.parents, self.link, self.root, self.size, seen, self.rows_link)

    def map(self, f: Callable) -> TracedRDD:
        seen = self.with_source
        return self._same(self.rdd.mapValues(f), seen and seen.mapValues(lambda v: (f(v[0]), v[1])))

    def flat_map(self, f: Callable) -> TracedRDD:
        return self._same(self.rdd.flatMapValues(f))

    def filter(self, f: Callable) -> TracedRDD:
        seen = self.with_source
        return self._same(self.rdd.filter(lambda r: f(r[1])), seen and seen.filter(lambda r: f(r[1][0])))

    def key_by(self, f: Callable) -> TracedRDD:
        return self.map(lambda v: (f(v), v))

    def keys(self) -> TracedRDD:
        return self.map(lambda v: v[0])

    def values(self) -> TracedRDD:
        return self.map(lambda v: v[1])

    def map_values(self, f: Callable) -> TracedRDD:
        return self.map(lambda v: (v[0], f(v[1])))

    def flat_map_values(self, f: Callable) -> TracedRDD:
        return self.flat_map(lambda v: [(v[0], x) for x in f(v[1])])

    def map_partitions(self, f: Callable, one_to_one: bool = False) -> TracedRDD:
        """Opaque; only taken if ``f`` gives one record for each, in order."""
        if not one_to_one:
            raise UnsupportedOperatorError("mapPartitions hides which records it uses; declare one_to_one=True if it keeps their order")
        return self._same(self.rdd.mapPartitions(lambda records: paired(f, records)))

    def map_partitions_with_index(self, f: Callable, one_to_one: bool = False) -> TracedRDD:
        """The same; ``f`` also gets the partition's number."""
        if not one_to_one:
            raise UnsupportedOperatorError("mapPartitionsWithIndex hides which records it uses; declare one_to_one=True if it keeps their order")
        return self._same(self.rdd.mapPartitionsWithIndex(lambda number, records: paired(lambda values: f(number, values), records)))

    def sort_by(self, f: Callable, ascending: bool = True) -> TracedRDD:
        return self._same(self.rdd.sortBy(lambda r: f(r[1]), ascending))

    def sort_by_key(self, ascending: bool = True) -> TracedRDD:
        return self.sort_by(lambda v: v[0], ascending)

    def coalesce(self, n: int) -> TracedRDD:
        return self._same(self.rdd.coalesce(n))

    def repartition_and_sort_within_partitions(self, n: int, ascending: bool = True) -> TracedRDD:
        """Pair records dealt by key to n partitions, sorted by key within each."""
        keyed = self.rdd.map(lambda r: (r[1][0], r)).repartitionAndSortWithinPartitions(n, ascending=ascending)
        return self._same(keyed.values())

    def zip_with_unique_id(self) -> TracedRDD:
        return self._same(self.rdd.zipWithUniqueId().map(lambda x: (x[0][0], (x[0][1], x[1]))))

    def zip(self, *others: TracedRDD) -> TracedRDD:
        """Records at the same place of two or more; the id is the tuple of their ids."""
        inputs, both = (self, *others), self.rdd.map(lambda r: ((r[0],), (r[1],)))
        for x in others:
            both = both.zip(x.rdd).map(lambda p: ((*p[0][0], p[1][0]), (*p[0][1], p[1][1])))
        return TracedRDD(both, inputs, lambda b: both.keys().map(lambda i: (i, i[b])).distinct())

    def zip_partitions(self, f: Callable, *others: TracedRDD) -> TracedRDD:
        """``f`` gets one iterator for each input and gives records; the whole partitions stand behind each of them."""
        inputs = (self, *others)
        numbered = [x.rdd.mapPartitionsWithIndex(lambda n, it: [(n, list(it))]) for x in inputs]
        joined = numbered[0].mapValues(lambda rows: (rows,))
        for x in numbered[1:]:
            joined = joined.zip(x).map(lambda p: (p[0][0], (*p[0][1], p[1][1])))
        out = joined.flatMapValues(lambda parts: f(*(iter([v for _, v in rows]) for rows in parts)))
        return TracedRDD(out, inputs, lambda b: numbered[b].flatMapValues(lambda rows: [i for i, _ in rows]))

    # keyed: one level

    def _keyed(self, result: RDD, *others: TracedRDD) -> TracedRDD:
        """``result`` has (key, value) records of the pair RDDs self and others."""
        inputs = (self, *others)

        def rows_link(branch: int) -> RDD | None:
            source, seen = inputs[branch], inputs[branch].with_source
            if seen is not None and source.seen is None:  # the source itself
                return source.rdd.mapPartitions(lambda records: ((r[1][0], r) for r in records))
            return seen and seen.mapPartitions(lambda records: ((value[0], (i, record)) for i, (value, record) in records))

        keyed = result.mapPartitions(lambda records: ((kv[0], kv) for kv in records))
        return TracedRDD(keyed, inputs, lambda b: inputs[b].rdd.map(lambda r: (r[1][0], r[0])), size=self._size(*others), rows_link=rows_link)

    def _size(self, *others: TracedRDD) -> int:
        return sum(x.size or 0 for x in (self, *others))

    def _pairs(self) -> RDD:
        return self.rdd.values()

    def reduce_by_key(self, f: Callable) -> TracedRDD:
        return self._keyed(self._pairs().reduceByKey(f, self.tasks))

    def aggregate_by_key(self, zero, seq: Callable, comb: Callable) -> TracedRDD:
        return self._keyed(self._pairs().aggregateByKey(zero, seq, comb, self.tasks))

    def combine_by_key(self, create: Callable, merge: Callable, combine: Callable) -> TracedRDD:
        return self._keyed(self._pairs().combineByKey(create, merge, combine, self.tasks))

    def group_by_key(self) -> TracedRDD:
        return self._keyed(self._pairs().groupByKey(self.tasks).mapValues(list))

    def group_by(self, f: Callable) -> TracedRDD:
        return self.key_by(f).group_by_key()

    def distinct(self) -> TracedRDD:
        pairs = self.map(lambda v: (v, None))
        return pairs.reduce_by_key(lambda a, b: a).keys()

    def cogroup(self, other: TracedRDD) -> TracedRDD:
        return self._keyed(self._pairs().cogroup(other._pairs(), tasks_for(self._size(other), self.rdd, other.rdd)).mapValues(lambda v: (list(v[0]), list(v[1]))), other)

    def _joined(self, other: TracedRDD, left_outer: bool, right_outer: bool) -> TracedRDD:
        """Joins of pairs: all tasks get a side of few records, whose own records are met by others only.

        Else the records of a hot key are cut into pieces, so no task gets them all.
        """
        if not right_outer and (few := other._few()) is not None:
            held, alone = self.rdd.context.broadcast(few), [None] if left_outer else []
            return self._keyed(self.rdd.mapPartitions(lambda records, held=held: met(records, held.value, alone, True)), other)
        if not left_outer and (few := self._few()) is not None:
            held, alone = self.rdd.context.broadcast(few), [None] if right_outer else []
            return self._keyed(other.rdd.mapPartitions(lambda records, held=held: met(records, held.value, alone, False)), other)

        def pairs(tile) -> Iterator[tuple]:
            key, a, b, a_cut, b_cut = tile
            # a cut side has records of the key, if not in this tile
            own = list(a) or ([None] if right_outer and not a_cut else [])
            others = list(b) or ([None] if left_outer and not b_cut else [])
            return ((key, (x, y)) for x in own for y in others)

        return self._keyed(hot_keys.tiled(self.rdd, other.rdd, tasks=tasks_for(self._size(other), self.rdd, other.rdd)).flatMap(pairs), other)

    def _few(self) -> dict[Any, list] | None:
        """The values by key, if there are few."""
        known, found = self._pairs().take(FEW_RECORDS + 1), {}
        for key, value in known:
            found.setdefault(key, []).append(value)
        return found if len(known) <= FEW_RECORDS else None

    def join(self, other: TracedRDD) -> TracedRDD:
        return self._joined(other, False, False)

    def left_outer_join(self, other: TracedRDD) -> TracedRDD:
        return self._joined(other, True, False)

    def right_outer_join(self, other: TracedRDD) -> TracedRDD:
        return self._joined(other, False, True)

    def full_outer_join(self, other: TracedRDD) -> TracedRDD:
        return self._joined(other, True, True)

    def subtract_by_key(self, other: TracedRDD) -> TracedRDD:
        """Pairs whose key the other lacks; those pairs alone are witnesses."""
        taken = other._pairs().keys().distinct(other.tasks).map(lambda k: (k, (k, None)))
        tiles = hot_keys.tiled(self.rdd, taken, tasks=tasks_for(self._size(other), self.rdd, other.rdd))
        return self._keyed(tiles.flatMap(lambda t: [] if list(t[2]) else ((t[0], a) for a in t[1])), other)

    def union(self, other: TracedRDD) -> TracedRDD:
        inputs = (self, other)
        tagged = [x.rdd.map(lambda r, b=b: ((b, r[0]), r[1])) for b, x in enumerate(inputs)]
        return TracedRDD(tagged[0].union(tagged[1]), inputs, lambda b: inputs[b].rdd.map(lambda r: ((b, r[0]), r[0])).distinct(inputs[b].tasks), size=self._size(other))

    # results

    def collect(self) -> list:
        return self.rdd.values().collect()

    def collect_with_id(self) -> list[tuple]:
        """(record, id) for each record."""
        return self.rdd.map(lambda r: (r[1], r[0])).collect()

    def count(self) -> int:
        return self.rdd.count()

    def save_as_text_file(self, path: str) -> None:
        self.rdd.values().saveAsTextFile(path)

    def save_as_hadoop_file(self, path: str, output_format: str, **classes) -> None:
        """Pair records by a Hadoop output format."""
        self.rdd.values().saveAsHadoopFile(path, output_format, **classes)

    def lineage(self, predicate: Callable[[Any], bool] | None = None) -> RddCursor:
        """A cursor on the result records for which the predicate holds, or on all."""
        seen = None if self.parents else self.with_source
        if seen is not None:
            rows = (seen if predicate is None else seen.filter(lambda r: predicate(r[1][0]))).mapValues(lambda v: v[1])
            return RddCursor(self, rows.keys(), rows=rows)
        return RddCursor(self, self.rdd.mapPartitions(lambda records: ids_where(records, predicate)).distinct(self.tasks))
