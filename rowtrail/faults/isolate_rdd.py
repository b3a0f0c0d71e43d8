"""Fault isolation over RDD jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import RDD

from ..operators.traced_rdd import RddCursor, TracedRDD, among
from ..sources.scratch import scratch_path
from .ddmin import remembering, smallest
from .isolate import BUCKETS, FEW, MOST_BUCKETS


@dataclass
class IsolatedRecords:
    """As ``Isolated``; ``culprits`` and ``faulty`` are RDDs of records."""

    culprits: RDD
    faulty: RDD
    n_faulty: int
    provenance_size: int
    runs: int
    minimal: bool = True


def bucket_of(round_: int, buckets: int) -> Callable[[Any], int]:
    """Deals ids out anew in each round; ids are numbers or tuples of such, whose hash is the same in every process."""
    return lambda record: (hash((round_, record[0])) * 0x9E3779B97F4A7C15 >> 29) % buckets


def stored(rdd: RDD, name: str) -> RDD:
    """Written to the shared folder and read again, so that no run computes it anew."""
    from pyspark.sql import SparkSession

    path = scratch_path(SparkSession.builder.getOrCreate(), name)
    rdd.saveAsPickleFile(path)
    return rdd.context.pickleFile(path)


def sources_reached(cursor: RddCursor, source: TracedRDD) -> list[RDD]:
    """The ids at ``source`` over every path that leads there; narrow operators share their input's root."""
    if cursor.at_source:
        return [cursor.ids] if cursor.at.root is source.root else []
    return [found for i in range(len(cursor.at.parents)) for found in sources_reached(cursor.go_back(i), source)]


def isolate_rdd(source: TracedRDD, job: Callable[[TracedRDD], TracedRDD], test: Callable | None = None, on_progress: Callable[[int], None] | None = None, oracle: Callable[[RDD], Callable] | None = None) -> IsolatedRecords:
    """The records of ``source`` that make ``test`` true for some output of ``job``.

    Instead of ``test``, an ``oracle`` makes it from the original output (see
    ``oracles.rdd_lowest`` and its like). Candidates come from tracing every branch
    that leads to ``source``; if they do not fail by themselves, all records are
    searched. The driver holds bucket numbers only.
    """
    runs = 0
    output = job(source)
    if oracle is not None:
        test = oracle(output.rdd.values())

    def fails(rdd: RDD) -> bool:
        nonlocal runs
        runs += 1
        return not job(TracedRDD(rdd)).rdd.values().filter(test).isEmpty()

    faulty = output.rdd.values().filter(test)
    n = faulty.count()
    if not n:
        return IsolatedRecords(faulty, faulty, 0, 0, 0)
    ids = sources_reached(output.lineage(test), source)
    rows = stored(among(source.rdd, source.rdd.context.union(ids).distinct()) if ids else source.rdd, "records")
    left = size = rows.count()
    if ids and not fails(rows):
        rows = stored(source.rdd, "records")
        left = rows.count()
    round_, buckets = 0, BUCKETS
    while True:
        alone = left <= FEW
        if alone:
            place = {i: k for k, i in enumerate(sorted(rows.keys().collect(), key=repr))}
            part = lambda chosen, of=rows, p=place: of.filter(lambda r: p[r[0]] in chosen)
        else:
            part = lambda chosen, of=rows, b=bucket_of(round_, buckets): of.filter(lambda r: b(r) in chosen)
        first = remembering(lambda parts, take=part: [fails(take(set(p))) for p in parts], 1)
        kept = smallest(left if alone else buckets, first, on_progress if alone else None)
        rows = part(set(kept))
        if alone:
            return IsolatedRecords(rows.values(), faulty, n, size, runs)
        rows = stored(rows, "records")
        now, round_ = rows.count(), round_ + 1
        if on_progress:
            on_progress(now)
        if now > left // 2:
            if buckets >= MOST_BUCKETS:
                return IsolatedRecords(rows.values(), faulty, n, size, runs, minimal=False)
            buckets *= 8
        left = now
