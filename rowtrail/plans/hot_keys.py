"""Keys that hold so many records of an RDD that one task should not take them all.

Such a key's records are cut into pieces, on both sides of a join, and each piece of
one side meets each piece of the other in a tile of its own. Only keys with more
records than an average task has are cut, so there are at most as many of them as
tasks, and their table may be broadcast. It changes the balance alone, never the result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark import RDD

#: A key with fewer records on a side is never cut there.
SMALL = 10_000
#: No key is cut into more pieces than this, and no more keys are cut.
MOST = 4_096


def _fewer(counts: Counter, most: int) -> Counter:
    """At most ``most`` keys: each count is lowered by the greatest one that is left out."""
    if len(counts) <= most:
        return counts
    left_out = heapq.nlargest(most + 1, counts.values())[-1]
    return Counter({k: n - left_out for k, n in counts.items() if n > left_out})


def _summary(keys: Iterable, most: int) -> tuple[int, Counter]:
    total, counts = 0, Counter()
    for k in keys:
        total += 1
        counts[k] += 1
        if len(counts) > 2 * most:
            counts = _fewer(counts, most)
    return total, _fewer(counts, most)


def pieces(keys: RDD, tasks: int, small: int = SMALL) -> dict[Any, int]:
    """Into how many pieces the records of a key should go, for each key with two or more.

    One pass with a summary of at most ``8 * tasks`` counts for each partition (Misra-Gries),
    merged in a tree. A count is at most an eighth of an average task's records too low and
    never too high, so no key with an average task's records or more is overlooked.
    """
    tasks = min(tasks, MOST)
    if not keys.getNumPartitions():
        return {}

    def merged(a, b):
        return a[0] + b[0], _fewer(a[1] + b[1], 8 * tasks)

    total, counts = keys.mapPartitions(lambda ks: [_summary(ks, 8 * tasks)]).treeReduce(merged)
    size = max(total / tasks, small)
    wanted = {k: min(int(n * 8 / 7 / size) + 1, tasks) for k, n in counts.items() if n >= size * 7 / 8}
    return {k: n for k, n in wanted.items() if n > 1}


def piece_of(record: Any, number: int) -> int:
    """Which piece a record goes to; the same again when a lost task is run anew.

    By what ``repr`` gives of id and value, as ids repeat where narrow operators or joins
    made several records; where that tells an object's address, by the id alone.
    """
    told = repr(record)
    return zlib.crc32((repr(record[0]) if " at 0x" in told else told).encode("utf-8", "surrogatepass")) % number


def tiled(left: RDD, right: RDD, small: int = SMALL, *, tasks: int | None = None) -> RDD:
    """(key, left values, right values, left cut, right cut) for each tile of two RDDs of (id, (key, value)).

    A key that is not hot has one tile. Else each pair of records meets in one tile; a
    side that is cut has records of the key, though not in each tile perhaps. Tiles go to
    ``tasks`` tasks, or else to as many as both have partitions.
    """
    tasks = tasks or left.getNumPartitions() + right.getNumPartitions()
    cut = [pieces(side.map(lambda r: r[1][0]), tasks, small) for side in (left, right)]
    held = left.context.broadcast(cut)

    def dealt(side: int):
        def places(record) -> Iterator[tuple]:
            key, value = record[1]
            own, others = (held.value[s].get(key, 1) for s in (side, 1 - side))
            piece = piece_of(record, own) if own > 1 else 0
            for other in range(others):
                yield (key, *((piece, other) if side == 0 else (other, piece))), value

        return places

    def met(tile) -> tuple:
        (key, _, _), (a, b) = tile
        return key, a, b, key in held.value[0], key in held.value[1]

    return left.flatMap(dealt(0)).cogroup(right.flatMap(dealt(1)), tasks).map(met)
