"""Mixing sources to target weights as a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern: the patterns' tokens are the capacities of a small graph. Each pattern
can be used up to ``max_repeats`` times, its first use free and each further one
dearer (a convex cost). The cheapest flow from the patterns to the source quotas
says how many tokens of each pattern go to each source; documents are then
selected in seeded order until the pattern's flow is used up.

The graph has one node for each pattern and source, however many documents there
are; it alone is solved on the driver.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, extended, written

#: More patterns than this are refused rather than collected; of patterns that share sources, the flow takes fewer.
MAX_PATTERNS, MAX_SHARED = 500_000, 20_000
#: Rows whose running sums one task computes, on average.
BIN_ROWS = 2_000
#: Selection ends when no document fits or when this part of the rest is left.
ENOUGH = 1_000


def n_words(text_col: str = "text") -> Column:
    """Words of the whole text; null counts as 0."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(weights: dict, sizes: dict, total: int, max_repeats: int) -> dict:
    """Share ``total`` by weight; what exceeds a source's limit is shared anew among the others."""
    limit = {s: Fraction(max_repeats * sizes.get(s, 0)) for s in weights}
    fixed: dict = {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed and w > 0}
        left, whole = Fraction(total) - sum(fixed.values()), sum(map(Fraction, free.values()))
        share = {s: left * Fraction(w) / whole for s, w in free.items()}
        over = [s for s in free if share[s] > limit[s]]
        if not over:
            return {s: fixed.get(s, share.get(s, Fraction(0))) for s in weights}
        fixed |= {s: limit[s] for s in over}


@dataclass(frozen=True)
class Quota:
    """The node of a source; a pattern's node is the pattern itself."""

    source: object


def route(patterns: dict[tuple, int], demand: dict, max_repeats: int) -> dict[tuple, dict]:
    """Tokens from each pattern to each source, filling the quotas at the least cost of repetition.

    The k-th use of a pattern costs k - 1 a token. The cheapest paths cost the same
    along one level, so each level is filled by augmenting paths before the next
    opens; flow once routed may be routed anew to other sources.
    """
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    need = dict(demand)
    used = dict.fromkeys(patterns, 0)
    members: dict = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    alone = {p for p in patterns if len(p) == 1 and len(members[p[0]]) == 1}  # no choice to make
    for p in alone:
        flow[p][p[0]] = min(need.get(p[0], 0), max_repeats * patterns[p])
    shared = sorted(set(patterns) - alone, key=repr)
    if len(shared) > MAX_SHARED:
        raise ValueError(f"more than {MAX_SHARED} membership patterns that share sources")
    for level in range(1, max_repeats + 1):
        for start in shared:
            while used[start] < level * patterns[start]:
                before, queue, end = {start: None}, deque([start]), None
                while queue and end is None:
                    node = queue.popleft()
                    if not isinstance(node, Quota):
                        for s in node:
                            if Quota(s) not in before and s in need:
                                before[Quota(s)] = node
                                queue.append(Quota(s))
                                if need[s] > 0:
                                    end = Quota(s)
                                    break
                    else:
                        for p in members[node.source]:
                            if p not in before and flow[p].get(node.source, 0) > 0:
                                before[p] = node
                                queue.append(p)
                if end is None:
                    break
                path = [end]
                while before[path[-1]] is not None:
                    path.append(before[path[-1]])
                path.reverse()
                amount = min(level * patterns[start] - used[start], need[end.source], *(flow[path[i + 1]][path[i].source] for i in range(1, len(path) - 1, 2)))
                for i in range(0, len(path) - 1, 2):
                    p, s = path[i], path[i + 1].source
                    flow[p][s] = flow[p].get(s, 0) + amount
                    if i + 2 < len(path):
                        flow[path[i + 2]][s] -= amount
                used[start] += amount
                need[end.source] -= amount
    return flow


def mix(docs: DataFrame, weights: dict, size: Column, sources: Column, key: str = "doc_id", total: int | None = None, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    ``sources`` is an array of the sources a document belongs to (a null entry is a
    source like any other); ``weights`` their weights; ``total`` the tokens of the
    mix, by default those of all documents. Returns key, size long, sources, copies
    int, taken long (size times copies). A quota is at most ``max_repeats`` times
    its source; what exceeds that is shared by weight among the others.

    Whole documents are taken: all ``flow // capacity`` times, and once more those
    that come first in an order by seeded hash and fit: documents larger than what
    is left are set aside and the others' sums are made anew, until none fits or less
    than 1 / ENOUGH is left; then the one that best fills the rest. Reruns agree. Documents without words or without a weighted source are
    taken 0 times. Repeated rows are documents of their own.
    """
    if {"_no", "size", "sources", "copies", "taken"} & {key}:
        raise ValueError("the key clashes with an added column")
    spark = docs.sparkSession
    known = written(docs.select(F.col(key), F.monotonically_increasing_id().alias("_no"), size.cast("long").alias("size"), F.array_sort(F.array_distinct(sources)).alias("sources")), "mix-sizes")
    found = known.groupBy("sources").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.sources or ()): r.size or 0 for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    wanted = {s: int(q) for s, q in quotas(weights, sizes, sum(patterns.values()) if total is None else total, max_repeats).items()}
    flow = route({p: n for p, n in patterns.items() if n and any(s in weights for s in p)}, wanted, max_repeats)
    plan = []
    for r in found:
        use, n = sum(flow.get(tuple(r.sources or ()), {}).values()), r.size or 0
        plan.append((r.sources, use // n if n else 0, use % n if n else 0, max(1, r.n // BIN_ROWS)))
    plans = F.broadcast(spark.createDataFrame(plan, extended(known.select("sources").schema, "every int, rest long, bins int")))
    order = F.xxhash64(F.lit(seed), F.col(key), F.col("size"))
    placed = known.join(plans, known.sources.eqNullSafe(plans.sources)).select(
        known[key], "_no", known["size"], known.sources, "every", "rest", order.alias("at"),
        F.floor((order.cast("double") / 2.0**64 + 0.5) * F.col("bins")).cast("int").alias("bin"),
    )
    table = written(placed, "mix-order")
    pool, taken = table.where("size > 0 and rest > 0").select("_no", "size", "sources", "rest", "at", "bin", F.col("rest").alias("left")), []
    while True:
        chosen = written(fitting(pool), "mix-round")
        taken.append(chosen.where("first").select("_no"))
        full = F.broadcast(chosen.where("first").groupBy("sources").agg(F.max("upto").alias("full")).withColumnRenamed("sources", "s"))
        pool = chosen.join(full, F.col("sources").eqNullSafe(F.col("s")), "left").where("not first").withColumn("left", F.col("left") - F.coalesce("full", F.lit(0)))
        # a document of twice what is left, or more, is no better than none
        pool = written(pool.where("size < 2 * left").select("_no", "size", "sources", "rest", "at", "bin", "left"), "mix-left")
        if pool.where((F.col("size") <= F.col("left")) & (F.col("left") * ENOUGH > F.col("rest"))).isEmpty():
            break
    # of the others, the one whose size comes nearest to what is left of the pattern's flow
    miss = F.abs(F.col("left") - F.col("size"))
    taken.append(pool.groupBy("sources").agg(F.min(F.struct(miss.alias("miss"), "at", "_no")).alias("fill")).select("fill._no"))
    more = reduce(DataFrame.union, taken).withColumn("more", F.lit(1))
    copies = F.when(F.col("size") > 0, F.col("every") + F.coalesce("more", F.lit(0))).otherwise(0)
    return table.join(more, "_no", "left").select(key, "size", "sources", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def fitting(pool: DataFrame) -> DataFrame:
    """Running sums ``upto`` in seeded order of the sizes that fit alone, over the bins of a pattern and within each bin, and whether a document is among the ``first`` that fit together."""
    fits = F.col("size") <= F.col("left")
    pool = pool.withColumn("own", F.when(fits, F.col("size")).otherwise(0))
    bins = pool.groupBy("sources", "bin").agg(F.sum("own").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("sources").orderBy("bin")) - F.col("sum")
    sums = bins.select(F.col("sources").alias("s"), F.col("bin").alias("b"), before.alias("before"))
    inner = Window.partitionBy("sources", "bin").orderBy("at", "_no").rowsBetween(Window.unboundedPreceding, 0)
    summed = pool.withColumn("upto", F.sum("own").over(inner)).join(sums, F.col("sources").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    return summed.withColumn("upto", F.col("upto") + F.col("before")).withColumn("first", fits & (F.col("upto") <= F.col("left"))).drop("own", "s", "b", "before")
