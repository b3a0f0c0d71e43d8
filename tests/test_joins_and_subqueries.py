"""Range and as-of joins, scalar subqueries, distinct values and grouping sets against plain loops."""

import itertools
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from rowtrail.plans.levels import UnsupportedOperatorError
from rowtrail.session import RowTrail

RNG = random.Random(11)
POINTS = [(i, RNG.choice(["x", "y", None]), RNG.choice([None, float("nan"), 1e300, RNG.uniform(-40, 40), float(RNG.randrange(-5, 5))])) for i in range(70)]
SPANS = []
for number in range(40):
    low = RNG.choice([None, float(RNG.randrange(-6, 6)), RNG.uniform(-40, 40)])
    SPANS.append((100 + number, RNG.choice(["x", "y", None]), low, None if low is None else low + RNG.choice([0, 0, 0.5, 3, 30, -2, 1e301])))


def both(spark, points="p long, k string, at double", spans="s long, k string, lo double, hi double"):
    trail = RowTrail(spark)
    return trail, trail.keyed(spark.createDataFrame(POINTS, points), "p"), trail.keyed(spark.createDataFrame(SPANS, spans), "s")


def inside(p, s, keyed):
    return p[2] is not None and s[2] is not None and s[2] <= p[2] <= s[3] and (not keyed or p[1] is not None and p[1] == s[1])


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, keyed, how):
    _, points, spans = both(spark)
    if not keyed:
        spans = spans.rename("k", "k2")
    joined = points.range_join(spans, F.col("at"), F.col("lo"), F.col("hi"), on=["k"] if keyed else [], how=how)
    want = {(p[0], s[0]) for p in POINTS for s in SPANS if inside(p, s, keyed)}
    if how == "left":
        want |= {(p[0], None) for p in POINTS if not any((p[0], s[0]) in want for s in SPANS)}
    got = [(r.p, r.s) for r in joined.result.select("p", "s").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    back = joined.trace("s is not null and p < 20").go_back(1)
    assert {r.s for r in back.show().collect()} == {s for p, s in want if s is not None and p < 20}
    plan = joined.result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_join_of_large_integers_and_nothing(spark):
    trail = RowTrail(spark)
    at = trail.keyed(spark.createDataFrame([(2**53 + i,) for i in range(6)], "a long"), "a")
    spans = trail.keyed(spark.createDataFrame([(2**53 + 1, 2**53 + 3), (2**53 + 5, 2**53 + 5)], "lo long, hi long"), "lo")
    got = {(r.a - 2**53, r.lo - 2**53) for r in at.range_join(spans, F.col("a"), F.col("lo"), F.col("hi")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5)}
    assert at.range_join(spans.where("false"), F.col("a"), F.col("lo"), F.col("hi")).collect() == []


TICKS = [(i, RNG.choice(["x", "y", None]), RNG.choice([None, *range(30)])) for i in range(60)]
NEWS = [(100 + i, RNG.choice(["x", "y", None]), RNG.choice([None, *range(30)])) for i in range(25)]


@pytest.mark.parametrize(("forward", "strict", "every", "by"), [*itertools.product([False, True], [False, True], [None, 7], [["k"]]), (False, False, 3, []), (True, False, None, [])])
def test_asof_join(spark, forward, strict, every, by):
    trail = RowTrail(spark)
    ticks = trail.keyed(spark.createDataFrame(TICKS, "t long, k string, at int"), "t")
    news = trail.keyed(spark.createDataFrame(NEWS, "n long, k string, told int"), "n")
    if not by:
        news = news.rename("k", "k2")
    joined = ticks.asof_join(news, "at", "told", by, forward=forward, strict=strict, every=every)

    def partner(t):
        if t[2] is None or by and t[1] is None:
            return None
        found = [n for n in NEWS if n[2] is not None and (not by or n[1] == t[1]) and (n[2] >= t[2] if forward else n[2] <= t[2]) and not (strict and n[2] == t[2])]
        return (min if forward else max)(found, key=lambda n: (n[2], n[0]))[0] if found else None

    want = {t[0]: partner(t) for t in TICKS}
    got = [(r.t, r.n) for r in joined.result.select("t", "n").collect()]
    assert len(got) == len(TICKS) and dict(got) == want
    assert {r.n for r in joined.trace("t < 30").go_back(1).show().collect()} == {n for t, n in want.items() if t < 30 and n is not None}
    found = ticks.asof_join(news, "at", "told", by, forward=forward, strict=strict, every=every, how="inner")
    assert {r.t for r in found.result.select("t").collect()} == {t for t, n in want.items() if n is not None}
    assert "NestedLoop" not in joined.result._jdf.queryExecution().executedPlan().toString()


def test_asof_join_of_times(spark):
    """Pieces of times with and without a zone, across a change of the clock."""
    made = spark.sql("SELECT id, timestamp_ntz'2024-03-31 00:00:00' + make_dt_interval(0, id, 0, 0) AS at FROM range(8)")
    trail = RowTrail(spark)
    for kind in ("timestamp_ntz", "timestamp", "date"):
        rows = made.withColumn("at", F.col("at").cast(kind))
        left, right = trail.keyed(rows, "id"), trail.keyed(rows.where("id % 3 = 0").select(F.col("id").alias("other"), F.col("at").alias("told")), "other")
        plain = {(r.id, r.other) for r in left.asof_join(right, "at", "told").collect()}
        assert {(r.id, r.other) for r in left.asof_join(right, "at", "told", every=7200).collect()} == plain and len(plain) == 8


def test_scalar_subqueries(spark):
    trail, points, spans = both(spark)
    none = points.scalar("most", spans.where("false"), "hi")
    assert none.where("most is null").result.count() == len(POINTS) and none.trace().go_back(1).ids.count() == 0
    with pytest.raises(Py4JJavaError, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        points.scalar("any", spans, "hi").collect()
    least = points.scalar("least", spans.agg(F.min("lo").alias("least")), "least").where("at > least and p < 9")
    at = least.trace()
    assert at.go_back(1).go_back().ids.count() == len(SPANS)
    assert {r.output.p for r in at.associations(1).collect()} == {r.p for r in least.collect()}
    assert at.go_back(1).go_next().ids.count() == len(POINTS)
    assert least.trace("p < 0").go_back(1).ids.count() == 0
    with pytest.raises(UnsupportedOperatorError):
        points.scalar("x", spans, "hi", on={"k": "k"})
    with pytest.raises(UnsupportedOperatorError):
        points.scalar("x", spans.group_by("k", "lo").agg(F.max("hi").alias("hi")), "hi", on={"k": "k"})
    own = points.scalar("n", spans.group_by("k").count(), "count", on={"k": "k"})
    assert "__on0" not in own.result.columns and own.where("k is null").trace().go_back(1).ids.count() == 0
    assert {r.s for r in own.trace("k = 'x'").go_back(1).go_back().show().collect()} == {s[0] for s in SPANS if s[1] == "x"}


def test_distinct_values(spark):
    _, points, _ = both(spark)
    made = points.group_by("k").agg_distinct({"n": "at", "m": F.col("p") % 5}, F.count(F.lit(1)).alias("rows"))
    plain = {r.k: (r.n, r.m, r.rows) for r in points.result.groupBy("k").agg(F.count_distinct("at").alias("n"), F.count_distinct(F.col("p") % 5).alias("m"), F.count(F.lit(1)).alias("rows")).collect()}
    assert {r.k: (r.n, r.m, r.rows) for r in made.collect()} == plain
    at = made.trace("k is null")
    assert at.go_back(0).ids.count() == plain[None][0] and at.go_back(1).ids.count() == plain[None][1]
    assert {r.m for r in at.go_back(1).show().collect()} == {p[0] % 5 for p in POINTS if p[1] is None}
    assert {r.p for r in at.go_back(0).go_back().show().collect()} == {p[0] for p in POINTS if p[1] is None and p[2] is not None}
    assert {r.p for r in at.go_back(1).where("m = 2").go_back().show().collect()} == {p[0] for p in POINTS if p[1] is None and p[0] % 5 == 2}
    assert {r.p for r in at.go_back(2).show().collect()} == {p[0] for p in POINTS if p[1] is None}
    reached = made.trace().go_back(1).go_back().where("p = 7").go_next().go_next()
    assert [i.k0 for i in reached.collect_ids()] == [POINTS[7][1]]


def test_grouping_sets_by_the_chosen_sets(spark):
    _, points, _ = both(spark)
    points = points.with_column("odd", F.col("p") % 2)
    cubed = points.cube("k", "odd").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    one = cubed.trace("g = 2 and odd = 1").go_back()
    assert {r.p for r in one.show().collect()} == {p[0] for p in POINTS if p[0] % 2}
    assert "Generate" not in one.show()._jdf.queryExecution().executedPlan().toString()
    # groups of two sets, whose rows overlap; a null group is not the total
    several = cubed.trace("g = 1 and k is null or g = 0 and k = 'x' and odd = 0")
    assert {r.p for r in several.go_back().show().collect()} == {p[0] for p in POINTS if p[1] is None or p[1] == "x" and p[0] % 2 == 0}
    assert cubed.trace("g = 3").go_back().ids.count() == len(POINTS) and cubed.trace("g = 9").go_back().ids.count() == 0
    assert several.associations().count() == several.go_back().ids.count()
    assert cubed.trace().go_back().where("p = 4").go_next().ids.count() == 4


def test_lateral_joins_and_table_functions(spark):
    @F.udtf(returnType="x long")
    class Twice:
        def eval(self, n):
            for _ in range(2):
                yield (n * 10,)

    @F.udtf(returnType="n long")
    class Count:
        def __init__(self):
            self.n = 0

        def eval(self, row):
            self.n += 1

        def terminate(self):
            yield (self.n,)

    _, points, spans = both(spark)
    made = points.lateral_join(Twice(F.col("p").outer()), granularity="row")
    assert made.result.count() == 2 * len(POINTS) and [r.p for r in made.trace("x = 70").show().collect()] == [7]
    for refused in (lambda: points.lateral_join(Twice(F.col("p").outer())), lambda: points.table_function(Count), lambda: points.table_function(Count, granularity="group"), lambda: points.lateral_join(spans, how="right")):
        with pytest.raises(UnsupportedOperatorError):
            refused()
    total = points.table_function(Count, granularity="all")
    assert [r.n for r in total.collect()] == [len(POINTS)] and total.trace().go_back().ids.count() == len(POINTS)
    _, _, spans = both(spark, spans="s long, k2 string, lo double, hi double")
    own = spans.where(F.col("k2") == F.col("k").outer())
    pairs = points.lateral_join(own)
    assert sorted((r.p, r.s) for r in pairs.result.select("p", "s").collect()) == sorted((p[0], s[0]) for p in POINTS for s in SPANS if p[1] and p[1] == s[1])
    nearest = points.lateral_join(own.nearest(1, F.desc("hi")), how="left")
    assert nearest.result.count() == len(POINTS)
    best = {k: max((s for s in SPANS if s[1] == k and s[3] is not None), key=lambda s: (s[3], -s[0]))[0] for k in "xy"}
    assert {r.s for r in nearest.trace("k = 'x'").go_back(1).show().collect()} == {best["x"]}
    assert nearest.trace("k is null").go_back(1).ids.count() == 0 and nearest.trace("k is null").go_back(0).ids.count() == sum(p[1] is None for p in POINTS)
