"""Joins by a comparison, and traces over them that need no pairs."""

import random
from math import inf, nan

import pytest
from pyspark.sql import functions as F

from rowtrail.session import RowTrail


def order(v):
    """NaN is the largest number and equals itself, as in Spark."""
    return inf if v != v else v


@pytest.mark.parametrize("keyed", [False, True])
def test_partners_are_those_of_the_pairs(spark, keyed):
    rng, trail = random.Random(5), RowTrail(spark)
    number = lambda: rng.choice([None, nan, -0.0, 0.0, *map(float, range(6))])
    rows = [[(i, rng.choice(["a", "b", "c", None]), number()) for i in range(30)] for _ in range(2)]
    left, right = (trail.frame(spark.createDataFrame(r, f"{x}id int, {x}k string, {x}v double"), x) for x, r in zip("ab", rows, strict=True))
    pairs = {(p[0], q[0]) for p in rows[0] for q in rows[1] if None not in (p[2], q[2]) and order(p[2]) < order(q[2]) and (not keyed or p[1] is not None and p[1] == q[1])}
    joined = left.less_join(right, F.col("av"), F.col("bv"), [("ak", "bk")] if keyed else [])
    assert {(r.aid, r.bid) for r in joined.result.select("aid", "bid").collect()} == pairs
    for where, holds in ((None, lambda p: True), ("aid % 3 = 0", lambda p: p[0] % 3 == 0), ("bid < 9", lambda p: p[1] < 9), ("aid > bid", lambda p: p[0] > p[1])):
        at = joined.trace(where)
        assert (at.behind is None) == (where == "aid > bid")
        for branch, column in enumerate(("aid", "bid")):
            shown = at.go_back(branch).show()
            assert sorted(r[column] for r in shown.collect()) == sorted({p[branch] for p in pairs if holds(p)})


def test_numbers_of_two_types_are_looked_up_by_pairs(spark):
    trail = RowTrail(spark)
    left, right = trail.values([(1, "10")], "a int, av string"), trail.values([(1, 9), (2, 11)], "b int, bv int")
    at = left.less_join(right, F.col("av"), F.col("bv")).trace("b > 0")
    assert at.behind is None and [r.b for r in at.go_back(1).show().collect()] == [2]
