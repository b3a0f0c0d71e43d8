"""Range joins whose bins are hot, and traces over them that need no pairs."""

import random
from math import nan

import pytest
from pyspark.sql import functions as F

from rowtrail.operators import ordered_joins
from rowtrail.session import RowTrail


def made(spark, seed=31):
    """(id, k, at) and (no, k, lo, hi), with nulls, NaN, empty and very wide intervals and equal numbers."""
    rng = random.Random(seed)
    number = lambda: rng.choice([None, nan, -0.0, float(rng.randrange(60)), float(rng.randrange(60))])
    points = [(i, rng.choice(["a", "b", None]), number()) for i in range(70)]
    spans = []
    for i in range(25):
        low, wide = number(), rng.choice([-1.0, 0.0, 2.0, 3.0, 40.0])
        spans.append((i, rng.choice(["a", "b", None]), low, None if low is None else low + wide))
    trail = RowTrail(spark)
    ids = [spark.createDataFrame(points, "id int, k string, at double"), spark.createDataFrame(spans, "no int, k string, lo double, hi double")]
    return points, spans, trail.frame(ids[0], "points"), trail.frame(ids[1], "spans")


def met(points, spans, keyed):
    inside = lambda p, s: None not in (p[2], s[2], s[3]) and s[2] <= p[2] <= s[3]
    return {(p[0], s[0]) for p in points for s in spans if inside(p, s) and (not keyed or p[1] is not None and p[1] == s[1])}


@pytest.mark.parametrize("keyed", [False, True])
def test_sweeps_and_tiles_find_what_pairs_tell(spark, monkeypatch, keyed):
    monkeypatch.setattr(ordered_joins, "TILE", 2)  # bins of more than four pairs are cut
    monkeypatch.setattr(ordered_joins, "CELLS", 5)
    points, spans, left, right = made(spark)
    want = met(points, spans, keyed)
    if not keyed:
        right = right.rename("k", "other")
    for how in ("inner", "left"):
        joined = left.range_join(right, F.col("at"), F.col("lo"), F.col("hi"), on=["k"] if keyed else [], how=how)
        pairs = want | ({(p[0], None) for p in points if p[0] not in {a for a, _ in want}} if how == "left" else set())
        got = [(r.id, r.no) for r in joined.result.select("id", "no").collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        for where, holds in ((None, lambda p: True), ("id % 3 = 0", lambda p: p[0] % 3 == 0), ("no < 9", lambda p: p[1] is not None and p[1] < 9), ("no is null or no = 4", lambda p: p[1] in (None, 4)), ("id > no", lambda p: p[1] is not None and p[0] > p[1])):
            at = joined.trace(where)
            assert (at.behind is None) == (where == "id > no")
            for branch, column in enumerate(("id", "no")):
                rows = sorted(r[0] for r in at.go_back(branch).show(column).collect())
                assert rows == sorted({p[branch] for p in pairs if holds(p)} - {None})


def test_no_pairs_are_made_where_one_side_tells(spark):
    _, _, left, right = made(spark)
    joined = left.range_join(right.rename("k", "other"), F.col("at"), F.col("lo"), F.col("hi"), how="left")
    for where, branch in (("no is null", 0), ("id < 5", 1)):
        shown = joined.trace(where).go_back(branch).show()
        assert "__bin" not in shown._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_keep_every_column_and_null(spark, monkeypatch, block):
    monkeypatch.setattr(ordered_joins, "BLOCK", block)
    monkeypatch.setattr(ordered_joins, "TILE", 2)
    monkeypatch.setattr(ordered_joins, "CELLS", 4)
    points, spans, left, right = made(spark, 32)
    joined = left.range_join(right.rename("k", "other"), F.col("at"), F.col("lo"), F.col("hi"))
    got = sorted(map(tuple, joined.result.select("id", "k", "at", "no", "other", "lo", "hi").collect()), key=repr)
    pairs = met(points, spans, False)
    assert got == sorted(((*points[a], *spans[b]) for a, b in pairs), key=repr) and any(r[1] is None for r in got)
    # what is not asked for is not packed
    packed = joined.result.select("id", "no")._jdf.queryExecution().optimizedPlan().toString()
    assert packed.count("collect_list") == 2


def test_pairs_are_written_in_runs_that_pack(spark, tmp_path):
    """Wide intervals: pairs grow with the square of the tables, and so do the files that they are written to."""
    rng = random.Random(33)
    trail = RowTrail(spark)
    points = spark.createDataFrame([(i, rng.random()) for i in range(4000)], "id long, at double")
    spans = spark.createDataFrame([(i, rng.random() - 0.4, rng.random() + 0.5) for i in range(2000)], "no long, lo double, hi double")
    joined = trail.frame(points, "points").range_join(trail.frame(spans, "spans"), F.col("at"), F.col("lo"), F.col("hi"))
    joined.select("id", "no").result.write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert pairs > 5_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * pairs
