"""Frame-exact windows against the lists that Spark itself gathers over each frame."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowtrail.plans.frames import FOLLOWING, PRECEDING, range_frame, rows_frame
from rowtrail.session import RowTrail

RNG = random.Random(5)
ROWS = [(i, RNG.choice(["a", "b", None]), RNG.choice([None, *range(12)]), RNG.randrange(100)) for i in range(60)]
FRAMES = [
    (rows_frame(-2, 0), ["n"]), (rows_frame(-3, -1), ["n"]), (rows_frame(1, FOLLOWING), ["n"]), (rows_frame(), lambda: ["n", F.desc("id")]),
    (range_frame(-2, 1), ["n"]), (range_frame(1, 3), ["n"]), (range_frame(PRECEDING, 2), ["n"]), (range_frame(-2, FOLLOWING), ["n"]),
    (range_frame(-2, 0, descending=True), ["n"]), (range_frame(), ["n"]), (range_frame(0, FOLLOWING), ["n", "v"]), (range_frame(PRECEDING, FOLLOWING), ["n"]), (range_frame(-1, 2), lambda: [F.col("n") / 2]),
]


@pytest.fixture(scope="module")
def source(spark):
    return RowTrail(spark).keyed(spark.createDataFrame(ROWS, "id long, k string, n int, v int"), "id")


def gathered(source, frame, order_by):
    """id -> ids in its frame, and itself, by collect_list over the very same window."""
    _, framed = frame.windows([F.col("k")], order_by)
    return {r.id: {*r.ids, r.id} for r in source.df.select("id", F.collect_list("id").over(framed).alias("ids")).collect()}


@pytest.mark.parametrize("number", range(len(FRAMES)))
def test_frames(source, number):
    frame, order_by = FRAMES[number]
    order_by = order_by() if callable(order_by) else order_by
    made = source.with_windows(["k"], order_by, frame=frame, total=F.sum("v"))
    frames_of = gathered(source, frame, order_by)
    chosen = {3, 17, 18, 42}
    at = made.trace(F.col("id").isin(*chosen))
    back = at.go_back()
    want = set().union(*(frames_of[i] for i in chosen))
    assert {r.id for r in back.show().collect()} == want
    assert {r["own"]["id"] for r in back.where("id = 17").go_next().collect_ids()} == {i for i, own in frames_of.items() if 17 in own}
    pairs = {(r.output.own.id, r.input.id) for r in at.associations().collect()}
    assert pairs == {(i, j) for i in chosen for j in frames_of[i]}


def test_sums_come_again_from_the_witnesses(source, spark):
    frame = rows_frame(-2, 0)
    made = source.with_windows(["k"], ["n", "id"], frame=frame, total=F.sum("v"), place=lambda w: F.row_number().over(w))
    row = made.result.where("id = 30").first()
    behind = made.trace("id = 30").go_back().show().withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("n", "id").rowsBetween(-2, 0)))
    assert behind.where("id = 30").first().total == row.total


def test_levels_between_can_be_shown(source):
    made = source.with_windows(["k"], ["n"], frame=rows_frame(-1, 0), total=F.sum("v")).group_by("k").agg(F.max("total").alias("most"))
    at = made.trace("k = 'a'").go_back()
    assert {r.k for r in at.show().collect()} == {"a"} and "total" in at.show().columns


def test_a_range_with_offsets_has_one_column(source):
    with pytest.raises(ValueError, match="one sort column"):
        source.with_windows(["k"], ["n", "v"], frame=range_frame(-1, 1), total=F.sum("v"))
