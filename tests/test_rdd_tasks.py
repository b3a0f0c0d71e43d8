"""What a task of an RDD trace holds does not grow with the input: few ids and records go to all tasks, others to tasks enough."""

from collections import Counter

import pytest
from test_hot_keys import HOT, LEFT, RIGHT, expected, small  # noqa: F401

from rowtrail.operators import traced_rdd
from rowtrail.operators.traced_rdd import TracedRDD, among
from rowtrail.plans import hot_keys

PAIRS = [(f"k{i % 40}", i) for i in range(1000)]


def partitions(cursor_or_rdd):
    return getattr(cursor_or_rdd, "ids", cursor_or_rdd).getNumPartitions()


def test_few_ids_leave_the_pairs_where_they_are(spark, monkeypatch):
    sc = spark.sparkContext
    pairs, ids = sc.parallelize(PAIRS, 3), sc.parallelize(["k1", "k2", None], 2)
    want = sorted(p for p in PAIRS if p[0] in ("k1", "k2"))
    kept = among(pairs, ids, 1000)
    assert kept.glom().map(len).collect() == pairs.filter(lambda p: p[0] in ("k1", "k2")).glom().map(len).collect() and sorted(kept.collect()) == want
    monkeypatch.setattr(traced_rdd, "FEW_IDS", 0)
    monkeypatch.setattr(traced_rdd, "RECORDS", 100)
    dealt = among(pairs, ids, 1000)
    assert partitions(dealt) == 10 and sorted(dealt.collect()) == want


@pytest.mark.parametrize("how", ["join", "left_outer_join", "right_outer_join", "full_outer_join"])
@pytest.mark.parametrize("swapped", [False, True])
def test_joins_of_many_and_of_few_records(spark, small, monkeypatch, how, swapped):  # noqa: F811
    a, b = (RIGHT, LEFT) if swapped else (LEFT, RIGHT)
    want = expected(a, b, how in ("left_outer_join", "full_outer_join"), how in ("right_outer_join", "full_outer_join"))
    tiles = []
    monkeypatch.setattr(hot_keys, "tiled", lambda *x, made=hot_keys.tiled, **y: tiles.append(y) or made(*x, **y))
    for few in (-1, 200):  # 200 records: RIGHT alone is few
        monkeypatch.setattr(traced_rdd, "FEW_RECORDS", few)
        left, right = (TracedRDD.parallelize(spark.sparkContext, x, 4) for x in (a, b))
        joined = getattr(left, how)(right)
        assert Counter(joined.collect()) == want
        at = joined.lineage(lambda kv: kv[0] == HOT)
        for branch, side in enumerate((a, b)):
            assert Counter(at.go_back(branch).show_source().collect()) == Counter(r for r in side if r[0] == HOT)
    streamed = how == "join" or how == ("right_outer_join" if swapped else "left_outer_join")
    assert len(tiles) == (1 if streamed else 2)


def test_tasks_follow_the_number_of_records(spark, monkeypatch):
    monkeypatch.setattr(traced_rdd, "RECORDS", 100)
    monkeypatch.setattr(traced_rdd, "FEW_IDS", 5)
    monkeypatch.setattr(traced_rdd, "FEW_RECORDS", 5)
    source = TracedRDD.parallelize(spark.sparkContext, PAIRS, 2)
    sums = source.filter(lambda r: True).reduce_by_key(lambda a, b: a + b)
    assert source.size == sums.size == 1000 and partitions(sums.rdd) == partitions(sums.lineage()) == 10
    joined = source.join(source.map(lambda r: r))
    assert partitions(joined.rdd) == 20
    back = joined.lineage(lambda kv: kv[1][0] % 2 == 0).go_back(0)
    assert partitions(back) == 20 and Counter(back.show_source().collect()) == Counter(r for r in PAIRS if int(r[0][1:]) % 2 == 0)
    frame = spark.createDataFrame(PAIRS, "k string, v long").coalesce(1)
    dealt = TracedRDD.of_frame(frame)
    assert partitions(dealt.rdd) == 10 and Counter(dealt.collect()) == Counter(PAIRS) and len(set(dealt.rdd.keys().collect())) == 1000


def test_steps_to_a_source_take_its_records_along(spark):
    source = TracedRDD.parallelize(spark.sparkContext, PAIRS, 3)
    odd = source.filter(lambda r: r[1] % 2).map(lambda r: (r[0][-1], r[1] * 10))
    want = Counter(r for r in PAIRS if r[1] % 2 and r[0][-1] == "7")
    by_result = odd.lineage(lambda v: v[0] == "7")
    by_group = odd.reduce_by_key(max).map_values(str).lineage(lambda kv: kv[0] == "7").go_back()
    for at in (by_result, by_group):
        assert at.rows is not None and Counter(at.show_source().collect()) == want
        assert sorted(at.ids.collect()) == sorted(v for _, v in want) and Counter(at.show().collect()) == Counter((k[-1], v * 10) for k, v in want)
    twice = source.flat_map(lambda r: [r, r]).lineage(lambda r: r[1] < 3)
    assert twice.rows is None and sorted(twice.show_source().collect()) == PAIRS[:3]


def test_a_task_gets_few_records_of_a_frame_at_any_size(spark):
    for size in (100_000, 400_000):  # the second as it comes: one split
        source = TracedRDD.of_frame(spark.range(0, size, 1, 1).selectExpr("id % 1000 AS k", "id AS v"))
        sums = source.reduce_by_key(max)
        assert max(source.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()) < 130_000
        assert partitions(sums.rdd) == partitions(source.join(source).lineage()) // 2 == size // 100_000


def test_rows_that_lie_in_few_of_many_splits_are_dealt_anew(spark, tmp_path):
    spark.range(0, 400_000, 1, 1).selectExpr("id % 1000 AS k", "id AS v").write.parquet(str(tmp_path / "t"))  # one row group
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        frame = spark.read.parquet(str(tmp_path / "t"))
        assert partitions(frame.rdd) > 4
        source = TracedRDD.of_frame(frame)
        held = source.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        none = TracedRDD.of_frame(frame.where("v < 0"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert source.size == sum(held) == 400_000 and max(held) < 130_000
    assert none.size == 0 and none.collect() == []
    assert len(set(source.rdd.keys().collect())) == 400_000
