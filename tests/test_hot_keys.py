from collections import Counter

import pytest

from rowtrail.operators.traced_rdd import TracedRDD, among
from rowtrail.plans import hot_keys

HOT = "hot"
LEFT = [(HOT if i % 3 else f"k{i % 50}", i) for i in range(600)] + [(None, 1), ("left only", 2)]
RIGHT = [(HOT if i % 2 else f"k{i % 70}", f"r{i}") for i in range(120)] + [(None, "x"), ("right only", "y"), ("right only", "y")]


def expected(left, right, left_outer, right_outer):
    """The join by plain loops."""
    out = [(a, (x, y)) for a, x in left for b, y in right if a == b]
    if left_outer:
        out += [(a, (x, None)) for a, x in left if a not in {b for b, _ in right}]
    if right_outer:
        out += [(b, (None, y)) for b, y in right if b not in {a for a, _ in left}]
    return Counter(out)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hot_keys.pieces, "__defaults__", (10,))
    monkeypatch.setattr(hot_keys.tiled, "__defaults__", (10,))


@pytest.mark.parametrize("how", ["join", "left_outer_join", "right_outer_join", "full_outer_join"])
@pytest.mark.parametrize("swapped", [False, True])
def test_joins_cut_hot_keys_on_both_sides(spark, small, how, swapped):
    a, b = (RIGHT, LEFT) if swapped else (LEFT, RIGHT)
    left, right = (TracedRDD.parallelize(spark.sparkContext, x, 4) for x in (a, b))
    joined = getattr(left, how)(right)
    assert Counter(joined.collect()) == expected(a, b, how in ("left_outer_join", "full_outer_join"), how in ("right_outer_join", "full_outer_join"))
    back = joined.lineage(lambda kv: kv[0] == HOT)
    assert sorted(back.go_back(0).ids.collect()) == [i for i, (k, _) in enumerate(a) if k == HOT]
    assert sorted(back.go_back(1).ids.collect()) == [i for i, (k, _) in enumerate(b) if k == HOT]


def test_no_task_gets_all_records_of_a_hot_key(spark, small):
    left, right = (TracedRDD.parallelize(spark.sparkContext, x, 4) for x in (LEFT, RIGHT))
    tiles = hot_keys.tiled(left.rdd, right.rdd, 10).map(lambda t: (t[0], len(list(t[1])), len(list(t[2])))).collect()
    of_hot = [(a, b) for k, a, b in tiles if k == HOT]
    assert len(of_hot) > 8 and max(a for a, _ in of_hot) < 400 / 3 and max(b for _, b in of_hot) < 60 / 2
    assert sum(a * b for a, b in of_hot) == 400 * 60


def test_subtraction_cuts_hot_keys(spark, small):
    left = TracedRDD.parallelize(spark.sparkContext, LEFT, 4)
    right = TracedRDD.parallelize(spark.sparkContext, [(k, 0) for k, _ in RIGHT if k != HOT] * 3, 4)
    gone = {k for k, _ in RIGHT if k != HOT}
    assert Counter(left.subtract_by_key(right).collect()) == Counter(r for r in LEFT if r[0] not in gone)


def test_pieces_find_each_hot_key_and_no_rare_one(spark):
    keys = ["a"] * 5000 + ["b"] * 1500 + [f"c{i}" for i in range(3500)]
    found = hot_keys.pieces(spark.sparkContext.parallelize(keys, 5), 10, small=1)
    assert set(found) == {"a", "b"} and 5 <= found["a"] <= 7 and found["b"] == 2
    assert hot_keys.pieces(spark.sparkContext.parallelize(keys, 5), 10) == {}
    assert hot_keys.pieces(spark.sparkContext.emptyRDD(), 10) == {}
    assert hot_keys.pieces(spark.sparkContext.parallelize([], 3), 10) == {}


def test_summaries_stay_short_and_are_never_too_high():
    keys = [i % 7 if i % 2 else i for i in range(20_000)]
    total, counts = hot_keys._summary(keys, 50)
    true = Counter(keys)
    assert total == 20_000 and len(counts) <= 50
    assert all(counts[k] <= true[k] for k in counts) and all(true[k] - counts[k] <= 20_000 / 50 for k in true)


def test_records_that_are_lists_or_objects_have_a_piece():
    class Thing:
        pass

    assert 0 <= hot_keys.piece_of((1, ("k", [1, {"a": 2}])), 5) < 5
    assert hot_keys.piece_of((1, ("k", Thing())), 1000) == hot_keys.piece_of((1, ("k", Thing())), 1000)


def test_one_key_of_a_million_by_ten(spark):
    sc = spark.sparkContext
    left = TracedRDD(sc.range(1_000_000, numSlices=8).map(lambda i: (i, ("k", i))))
    right = TracedRDD.parallelize(sc, [("k", n) for n in range(10)], 2)
    joined = left.join(right)
    per_task = joined.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(per_task) == 10_000_000 and max(per_task) < 5_000_000


def test_among_holds_ids_alone(spark):
    sc = spark.sparkContext
    pairs = sc.parallelize([("a", i) for i in range(1000)] + [(None, 1), (("x", 2), 3), (1, 4), ("b", 5)], 3)
    assert sorted(among(pairs, sc.parallelize(["a", None, ("x", 2), 1.0, "zz"], 2)).values().collect()) == sorted([*range(1000), 1, 3, 4])
    assert among(pairs, sc.parallelize([], 1)).collect() == []


def test_partitions_are_mapped_as_they_come(spark):
    lines = TracedRDD.parallelize(spark.sparkContext, list(range(10)), 2)
    assert lines.map_partitions(lambda it: (x * 2 for x in it), one_to_one=True).collect() == [x * 2 for x in range(10)]
    assert lines.map_partitions_with_index(lambda n, it: [(n, x) for x in it], one_to_one=True).collect() == [(x // 5, x) for x in range(10)]
    for wrong in (lambda it: [0 for _ in it] + [1], lambda it: [0 for _ in it][1:], lambda it: [next(it)]):
        with pytest.raises(Exception, match="records came out"):
            lines.map_partitions(wrong, one_to_one=True).collect()
