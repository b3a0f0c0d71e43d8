import pytest
from pyspark.sql import functions as F

from rowtrail.plans.levels import TraceError, UnsupportedOperatorError
from rowtrail.session import RowTrail
from rowtrail.streaming.history import BATCH, History

SCHEMA = "shop string, item string, price int"
BATCHES = [
    [("north", "a", 3), ("south", "b", 5), (None, "c", 1), ("north", "a", 3)],
    [("south", "d", 9), (None, "e", None)],
    [("north", "f", 7), ("east", "g", None)],
]
AGGREGATES = {"n": ("count", "*"), "priced": ("count", "price"), "total": ("sum", "price"), "least": ("min", "price"), "most": ("max", "price")}


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    """Three batches, each after a new start of the query."""
    folder = tmp_path_factory.mktemp("history")
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        History(RowTrail(spark), f"{folder}/log", ["shop"], AGGREGATES).start(stream, f"{folder}/checkpoint").awaitTermination(60)
    return str(folder)


@pytest.fixture
def history(spark, logged):
    return History(RowTrail(spark), f"{logged}/log", ["shop"], AGGREGATES)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def running(upto):
    """By plain loops."""
    groups = {}
    for rows in BATCHES[: upto + 1]:
        for shop, _, price in rows:
            groups.setdefault(shop, []).append(price)
    out = []
    for shop, prices in groups.items():
        known = [p for p in prices if p is not None]
        out.append((shop, len(prices), len(known), sum(known) if known else None, min(known, default=None), max(known, default=None)))
    return in_order(out)


@pytest.mark.parametrize("upto", [0, 1, 2])
def test_running_results_after_each_batch(history, upto):
    assert in_order(map(tuple, history.result(upto).collect())) == running(upto)


def test_a_running_count_is_traced_to_rows_of_all_batches(history):
    found = history.trace("shop = 'north' AND n = 3").select(BATCH, "shop", "item", "price").collect()
    assert in_order(map(tuple, found)) == in_order((b, *r) for b, rows in enumerate(BATCHES) for r in rows if r[0] == "north")
    assert {r[BATCH] for r in found} == {0, 2}
    assert history.trace("shop = 'north' AND n = 3", upto=1).count() == 0
    assert history.trace("n = 2 AND shop = 'north'", upto=1).count() == 2
    assert history.trace().count() == sum(map(len, BATCHES))


def test_null_keys_are_a_group(history):
    assert sorted(r.item for r in history.trace("shop IS NULL").collect()) == ["c", "e"]


def test_forth_to_each_later_result(history):
    reached = history.reached("item = 'b'").collect()
    assert sorted((r[BATCH], r.shop, r.n, r.total) for r in reached) == [(0, "south", 1, 5), (1, "south", 2, 14)]
    reached = history.reached("item = 'd'").collect()
    assert [(r[BATCH], r.shop, r.n, r.total) for r in reached] == [(1, "south", 2, 14)]
    assert history.reached("item = 'none'").count() == 0


def test_the_log_is_a_traced_source(history):
    prices = history.rows().where("price is not null").group_by("shop").agg(F.max("price").alias("most"))
    back = prices.trace("most = 7").go_back()
    assert sorted(r.price for r in back.show().collect()) == [3, 3, 7]
    assert sorted(i["batch"] for i in (r[0] for r in back.ids.collect())) == [0, 0, 2]


def test_a_batch_that_is_tried_again_keeps_its_rows(spark, history):
    before = in_order(map(tuple, history.rows().df.select(F.to_json("__id"), "item").collect()))
    history.append(spark.createDataFrame(list(reversed(BATCHES[1])), SCHEMA), 1)
    assert in_order(map(tuple, history.rows().df.select(F.to_json("__id"), "item").collect())) == before
    assert in_order(map(tuple, history.result().collect())) == running(2)


def test_a_batch_cut_short_is_written_anew(spark, tmp_path):
    history = History(RowTrail(spark), str(tmp_path / "log"), ["shop"], AGGREGATES)
    history.append(spark.createDataFrame(BATCHES[0], SCHEMA), 0)
    (tmp_path / "log" / "groups" / f"{BATCH}=0" / "_SUCCESS").unlink()
    (tmp_path / "log" / "rows" / f"{BATCH}=0" / "_SUCCESS").unlink()
    history.append(spark.createDataFrame(BATCHES[0], SCHEMA), 0)
    assert in_order(map(tuple, history.result().collect())) == running(0)


def test_only_touched_batches_are_read(history):
    plan = history.trace("shop = 'east'")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_an_empty_batch_and_refusals(spark, tmp_path, history):
    empty = History(RowTrail(spark), str(tmp_path / "log"), ["shop"], AGGREGATES)
    with pytest.raises(TraceError):
        empty.result()
    empty.append(spark.createDataFrame([], SCHEMA), 0)
    assert empty.result().count() == empty.trace().count() == empty.reached("price > 0").count() == 0
    with pytest.raises(UnsupportedOperatorError):
        History(RowTrail(spark), str(tmp_path / "log"), ["shop"], {"m": ("median", "price")})
    with pytest.raises(ValueError):
        History(RowTrail(spark), str(tmp_path / "log"), ["shop"], {"shop": ("count", "*")})
    with pytest.raises(ValueError):
        (tmp_path / "in").mkdir()
        empty.start(spark.readStream.schema(f"{BATCH} int").parquet(str(tmp_path / "in")), str(tmp_path / "c"))
