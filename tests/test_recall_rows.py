"""Witnesses of all result rows: rows that a step has met are not looked up by their ids again."""

import pytest
from made import visits
from pyspark.sql import functions as F

from rowtrail.harness.recall import recall_holds, witnesses
from rowtrail.session import RowTrail


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("how", ["groups", "rollup", "groups of groups"])
def test_all_groups_need_no_ids(spark, how):
    source = RowTrail(spark).frame(spark.createDataFrame(visits(), "shop string, spent int"), "visits")
    made = {
        "groups": lambda s: s["visits"].group_by("shop").agg(F.sum("spent").alias("n")),
        "rollup": lambda s: s["visits"].rollup("shop", "spent").agg(F.count(F.lit(1)).alias("n")),
        "groups of groups": lambda s: s["visits"].group_by("shop").agg(F.count(F.lit(1)).alias("n")).group_by("n").agg(F.count(F.lit(1)).alias("shops")),
    }[how]
    sources = {"visits": source}
    found = witnesses(sources, made(sources), None)["visits"]
    assert joins(found) == 0 and sorted(map(str, found.collect())) == sorted(map(str, source.df.collect()))
    assert recall_holds(None, sources, made, None) if how != "rollup" else True
    some = witnesses(sources, made(sources), "n > 1")["visits"]
    assert 0 < some.count() <= source.df.count() and joins(some) > 0


def test_each_path_to_a_source_gives_its_rows_once(spark):
    source = RowTrail(spark).frame(spark.createDataFrame(visits(), "shop string, spent int"), "visits")
    twice = source.union(source.where("spent > 40")).group_by("shop").agg(F.sum("spent").alias("n"))
    found = witnesses({"visits": source}, twice, None)["visits"]
    assert sorted(map(str, found.collect())) == sorted(map(str, source.df.collect()))
