"""Indexes of whole groups are written as the rows come: none is looked up, and rows with ids of their own are not made distinct."""

import pytest
from pyspark.sql import functions as F

from rowtrail.operators import traced
from rowtrail.plans import index
from rowtrail.session import RowTrail


@pytest.fixture
def plans(monkeypatch):
    """The analysed plan of each index that is written."""
    found = []

    def written_by(df, name, column, write=traced.written_by):
        found.append(df._jdf.queryExecution().analyzed().toString())
        return write(df, name, column)

    monkeypatch.setattr(traced, "written_by", written_by)
    return found


def lines(spark):
    return RowTrail(spark).keyed(spark.range(200).select("id", (F.col("id") % 40 % 17).alias("k")), "id")


def pairs(stored):
    return sorted(map(str, stored.trace().associations().collect()))


def test_indexes_of_all_groups_look_nothing_up(spark, plans):
    sizes = lines(spark).group_by("k").agg(F.count(F.lit(1)).alias("n"))
    for made in (sizes.group_by("n").agg(F.count(F.lit(1)).alias("groups")), lines(spark).select("*").where("k < 9").group_by("k").count()):
        stored = made.indexed(4)
        assert pairs(stored) == pairs(made) and len(pairs(stored)) == len(set(pairs(stored)))
        most = made.result.agg(F.max(made.result.columns[0])).first()[0]
        where = F.col(made.result.columns[0]) == most
        assert sorted(stored.trace(where).go_back_all().collect_ids()) == sorted(made.trace(where).go_back_all().collect_ids()) != []
    assert len(plans) == 3 and not any("LeftSemi" in p or "Distinct" in p or "Deduplicate" in p for p in plans[:2])


def test_chosen_groups_and_repeated_ids_are_still_looked_at(spark, plans):
    twice = lines(spark).explode("copy", F.array(F.lit(1), F.lit(1)))
    chosen = lines(spark).group_by("k").agg(F.count(F.lit(1)).alias("n")).where("n > 12")
    for made in (twice.group_by("k").count(), twice.select("k").distinct(), chosen):
        stored = made.indexed(4, forward=True)
        assert pairs(stored) == pairs(made) != [] and len(pairs(stored)) == len(set(pairs(stored)))
    assert {str(r.output) for r in stored.trace().associations().collect()} == {f"Row(k0={r.k})" for r in chosen.result.collect()}
    assert "LeftSemi" in plans[-1] and "Distinct" in plans[0] + plans[0].replace("Deduplicate", "Distinct")


@pytest.mark.parametrize("few", [0, 10_000])
def test_buckets_are_read_with_few_and_many_ids(spark, monkeypatch, few):
    monkeypatch.setattr(index, "FEW_KEYS", few)
    made = lines(spark).group_by("k").count()
    stored = made.indexed(4, forward=True)
    assert sorted(stored.trace("k in (3, 5)").go_back().collect_ids()) == sorted(made.trace("k in (3, 5)").go_back().collect_ids()) != []
    assert ("ResolvedHint" in stored.trace("k = 3").go_back().ids._jdf.queryExecution().analyzed().toString()) == (few > 0)
