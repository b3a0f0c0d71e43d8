"""Steps back to the rows of few, large groups deal no rows by the group's key."""

import pytest
from pyspark.sql import functions as F

from rowtrail.session import RowTrail


@pytest.fixture
def rows(spark):
    """Six thousand rows of three groups, and room for two hundred; estimates say nothing about sizes, as for large tables."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # bytes
    trail = RowTrail(spark)
    yield trail.frame(spark.range(6000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("m")), "rows")
    trail.release()
    for k, v in before.items():
        spark.conf.set(k, v)


def joins(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_large_groups_are_not_dealt_by_key(rows):
    groups = rows.group_by("k").agg(F.count(F.lit(1)).alias("n"))
    at = groups.trace("k = 1 and n > 5")
    shown = at.go_back().show()
    assert "SortMergeJoin" not in joins(shown) and sorted(r.id for r in shown.collect()) == list(range(1, 6000, 3))
    pairs = groups.trace("n > 5").associations()
    assert "SortMergeJoin" not in joins(pairs) and pairs.count() == 6000
    cubed = rows.cube("k", "m").agg(F.grouping_id().alias("gid")).trace("gid = 2 and m = 0").go_back().show()
    assert "SortMergeJoin" not in joins(cubed) and cubed.count() == 3000
