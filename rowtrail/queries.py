"""The registered queries of the provenance engine, and DuckDB SQL for the same rows.

Most return the source rows behind some result rows; the SQL finds the same rows
without any provenance.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .faults import oracles
from .faults.isolate import isolate_frame, isolate_sql
from .faults.isolate_rdd import isolate_rdd
from .harness.coverage import coverage
from .harness.recall import recalled
from .operators.traced import Traced
from .operators.traced_rdd import RddCursor, TracedRDD
from .plans import frames
from .session import RowTrail
from .sources.scratch import scratch_path
from .streaming.history import BATCH, History

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, as traced sources."""

    def __init__(self, spark: SparkSession, sf_dir: str, granularity: str = "exact"):
        self.trail, self.sf_dir = RowTrail(spark, granularity), sf_dir

    def __getattr__(self, name: str) -> Traced:
        return self.trail.parquet(f"{self.sf_dir}/{name}.parquet", name)


def query(sql: str | None, granularity: str = "exact"):
    """Register a function of the tables under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir, granularity))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def flags(t: Tables) -> Traced:
    return t.lineitem.group_by("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def trace_filter_project(t):
    found = t.orders.where("o_totalprice > 200000").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("twice"))
    return found.trace("o_orderstatus = 'O'").show()


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R'")
def trace_groupby(t):
    return flags(t).trace("l_returnflag = 'R'").go_back().show()


@query("SELECT * FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)")
def trace_groupby_expression(t):
    years = t.orders.group_by(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    first = years.top(1, F.asc("y"), keys=["y"])
    return first.trace().go_back_all().show()


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 15)")
def trace_having(t):
    return t.orders.group_by("o_custkey").count().having("`count` >= 15").trace().go_back().show()


@query("SELECT * FROM customer")
def trace_global_aggregate(t):
    return t.customer.agg(F.sum("c_acctbal").alias("s")).trace().go_back().show()


@query("SELECT * FROM part WHERE p_brand = (SELECT max(p_brand) FROM part)")
def trace_sort_aggregate(t):
    top = t.part.group_by("p_brand").agg(F.max("p_name").alias("name")).top(1, F.desc("p_brand"), keys=["p_brand"])
    return top.trace().go_back_all().show()


@query("SELECT * FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def trace_collect_list(t):
    lists = t.orders.group_by("o_orderpriority").agg(F.collect_list("o_orderkey").alias("keys"))
    return lists.top(1, F.asc("o_orderpriority"), keys=["o_orderpriority"]).trace().go_back_all().show()


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def trace_distinct(t):
    return t.customer.select("c_mktsegment").distinct().trace("c_mktsegment = 'BUILDING'").go_back().show()


@query("SELECT * FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > (SELECT avg(n) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey)))")
def trace_count_distinct(t):
    parts = t.lineitem.group_by("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))
    mean = parts.result.agg(F.avg("n").alias("mean"))
    return parts.join(t.trail.keyed(mean, "mean", name="mean"), F.col("n") > F.col("mean")).trace().go_back_all().show()


def priced(t: Tables) -> Traced:
    return t.orders.join(t.customer.rename("c_custkey", "o_custkey"), "o_custkey")


@query("SELECT o.* FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 300000")
def trace_join_left(t):
    return priced(t).trace("c_mktsegment = 'MACHINERY' and o_totalprice > 300000").go_back(0).show()


@query("SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def trace_join_right(t):
    return priced(t).trace("c_mktsegment = 'MACHINERY' and o_totalprice > 300000").go_back(1).show()


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "key")
def trace_join_key_granularity(t):
    return priced(t).trace("o_totalprice > 400000").go_back(0).show()


@query("SELECT * FROM orders WHERE o_totalprice > 400000")
def trace_join_exact(t):
    return priced(t).trace("o_totalprice > 400000").go_back(0).show()


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def trace_left_join_unmatched(t):
    joined = t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.trace("o_orderkey is null").go_back(0).show()


@query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def trace_right_join_unmatched(t):
    rich = t.customer.where("c_acctbal > 5000")
    return rich.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "right").trace("c_custkey is null").go_back(1).show()


@query("SELECT 0 AS side, count(*) AS n FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) UNION ALL SELECT 1, count(*) FROM orders WHERE o_totalprice > 350000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def trace_full_join_unmatched(t):
    joined = t.customer.where("c_acctbal > 9000").join(t.orders.where("o_totalprice > 350000"), F.col("c_custkey") == F.col("o_custkey"), "full")
    alone = joined.trace("c_custkey is null or o_custkey is null")
    sides = [alone.go_back(i).show().agg(F.lit(i).alias("side"), F.count(F.lit(1)).alias("n")) for i in (0, 1)]
    return sides[0].union(sides[1])


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)")
def trace_semi_join_right(t):
    rich = t.customer.where("c_acctbal > 9500")
    return rich.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "semi").trace().go_back(1).show()


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def trace_anti_join(t):
    large = t.orders.where("o_totalprice > 300000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "anti").trace().go_back(0).show()


@query("SELECT DISTINCT s.* FROM supplier s JOIN customer c ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal WHERE c_mktsegment = 'FURNITURE'")
def trace_theta_join(t):
    near = t.supplier.less_join(t.customer, F.col("s_acctbal"), F.col("c_acctbal"), on=[("s_nationkey", "c_nationkey")])
    return near.trace("c_mktsegment = 'FURNITURE'").go_back(0).show()


@query("SELECT n.* FROM nation n, region r WHERE r_name = 'ASIA'")
def trace_cross_join(t):
    return t.nation.cross_join(t.region).trace("r_name = 'ASIA'").go_back(0).show()


@query("SELECT b.* FROM customer b WHERE EXISTS (SELECT * FROM customer a WHERE a.c_nationkey = b.c_nationkey AND a.c_acctbal > 9900)")
def trace_self_join(t):
    other = t.customer.select(F.col("c_nationkey"), F.col("c_acctbal").alias("other"))
    return other.join(t.customer, "c_nationkey").trace("other > 9900").go_back(1).show()


def totals(t: Tables) -> Traced:
    return priced(t).group_by("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o.* FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE'")
def trace_join_then_aggregate(t):
    return totals(t).trace("c_mktsegment = 'AUTOMOBILE'").go_back().go_back(0).show()


@query("SELECT * FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_custkey IN (SELECT o_custkey FROM orders)")
def trace_join_then_aggregate_right(t):
    return totals(t).trace("c_mktsegment = 'AUTOMOBILE'").go_back().go_back(1).show()


@query("SELECT * FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)))")
def trace_nested_aggregate(t):
    sizes = t.lineitem.group_by("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = sizes.group_by("n").agg(F.count(F.lit(1)).alias("orders"))
    return orders.top(1, F.desc("n"), keys=["n"]).trace().go_back_all().show()


@query("SELECT o.* FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE'")
def trace_indexed(t):
    """From a stored index: the join and the aggregate are not computed again."""
    return totals(t).indexed().trace("c_mktsegment = 'AUTOMOBILE'").go_back().go_back(0).show()


@query("SELECT DISTINCT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 398000")
def forward_indexed(t):
    back = totals(t).indexed(forward=True).trace().go_back().go_back(0)
    return back.where("o_totalprice > 398000").go_next().go_next().show("c_mktsegment")


@query("SELECT * FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)))")
def trace_indexed_nested(t):
    """An index for each of two aggregates."""
    sizes = t.lineitem.group_by("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = sizes.group_by("n").agg(F.count(F.lit(1)).alias("orders")).indexed()
    most = orders.result.agg(F.max("n")).first()[0]
    return orders.trace(F.col("n") == most).go_back_all().show()


def rolled(t: Tables) -> Traced:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query("SELECT * FROM lineitem")
def trace_rollup_total(t):
    return rolled(t).trace("gid = 3").go_back().show()


@query("SELECT * FROM lineitem WHERE l_returnflag = 'A'")
def trace_rollup_detail(t):
    return rolled(t).trace("gid = 1 and l_returnflag = 'A'").go_back().show()


@query("SELECT * FROM lineitem WHERE l_linestatus = 'F'")
def trace_cube(t):
    cubed = t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    return cubed.trace("gid = 2 and l_linestatus = 'F'").go_back().show()


@query("SELECT * FROM orders WHERE o_orderstatus = 'P'")
def trace_grouping_sets(t):
    sets = t.orders.grouping_sets([[0], [1]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return sets.trace("o_orderstatus = 'P'").go_back().show()


def ranked(t: Tables, **how) -> Traced:
    return t.customer.with_windows(["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], rank=F.rank(), **how)


@query("SELECT * FROM customer WHERE c_nationkey IN (3, 7)")
def trace_window_peers(t):
    return ranked(t).trace("rank = 1 and c_nationkey in (3, 7)").go_back().show()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 2")
def trace_window_own_row(t):
    return ranked(t, own_row=True).trace("rank <= 2").go_back().show()


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def trace_topk(t):
    return t.orders.top(20, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey").trace().go_back().show()


@query("SELECT * FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 1)", "key")
def trace_topk_peers(t):
    return t.customer.top(1, F.asc("c_nationkey"), F.asc("c_custkey"), keys=["c_nationkey"]).trace().go_back().show()


def names(t: Tables) -> Traced:
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).union(t.supplier.select("s_nationkey", "s_acctbal"))


@query("SELECT * FROM customer WHERE c_acctbal < 0")
def trace_union_first(t):
    return names(t).trace("balance < 0").go_back(0).show()


@query("SELECT * FROM supplier WHERE s_acctbal > 0")
def trace_union_second(t):
    return names(t).trace("balance > 0").go_back(1).show()


@query("SELECT * FROM supplier WHERE s_nationkey BETWEEN 5 AND 14")
def trace_union_aggregate(t):
    sums = names(t).group_by("nation").agg(F.round(F.sum("balance"), 2).alias("sum"))
    return sums.trace("nation between 5 and 14").go_back().go_back(1).show()


@query("SELECT * FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def trace_intersect(t):
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")).trace().go_back(0).show()


@query("SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def trace_except(t):
    return t.nation.select("n_nationkey").subtract(t.supplier.where("s_acctbal > 8000").select("s_nationkey")).trace().go_back(0).show()


@query("SELECT DISTINCT p.* FROM part p WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def trace_explode(t):
    words = t.part.explode("word", F.split("p_name", " ")).group_by("word").agg(F.count(F.lit(1)).alias("n"))
    first = t.part.result.agg(F.split(F.min("p_name"), " ")[0].alias("word"))
    return words.join(t.trail.keyed(first, "word", name="first"), "word").trace().go_back(0).go_back().show()


@query("SELECT * FROM customer WHERE length(c_name) % 3 = 0")
def trace_udf(t):
    @F.pandas_udf("long")
    def rest(names: pd.Series) -> pd.Series:
        return names.str.len() % 3

    return t.customer.with_column("rest", rest("c_name")).where("rest = 0").select("c_custkey").trace().show()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 5")
def trace_frame_source(t):
    held = t.supplier.result.cache()
    cached = t.trail.frame(held, "cached")
    held.unpersist()
    return cached.group_by("s_nationkey").count().trace("s_nationkey < 5").go_back().show()


@query("SELECT DISTINCT l_returnflag FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.09")
def forward_from_source(t):
    groups = flags(t)
    back = groups.trace().go_back()
    reached = back.where("l_quantity > 49.5 and l_discount > 0.09").go_next()
    return reached.ids.select(F.col("__id.k0").alias("l_returnflag"))


@query("SELECT 'orders' AS source, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)")
def all_sources_frontier(t):
    found = totals(t).trace("c_mktsegment = 'BUILDING'").all_sources()
    counts = [rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n")) for name, rows in found]
    return counts[0].union(counts[1])


@query("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def reexecution_recall(t):
    """The result row again, from its witnesses alone."""
    return recalled(t.trail, {"orders": t.orders, "customer": t.customer}, lambda s: s["orders"].join(s["customer"].rename("c_custkey", "o_custkey"), "o_custkey").group_by("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), "c_mktsegment = 'BUILDING'")


@query("""
SELECT 'pricing_summary' AS shape, n AS rows, n AS recalled FROM (SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem)
UNION ALL SELECT 'shipping_priority', n, n FROM (SELECT least(10, count(DISTINCT l_orderkey)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT 'order_priority', n, n FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48))
UNION ALL SELECT 'local_volume', n, n FROM (SELECT count(DISTINCT n_name) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
UNION ALL SELECT 'customer_distribution', n, n FROM (SELECT count(DISTINCT k) AS n FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1))
UNION ALL SELECT 'large_orders', n, n FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200))
UNION ALL SELECT 'ranked_customers', n, n FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer)
UNION ALL SELECT 'sales_by_flag_and_status', n, n FROM (SELECT count(DISTINCT (l_returnflag, l_linestatus)) + count(DISTINCT l_returnflag) + 1 AS n FROM lineitem)
""")
def coverage_recall(t):
    """Result rows of typical shapes, and how many come again from their witnesses alone: all of them."""
    return coverage(t.trail, lambda name: getattr(t, name))


@query("SELECT * FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def isolate_maximum(t):
    """The order that makes a customer's largest price the largest of all."""
    most = t.orders.result.agg(F.max("o_totalprice")).first()[0]
    found = isolate_frame(t.trail, t.orders, lambda o: o.group_by("o_custkey").agg(F.max("o_totalprice").alias("largest")), F.col("largest") >= most)
    return found.culprits


# answers with row ids carried along equal plain answers


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def answer_aggregate(t):
    rows = t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").group_by("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")).result


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def answer_joins(t):
    named = priced(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.group_by("n_name").agg(F.count(F.lit(1)).alias("orders")).result


@query("SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def answer_intersect_all(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect_all(t.customer.where("c_acctbal > 9000").select("c_nationkey")).result


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT ALL SELECT s_nationkey FROM supplier")
def answer_except_all(t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).except_all(t.supplier.select("s_nationkey")).result


# sorts, limits, windows and set operations beyond the plain ones


@query("SELECT * FROM orders WHERE o_totalprice > 390000")
def trace_global_sort(t):
    return t.orders.order_by(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").trace("o_totalprice > 390000").show()


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 30")
def trace_limit(t):
    return t.orders.order_by("o_orderkey").limit(30).trace().show()


@query("SELECT * FROM supplier WHERE s_nationkey < 6")
def trace_union_distinct(t):
    keys = t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()
    return keys.trace("k < 6").go_back().go_back(1).show()


@query("SELECT * FROM supplier")
def trace_window_without_partition(t):
    return t.supplier.with_windows([], [F.desc("s_acctbal"), "s_suppkey"], place=F.row_number()).trace("place = 1").go_back().show()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM customer) WHERE running < 0")
def trace_window_frame(t):
    framed = t.customer.with_windows(["c_nationkey"], ["c_custkey"], own_row=True, running=lambda w: F.sum("c_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return framed.trace("running < 0").go_back().show()


@query("SELECT * FROM customer WHERE c_acctbal > 9000 AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def trace_intersect_all(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect_all(t.customer.where("c_acctbal > 9000").select("c_nationkey")).trace().go_back(1).show()


@query("SELECT * FROM customer WHERE c_acctbal > 9000 AND c_nationkey IN (SELECT c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT ALL SELECT s_nationkey FROM supplier))")
def trace_except_all(t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).except_all(t.supplier.select("s_nationkey")).trace().go_back(0).show()


# windows whose frames' rows alone are witnesses


def spending(t: Tables, frame: frames.Frame, **columns) -> Traced:
    return t.orders.with_windows(["o_custkey"], ["o_orderkey"], frame=frame, **columns)


@query("WITH o AS (SELECT *, row_number() OVER w AS place, sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), hit AS (SELECT * FROM o WHERE recent > 900000) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM o WHERE EXISTS (SELECT * FROM hit WHERE hit.o_custkey = o.o_custkey AND o.place BETWEEN hit.place - 2 AND hit.place)")
def trace_rows_frame(t):
    recent = spending(t, frames.rows_frame(-2, 0), recent=F.sum("o_totalprice"))
    return recent.trace("recent > 900000").go_back().show()


@query("WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 5000 PRECEDING AND 20000 FOLLOWING) AS near FROM orders), hit AS (SELECT * FROM o WHERE near >= 4) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM o WHERE EXISTS (SELECT * FROM hit WHERE hit.o_custkey = o.o_custkey AND o.o_totalprice BETWEEN hit.o_totalprice - 5000 AND hit.o_totalprice + 20000)")
def trace_range_frame(t):
    near = t.orders.with_windows(["o_custkey"], ["o_totalprice"], frame=frames.range_frame(-5000, 20000), near=F.count(F.lit(1)))
    return near.trace("near >= 4").go_back().show()


@query("WITH p AS (SELECT *, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM part), hit AS (SELECT * FROM p WHERE p_size = 9) SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM p WHERE EXISTS (SELECT * FROM hit WHERE hit.p_brand = p.p_brand AND p.p_size <= hit.p_size)")
def trace_range_ties(t):
    """Rows with equal sort values are peers: all or none are in the frame."""
    rest = t.part.with_windows(["p_brand"], ["p_size"], frame=frames.range_frame(0, frames.FOLLOWING, descending=True), rest=F.sum("p_retailprice"))
    return rest.trace("p_size = 9").go_back().show()


@query("WITH o AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM o WHERE o_totalprice > 50 * before OR next IN (SELECT o_orderkey FROM o WHERE o_totalprice > 50 * before)")
def trace_lag(t):
    """The row and the one before it."""
    jumps = spending(t, frames.rows_frame(-1, -1), before=lambda w: F.lag("o_totalprice").over(w))
    return jumps.trace("o_totalprice > 50 * before").go_back().show()


@query("WITH o AS (SELECT *, row_number() OVER w AS place, lead(o_orderstatus, 2) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), hit AS (SELECT * FROM o WHERE later = 'P' AND o_orderstatus = 'P') SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM o WHERE EXISTS (SELECT * FROM hit WHERE hit.o_custkey = o.o_custkey AND o.place IN (hit.place, hit.place + 2))")
def trace_lead(t):
    later = spending(t, frames.rows_frame(2, 2), later=lambda w: F.lead("o_orderstatus", 2).over(w))
    return later.trace("later = 'P' and o_orderstatus = 'P'").go_back().show()


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), hit AS (SELECT * FROM o WHERE o_totalprice > 395000) SELECT o_orderkey FROM o WHERE EXISTS (SELECT * FROM hit WHERE hit.o_custkey = o.o_custkey AND hit.place BETWEEN o.place - 2 AND o.place)")
def forward_rows_frame(t):
    """The rows into whose sums a large order goes."""
    recent = spending(t, frames.rows_frame(-2, 0), recent=F.sum("o_totalprice"))
    reached = recent.trace().go_back().where("o_totalprice > 395000").go_next()
    return reached.show("o_orderkey")


@query("WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 5000 PRECEDING AND 20000 FOLLOWING) AS near FROM orders) SELECT o_orderkey, near FROM o WHERE near >= 3")
def associations_of_frames(t):
    """Pairs of each row with those of its frame, counted."""
    near = t.orders.with_windows(["o_custkey"], ["o_totalprice"], frame=frames.range_frame(-5000, 20000), near=F.count(F.lit(1)))
    at = near.trace("near >= 3")
    counts = at.associations().groupBy("output").agg(F.count(F.lit(1)).alias("near"))
    return near.df.select("o_orderkey", "__id").join(counts, F.col("__id") == F.col("output")).select("o_orderkey", "near")


# joins and aggregates beyond the plain ones


def indebted(t: Tables) -> Traced:
    poor = t.customer.where("c_acctbal < -900")
    return t.orders.exists(poor, F.col("o_custkey") == F.col("c_custkey"), "poor")


@query("SELECT * FROM orders WHERE o_totalprice > 395000 OR EXISTS (SELECT * FROM customer WHERE c_custkey = o_custkey AND c_acctbal < -900)")
def trace_existence_join(t):
    return indebted(t).where("poor or o_totalprice > 395000").trace().go_back(0).show()


@query("SELECT * FROM customer WHERE c_acctbal < -900 AND c_custkey IN (SELECT o_custkey FROM orders)")
def trace_existence_join_right(t):
    return indebted(t).where("poor or o_totalprice > 395000").trace().go_back(1).show()


def above_mean(t: Tables) -> Traced:
    """Rich customers' balances against the mean of all."""
    return t.customer.scalar("mean", t.customer.agg(F.avg("c_acctbal").alias("mean")), "mean")


@query("SELECT * FROM customer WHERE c_acctbal > 1.9 * (SELECT avg(c_acctbal) FROM customer) AND c_nationkey = 5")
def trace_scalar_where(t):
    """A scalar subquery in a condition: the rows themselves."""
    return above_mean(t).where("c_acctbal > 1.9 * mean").trace("c_nationkey = 5").go_back(0).show()


@query("SELECT * FROM customer")
def trace_scalar_where_subquery(t):
    """Behind the subquery's one row stand all rows that it reads."""
    return above_mean(t).where("c_acctbal > 1.9 * mean").trace("c_nationkey = 5").go_back(1).go_back().show()


@query("SELECT * FROM supplier WHERE s_nationkey < 20")
def trace_scalar_select(t):
    """A scalar subquery in the select list, below an aggregate."""
    most = t.supplier.where("s_nationkey < 20").agg(F.max("s_acctbal").alias("most"))
    share = t.nation.scalar("most", most, "most").select("n_regionkey", (F.col("n_nationkey") / F.col("most")).alias("share"))
    return share.group_by("n_regionkey").agg(F.sum("share").alias("s")).trace("n_regionkey = 2").go_back().go_back(1).go_back().show()


def small_quantities(t: Tables) -> Traced:
    mean = t.lineitem.group_by("l_partkey").agg(F.avg("l_quantity").alias("mean"))
    return t.lineitem.scalar("mean", mean, "mean", on={"l_partkey": "l_partkey"}).where("l_quantity < 0.05 * mean")


@query("SELECT * FROM lineitem a WHERE l_quantity < 0.05 * (SELECT avg(l_quantity) FROM lineitem b WHERE a.l_partkey = b.l_partkey) AND l_returnflag = 'R'")
def trace_scalar_correlated(t):
    return small_quantities(t).trace("l_returnflag = 'R'").go_back(0).show()


@query("SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem a WHERE l_quantity < 0.05 * (SELECT avg(l_quantity) FROM lineitem b WHERE a.l_partkey = b.l_partkey) AND l_returnflag = 'R')")
def trace_scalar_correlated_subquery(t):
    """Behind the correlated subquery stands the group of the row's own key."""
    return small_quantities(t).trace("l_returnflag = 'R'").go_back(1).go_back().show()


def variety(t: Tables) -> Traced:
    counts = {"parts": "l_partkey", "days": F.to_date("l_shipdate")}
    return t.lineitem.group_by("l_suppkey").agg_distinct(counts, F.sum("l_quantity").alias("quantity"))


@query("SELECT DISTINCT l_suppkey, l_partkey AS parts FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 545)")
def trace_distinct_values(t):
    """One hop: the distinct values that were counted."""
    return variety(t).trace("parts > 545").go_back(0).show()


@query("SELECT * FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 545) AND l_partkey < 300")
def trace_distinct_rows(t):
    """Two hops: the rows that have some of the values."""
    return variety(t).trace("parts > 545").go_back(0).where("parts < 300").go_back().show()


@query("SELECT * FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT CAST(l_shipdate AS DATE)) > 575)")
def trace_distinct_second(t):
    """The second counted column is a branch of its own."""
    return variety(t).trace("days > 575").go_back(1).go_back().show()


@query("SELECT * FROM lineitem WHERE l_suppkey = 7")
def trace_distinct_plain_branch(t):
    """Plain aggregates beside the counts lead to the rows at once."""
    return variety(t).trace("l_suppkey = 7 and quantity > 0").go_back(2).show()


# lateral joins and table functions


def latest_orders(t: Tables, how: str = "inner", least: int = 0) -> Traced:
    """Each customer of nation 4 with the two latest orders of some price."""
    own = t.orders.where(F.col("o_totalprice") >= least).where(F.col("o_custkey") == F.col("c_custkey").outer()).nearest(2, F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.customer.where("c_nationkey = 4").lateral_join(own, how=how)


LATEST = "SELECT * FROM (SELECT * FROM customer WHERE c_nationkey = 4) c {} JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= {} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2) o ON true"


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM ({LATEST.format('', 0)}) WHERE o_totalprice > 100000")
def trace_lateral_join(t):
    return latest_orders(t).trace("o_totalprice > 100000").go_back(1).show()


@query(f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM ({LATEST.format('LEFT', 300000)}) WHERE o_orderkey IS NULL")
def trace_lateral_left_join(t):
    return latest_orders(t, "left", 300_000).trace("o_orderkey is null").go_back(0).show()


@F.udtf(returnType="word string")
class Words:
    def eval(self, text: str):
        for word in (text or "").split(" "):
            yield (word,)


@F.udtf(returnType="c_nationkey int, debts double")
class Debts:
    """Sums what the rows of one nation owe."""

    def __init__(self):
        self.nation, self.debts = None, 0.0

    def eval(self, row):
        self.nation, self.debts = row["c_nationkey"], self.debts + min(row["c_acctbal"], 0)

    def terminate(self):
        yield self.nation, self.debts


@query("SELECT DISTINCT p.* FROM part p WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def trace_table_function(t):
    """A Python table function called for each row, below an aggregate."""
    words = t.part.lateral_join(Words(F.col("p_name").outer()), granularity="row").group_by("word").count()
    first = t.part.result.agg(F.split(F.min("p_name"), " ")[0]).first()[0]
    return words.trace(F.col("word") == first).go_back().show()


@query("SELECT * FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING sum(least(c_acctbal, 0)) < -3600)")
def trace_table_function_groups(t):
    return t.customer.table_function(Debts, keys=["c_nationkey"], granularity="group").trace("debts < -3600").go_back().show()


# range and as-of joins


def near_balances(t: Tables, how: str = "inner") -> Traced:
    return t.customer.range_join(t.supplier, F.col("c_acctbal"), F.col("s_acctbal") - F.col("s_suppkey"), F.col("s_acctbal") + 20, how=how)


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - s_suppkey AND s_acctbal + 20")
def answer_range_join(t):
    return near_balances(t).select("c_custkey", "s_suppkey").result


@query("SELECT DISTINCT supplier.* FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - s_suppkey AND s_acctbal + 20 WHERE c_nationkey = 3")
def trace_range_join(t):
    return near_balances(t).trace("c_nationkey = 3").go_back(1).show()


@query("SELECT customer.* FROM customer LEFT JOIN supplier ON c_acctbal BETWEEN s_acctbal - s_suppkey AND s_acctbal + 20 WHERE s_suppkey IS NULL")
def trace_range_join_unmatched(t):
    return near_balances(t, "left").trace("s_suppkey is null").go_back(0).show()


def last_view(t: Tables, **how) -> Traced:
    """Each purchase with the user's last view before it."""
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    return t.events.where("event_type = 'purchase'").asof_join(views, "ts", "seen", ["user_id"], ties=["view_id"], **how)


LAST_VIEW = "SELECT p.*, v.ts AS seen, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL (SELECT ts, event_id FROM events v WHERE event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true"


@query(f"SELECT event_id, view_id, seen FROM ({LAST_VIEW})")
def answer_asof_join(t):
    return last_view(t).select("event_id", "view_id", "seen").result


@query(f"SELECT e.* FROM events e WHERE event_id IN (SELECT view_id FROM ({LAST_VIEW}) WHERE value > 50)")
def trace_asof_join(t):
    """Time is cut into weeks, which changes no row."""
    return last_view(t, every=604800).trace("value > 50").go_back(1).show()


@query(f"SELECT event_id, ts, user_id, event_type, value, props FROM ({LAST_VIEW}) WHERE view_id IS NULL")
def trace_asof_join_unmatched(t):
    return last_view(t, every=86400).trace("view_id is null").go_back(0).show()


@query("SELECT * FROM lineitem WHERE l_linestatus = 'O'")
def trace_approximate_aggregates(t):
    made = t.lineitem.group_by("l_linestatus").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("middle"), F.stddev_samp("l_tax").alias("spread"))
    return made.trace("l_linestatus = 'O' and parts > 1").go_back().show()


@query("SELECT CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS class, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS price, round(stddev_samp(p_size), 6) AS spread, count(DISTINCT upper(substr(p_name, 1, 1))) AS initials, max(abs(coalesce(p_size, 0) - 25)) AS far FROM part WHERE p_type LIKE '%A%' AND p_size BETWEEN 3 AND 45 GROUP BY 1")
def answer_functions(t):
    kept = t.part.where("p_type LIKE '%A%' AND p_size BETWEEN 3 AND 45")
    return kept.group_by(F.when(F.col("p_size") < 10, "small").otherwise("large").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("p_retailprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("price"), F.round(F.stddev_samp("p_size"), 6).alias("spread"),
        F.count_distinct(F.upper(F.substring("p_name", 1, 1))).alias("initials"), F.max(F.abs(F.coalesce("p_size", F.lit(0)) - 25)).alias("far"),
    ).result


@query("SELECT * FROM orders WHERE o_orderdate + INTERVAL 90 DAY > (SELECT max(o_orderdate) FROM orders) AND o_orderstatus = 'O'")
def trace_interval(t):
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    recent = t.orders.cross_join(last).where("o_orderdate + INTERVAL 90 DAY > last").group_by("o_orderstatus").count()
    return recent.trace("o_orderstatus = 'O'").go_back().go_back(0).show()


@query("SELECT * FROM customer WHERE c_nationkey = 4")
def trace_grouped_map(t):
    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_nationkey": rows.c_nationkey[:1], "total": [rows.c_acctbal.sum()]})

    return t.customer.apply_in_pandas(["c_nationkey"], summed, "c_nationkey int, total double").trace("c_nationkey = 4").go_back().show()


@query("SELECT * FROM nation WHERE length(n_name) > 6")
def trace_python_udf(t):
    size = F.udf(len, "int")
    return t.nation.with_column("size", size("n_name")).where("size > 6").select("n_nationkey").trace().show()


@query("SELECT DISTINCT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 398000")
def forward_through_a_join(t):
    back = totals(t).trace().go_back().go_back(0)
    reached = back.where("o_totalprice > 398000").go_next().go_next()
    return reached.ids.select(F.col("__id.k0").alias("c_mktsegment"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def associations_of_groups(t):
    """Pairs of each group with the rows behind it, counted."""
    pairs = flags(t).trace().associations()
    return pairs.groupBy(F.col("output.k0").alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 350000")
def export_associations(t):
    """Pairs of joined rows and customers, written as CSV and read back."""
    at, path = priced(t).trace("o_totalprice > 350000"), scratch_path(t.trail.spark, "pairs")
    at.save_associations_csv(path, branch=1)
    pairs = t.trail.spark.read.csv(path, header=True)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("input").alias("customers"))


@query("SELECT * FROM nation")
def trace_mapped_in_pandas(t):
    """An opaque map over the whole input, declared so: every row stands behind its result."""

    def least(frames):
        for rows in frames:
            yield rows[rows.n_nationkey == 7][["n_nationkey"]]

    return t.nation.map_in_pandas(least, "n_nationkey int", granularity="all").trace("n_nationkey = 7").go_back().show()


@query("SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def trace_repartitioned(t):
    return t.orders.repartition(5, "o_custkey").where("o_totalprice > 200000").select("o_orderstatus").trace("o_orderstatus = 'P'").show()


@query("SELECT * FROM customer WHERE c_acctbal > 9000 AND c_nationkey IN (1, 2)")
def trace_intersection(t):
    """The rows that two traces share."""
    customers = t.customer
    by_nation = customers.group_by("c_nationkey").count().trace("c_nationkey in (1, 2)").go_back()
    return by_nation.intersection(customers.where("c_acctbal > 9000").trace()).show()


# sources in other formats: the table is written in the format and read back as a source


def as_files(t: Tables, table: str, kind: str) -> str:
    path = scratch_path(t.trail.spark, f"{table}-{kind}")
    getattr(t, table).result.write.format(kind).save(path)
    return path


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 9000")
def trace_csv_in_place(t):
    """CSV files with headers, read where they are; only the files that hold the rows are looked into."""
    path = scratch_path(t.trail.spark, "supplier-csv")
    t.supplier.result.repartition(3, "s_nationkey").write.csv(path, header=True)
    read = t.trail.csv(path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", header=True)
    return read.where("s_acctbal > 9000").select("s_suppkey").trace().show(pruned=True)


@query("SELECT * FROM supplier WHERE s_nationkey = 3")
def trace_csv_source(t):
    read = t.trail.csv(as_files(t, "supplier", "csv"), "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return read.group_by("s_nationkey").count().trace("s_nationkey = 3").go_back().show()


@query("SELECT * FROM supplier WHERE s_nationkey = 5")
def trace_json_source(t):
    read = t.trail.json(as_files(t, "supplier", "json"), "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return read.group_by("s_nationkey").count().trace("s_nationkey = 5").go_back().show()


@query("SELECT * FROM customer WHERE c_nationkey = 6")
def trace_orc_source(t):
    return t.trail.orc(as_files(t, "customer", "orc")).group_by("c_nationkey").count().trace("c_nationkey = 6").go_back().show()


@query("SELECT DISTINCT p_name AS value FROM part WHERE list_contains(string_split(p_name, ' '), split_part((SELECT max(p_name) FROM part), ' ', 1))")
def trace_text_source(t):
    path = scratch_path(t.trail.spark, "lines")
    t.part.result.select("p_name").write.text(path)
    words = t.trail.text(path).explode("word", F.split("value", " ")).group_by("word").count()
    last = t.part.result.agg(F.split(F.max("p_name"), " ")[0].alias("word"))
    return words.join(t.trail.keyed(last, "word", name="last"), "word").trace().go_back(0).go_back().show().distinct()


# fault isolation


@query("SELECT * FROM orders WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 2) AND o_custkey = (SELECT o_custkey FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r = 2 ORDER BY o_totalprice DESC LIMIT 1)")
def isolate_two_rows(t):
    """The two orders that together make a customer's second largest price the largest of all."""
    second = lambda o: o.group_by("o_custkey").agg(F.get(F.sort_array(F.collect_list("o_totalprice"), False), F.lit(1)).alias("second"))
    most = second(t.orders).result.agg(F.max("second")).first()[0]
    return isolate_frame(t.trail, t.orders, second, F.col("second") >= most).culprits


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def isolate_missing(t):
    """The nation for which a share has no value."""
    shares = lambda n: n.select("n_regionkey", F.try_divide(F.lit(1.0), F.col("n_nationkey") - 7).alias("share"))
    return isolate_frame(t.trail, t.nation, shares, oracles.missing("share")).culprits


@query("SELECT * FROM supplier WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier)")
def isolate_by_sql(t):
    """The supplier with the least balance, by SQL text over a view."""
    sql, base = "SELECT s_nationkey, min(s_acctbal) AS least FROM traced_supplier GROUP BY s_nationkey", t.supplier.result
    base.createOrReplaceTempView("traced_supplier")
    return isolate_sql(t.trail, "traced_supplier", base, sql, oracles.lowest(t.trail.spark.sql(sql), "least")).culprits


@query("SELECT * FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)")
def isolate_far_from_median(t):
    """The customer whose balance puts a nation's largest balance furthest from the median of all nations' largest ones."""
    largest = lambda c: c.group_by("c_nationkey").agg(F.max("c_acctbal").alias("largest"))
    rows = largest(t.customer).result
    most, deviation, n = rows.agg(F.max("largest"), F.stddev_pop("largest"), F.count("largest")).first()
    middle = rows.orderBy("largest").select("largest").offset(n // 2).first()[0]
    k = (most - middle) / deviation * (1 - 1e-9)
    above = F.col("largest") > middle
    return isolate_frame(t.trail, t.customer, largest, oracles.far_from_median(rows, "largest", k) & above).culprits


# RDD pipelines over the tables' records


def records(t: Tables, table: str, *columns: str) -> TracedRDD:
    """The rows of some columns as tuples."""
    return TracedRDD.of_frame(getattr(t, table).result.select(*columns))


def shown(t: Tables, at: RddCursor, schema: str) -> DataFrame:
    # of a frame's own rows, whose types need no check
    return t.trail.spark.createDataFrame(at.show_source(), schema, verifySchema=False)


ORDER = "o_orderkey long, o_custkey long, o_totalprice double"


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 380000")
def rdd_filter(t):
    return shown(t, records(t, "orders", "o_orderkey", "o_custkey", "o_totalprice").filter(lambda r: r[2] > 380000).lineage(), ORDER)


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def rdd_word_count(t):
    parts = records(t, "part", "p_partkey", "p_name")
    counts = parts.flat_map(lambda r: r[1].split(" ")).map(lambda w: (w, 1)).reduce_by_key(lambda a, b: a + b)
    first = t.part.result.agg(F.split(F.min("p_name"), " ")[0]).first()[0]
    return shown(t, counts.lineage(lambda kv: kv[0] == first).go_back(), "p_partkey long, p_name string")


def by_customer(t: Tables) -> TracedRDD:
    return records(t, "orders", "o_orderkey", "o_custkey", "o_totalprice").key_by(lambda r: r[1])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000)")
def rdd_aggregate_by_key(t):
    pairs = records(t, "orders", "o_orderkey", "o_custkey", "o_totalprice").key_by(lambda r: r[1])
    sums = pairs.aggregate_by_key(0.0, lambda a, r: a + r[2], lambda a, b: a + b)
    return shown(t, sums.lineage(lambda kv: kv[1] > 3_000_000).go_back(), ORDER)


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 300000)")
def rdd_combine_by_key(t):
    pairs = records(t, "orders", "o_custkey", "o_totalprice")
    means = pairs.combine_by_key(lambda v: (v, 1), lambda a, v: (a[0] + v, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1])).map_values(lambda a: a[0] / a[1])
    return shown(t, means.lineage(lambda kv: kv[1] > 300000).go_back(), "o_custkey long, o_totalprice double")


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 16)")
def rdd_group_by_key(t):
    groups = records(t, "orders", "o_custkey", "o_totalprice").group_by_key()
    return shown(t, groups.lineage(lambda kv: len(kv[1]) >= 16).go_back(), "o_custkey long, o_totalprice double")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def rdd_distinct(t):
    segments = records(t, "customer", "c_custkey", "c_mktsegment").map(lambda r: r[1]).distinct()
    return shown(t, segments.lineage(lambda s: s == "HOUSEHOLD").go_back(), "c_custkey long, c_mktsegment string")


def rdd_priced(t: Tables) -> TracedRDD:
    return records(t, "orders", "o_custkey", "o_totalprice").join(records(t, "customer", "c_custkey", "c_mktsegment"))


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 385000)")
def rdd_join_left(t):
    """With the granularity of the key: all orders of the customer."""
    return shown(t, rdd_priced(t).lineage(lambda kv: kv[1][0] > 385000).go_back(0), "o_custkey long, o_totalprice double")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 385000)")
def rdd_join_right(t):
    return shown(t, rdd_priced(t).lineage(lambda kv: kv[1][0] > 385000).go_back(1), "c_custkey long, c_mktsegment string")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rdd_left_outer_join(t):
    large = records(t, "orders", "o_custkey", "o_totalprice").filter(lambda r: r[1] > 300000)
    joined = records(t, "customer", "c_custkey", "c_mktsegment").left_outer_join(large)
    return shown(t, joined.lineage(lambda kv: kv[1][1] is None).go_back(0), "c_custkey long, c_mktsegment string")


def large_orders(t: Tables) -> TracedRDD:
    return records(t, "orders", "o_custkey", "o_totalprice").filter(lambda r: r[1] > 350000)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def rdd_right_outer_join(t):
    joined = large_orders(t).right_outer_join(records(t, "customer", "c_custkey", "c_mktsegment"))
    return shown(t, joined.lineage(lambda kv: kv[1][0] is None).go_back(1), "c_custkey long, c_mktsegment string")


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 350000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rdd_full_outer_join(t):
    builders = records(t, "customer", "c_custkey", "c_mktsegment").filter(lambda r: r[1] == "BUILDING")
    joined = large_orders(t).full_outer_join(builders)
    return shown(t, joined.lineage(lambda kv: kv[1][1] is None).go_back(0), "o_custkey long, o_totalprice double")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def rdd_subtract(t):
    rest = records(t, "customer", "c_custkey", "c_mktsegment").subtract_by_key(large_orders(t))
    return shown(t, rest.lineage(lambda kv: kv[1] == "MACHINERY").go_back(0), "c_custkey long, c_mktsegment string")


def flag_lines(t: Tables) -> TracedRDD:
    """Lines with the regions of their flag; a flag holds a third of all lines or more."""
    regions = records(t, "region", "r_regionkey", "r_name").map(lambda r: ("NAR"[r[0] % 3], r[1]))
    return records(t, "lineitem", "l_returnflag", "l_orderkey").join(regions)


@query("SELECT l_returnflag AS flag, r_name AS region, count(*) AS n FROM lineitem JOIN region ON l_returnflag = substr('NAR', CAST(r_regionkey % 3 + 1 AS INT), 1) GROUP BY 1, 2")
def rdd_hot_key_join(t):
    counts = flag_lines(t).map(lambda kv: ((kv[0], kv[1][1]), 1)).reduce_by_key(lambda a, b: a + b)
    return t.trail.spark.createDataFrame(counts.rdd.values().map(lambda kv: (*kv[0], kv[1])), "flag string, region string, n long")


@query("SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def rdd_hot_key_trace(t):
    """All lines of one hot key, through the join."""
    return shown(t, flag_lines(t).lineage(lambda kv: kv[0] == "A").go_back(0), "l_returnflag string, l_orderkey long")


@query("SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 65)")
def rdd_cogroup(t):
    groups = records(t, "supplier", "s_nationkey", "s_suppkey").cogroup(records(t, "customer", "c_nationkey", "c_custkey"))
    return shown(t, groups.lineage(lambda kv: len(kv[1][1]) > 65).go_back(0), "s_nationkey int, s_suppkey long")


@query("SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier WHERE s_acctbal > 9000")
def rdd_union(t):
    both = records(t, "customer", "c_nationkey", "c_acctbal").union(records(t, "supplier", "s_nationkey", "s_acctbal"))
    return shown(t, both.lineage(lambda r: r[1] > 9000).go_back(1), "nation int, balance double")


@query("SELECT c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 2")
def rdd_sort_by_key(t):
    sums = records(t, "customer", "c_nationkey", "c_acctbal").reduce_by_key(lambda a, b: a + b).sort_by_key()
    return shown(t, sums.lineage(lambda kv: kv[0] < 2).go_back(), "c_nationkey int, c_acctbal double")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9950")
def rdd_forward(t):
    sums = records(t, "customer", "c_nationkey", "c_acctbal").reduce_by_key(lambda a, b: a + b)
    reached = sums.lineage().go_back().filter(lambda r: r[1] > 9950).go_next()
    return t.trail.spark.createDataFrame(reached.ids.map(lambda k: (k,)), "c_nationkey int")


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def isolate_rdd_maximum(t):
    """The order that makes a customer's largest price the largest of all, over an RDD job."""
    found = isolate_rdd(records(t, "orders", "o_custkey", "o_totalprice"), lambda s: s.reduce_by_key(max), oracle=oracles.rdd_highest(lambda kv: kv[1]))
    return t.trail.spark.createDataFrame(found.culprits, "o_custkey long, o_totalprice double")


#: The events in three parts by their number, as they arrive in ``event_history``.
PARTS = "WITH parts AS (SELECT *, 3 * event_id // ((SELECT max(event_id) FROM events) + 1) AS part FROM events) "


def event_history(t: Tables) -> History:
    """All events, which arrive in three parts; the stream is stopped and started again between them."""
    spark, folder = t.trail.spark, scratch_path(t.trail.spark, "arriving")
    events = t.events.result.drop("props")
    last = events.agg(F.max("event_id")).first()[0] or 0
    parted = events.withColumn("part", F.expr(f"3 * event_id div {last + 1}"))
    history = History(t.trail, f"{folder}/history", ["user_id", "event_type"], {"n": ("count", "*"), "least": ("min", "value"), "most": ("max", "value")})
    for part in range(3):
        parted.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        history.start(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint").awaitTermination()
    return history


@query(f"{PARTS} SELECT user_id, event_type, count(*) AS n, min(value) AS least, max(value) AS most FROM parts WHERE part <= 1 GROUP BY ALL")
def stream_history_result(t):
    """The running result as it was after the second batch."""
    return event_history(t).result(upto=1)


@query(f"""{PARTS} SELECT part AS batch, event_id, user_id, event_type, value FROM parts
WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events GROUP BY user_id, event_type HAVING max(value) > 100)""")
def stream_history_trace(t):
    """The rows of all three batches behind running results."""
    return event_history(t).trace("most > 100").select(F.col(BATCH).alias("batch"), "event_id", "user_id", "event_type", "value")


@query(f"""{PARTS}, firsts AS (SELECT user_id, event_type, min(part) AS first FROM parts WHERE value > 100 GROUP BY ALL),
touched AS (SELECT DISTINCT user_id, event_type, part FROM parts)
SELECT t.part AS batch, t.user_id, t.event_type, count(*) AS n, min(p.value) AS least, max(p.value) AS most
FROM touched t JOIN firsts f ON t.user_id = f.user_id AND t.event_type = f.event_type AND t.part >= f.first
JOIN parts p ON p.user_id = t.user_id AND p.event_type = t.event_type AND p.part <= t.part GROUP BY ALL""")
def stream_history_forward(t):
    """The running results that rows of high value influenced, after each batch that touched them."""
    return event_history(t).reached("value > 100").withColumnRenamed(BATCH, "batch")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE user_id = (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)")
def stream_history_rows(t):
    """Any traced query over the rows of all batches; here the user with most events."""
    counts = event_history(t).rows().group_by("user_id").count()
    top = counts.top(1, F.desc("count"), "user_id")
    return top.trace().all_sources()[0][1].select("event_id", "user_id", "event_type", "value")
