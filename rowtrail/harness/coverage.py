"""Typical analytical shapes, each run again on the witnesses of its result alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.traced import Traced
from ..session import RowTrail
from .recall import Query, recalled


def revenue() -> Column:
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


def on_customer() -> Column:
    return F.col("o_custkey") == F.col("c_custkey")


def pricing_summary(t: dict[str, Traced]) -> Traced:
    return t["lineitem"].group_by("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), revenue())


def shipping_priority(t: dict[str, Traced]) -> Traced:
    joined = t["customer"].where("c_mktsegment = 'BUILDING'").join(t["orders"], on_customer()).join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.group_by("l_orderkey").agg(revenue()).top(10, F.desc("revenue"), F.asc("l_orderkey"), keys=["l_orderkey"])


def order_priority(t: dict[str, Traced]) -> Traced:
    late = t["lineitem"].where("l_quantity > 48")
    return t["orders"].join(late, F.col("o_orderkey") == F.col("l_orderkey"), "semi").group_by("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def local_volume(t: dict[str, Traced]) -> Traced:
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    return t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(t["orders"], on_customer()).group_by("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("volume"))


def customer_distribution(t: dict[str, Traced]) -> Traced:
    counts = t["customer"].join(t["orders"], on_customer(), "left").group_by("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return counts.group_by("n").agg(F.count(F.lit(1)).alias("customers"))


def large_orders(t: dict[str, Traced]) -> Traced:
    large = t["lineitem"].group_by("l_orderkey").agg(F.sum("l_quantity").alias("q")).having("q > 200")
    return t["orders"].join(large, F.col("o_orderkey") == F.col("l_orderkey"), "semi").select("o_orderkey", "o_totalprice")


def ranked_customers(t: dict[str, Traced]) -> Traced:
    return t["customer"].with_windows(["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], place=F.row_number()).where("place = 1").select("c_nationkey", "c_custkey")


def sales_by_flag_and_status(t: dict[str, Traced]) -> Traced:
    return t["lineitem"].rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


SHAPES: dict[str, tuple[Query, tuple[str, ...]]] = {
    "pricing_summary": (pricing_summary, ("lineitem",)),
    "shipping_priority": (shipping_priority, ("customer", "orders", "lineitem")),
    "order_priority": (order_priority, ("orders", "lineitem")),
    "local_volume": (local_volume, ("customer", "nation", "region", "orders")),
    "customer_distribution": (customer_distribution, ("customer", "orders")),
    "large_orders": (large_orders, ("orders", "lineitem")),
    "ranked_customers": (ranked_customers, ("customer",)),
    "sales_by_flag_and_status": (sales_by_flag_and_status, ("lineitem",)),
}


def coverage(trail: RowTrail, table: Callable[[str], Traced]) -> DataFrame:
    """For each shape the number of result rows, and of those that come again from the witnesses."""
    found = []
    for name, (query, tables) in SHAPES.items():
        sources = {n: table(n) for n in tables}
        want = query(sources).result
        again = want.intersectAll(recalled(trail, sources, query, None))
        both = want.select(F.lit(1).alias("r"), F.lit(0).alias("a")).unionAll(again.select(F.lit(0), F.lit(1)))
        counts = both.agg(F.lit(name).alias("shape"), F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.coalesce(F.sum("a"), F.lit(0)).alias("recalled"))
        found.append(counts)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
