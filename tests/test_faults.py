"""Delta debugging against exhaustive search, isolation of planted faults, oracles."""

import itertools
import random

import pytest
from made import SHOPS, spoilt, visits
from pyspark.sql import functions as F

from rowtrail.faults import isolate as iso
from rowtrail.faults import oracles
from rowtrail.faults.ddmin import ddmin, remembering, smallest
from rowtrail.faults.isolate import isolate_frame, isolate_sql
from rowtrail.faults.parted import Parted, fits
from rowtrail.harness.recall import leave_one_out, recall_holds
from rowtrail.session import RowTrail

VISITS = visits()
SCHEMA = "shop string, spent int"
FAULT = next(i for i, r in enumerate(VISITS) if r[0] == SHOPS[2])
FAULTY = spoilt(VISITS, {FAULT}, -70_000)


def is_minimal(part, failing):
    return failing(part) and not any(failing([x for k, x in enumerate(part) if k != i]) for i in range(len(part)))


@pytest.mark.parametrize("seed", range(25))
def test_ddmin_by_exhaustive_search(seed):
    """Random causes, each a set of items that must come together; any of them will do."""
    rng = random.Random(seed)
    items = rng.sample(range(100), rng.randint(1, 9))
    causes = [set(rng.sample(items, rng.randint(1, min(3, len(items))))) for _ in range(rng.randint(1, 3))]
    failing = lambda part: any(c <= set(part) for c in causes)
    found = ddmin(items, failing)
    minimal = [list(p) for n in range(len(items) + 1) for p in itertools.combinations(items, n) if is_minimal(list(p), failing)]
    assert found in minimal


@pytest.mark.parametrize("seed", range(10))
def test_ddmin_where_larger_parts_may_pass(seed):
    """A sum below a bound: not every part that holds a failing one fails."""
    rng = random.Random(100 + seed)
    items = [rng.randrange(-50, 90) for _ in range(60)]
    items[rng.randrange(60)] = -10**6
    failing = lambda part: sum(part) < -500_000
    assert is_minimal(ddmin(items, failing), failing)


def test_ddmin_without_a_fault_and_its_bookkeeping():
    assert ddmin("abc", lambda part: False) == ["a", "b", "c"] and ddmin([], lambda part: True) == []
    seen, sizes, need = [], [], {8, 9, 44}
    ddmin(list(range(50)), lambda part: seen.append(tuple(part)) or need <= set(part), sizes.append)
    assert len(seen) == len(set(seen)) and sizes == sorted(sizes, reverse=True) and sizes[-1] == 3
    groups = []
    first = remembering(lambda parts: groups.append(len(parts)) or [need <= set(p) for p in parts], 4)
    assert smallest(50, first) == (8, 9, 44) and max(groups) == 4


def totals(s):
    return s.group_by("shop").agg(F.sum("spent").alias("total"))


def test_isolate_frame(spark):
    t = RowTrail(spark)
    found = isolate_frame(t, t.values(FAULTY, SCHEMA), totals, F.col("total") < 0)
    assert [tuple(r) for r in found.culprits.collect()] == [FAULTY[FAULT]] and found.minimal
    assert found.provenance_size == sum(r[0] == SHOPS[2] for r in FAULTY) and found.n_faulty == found.faulty.count() == 1


def test_isolate_two_rows_that_fail_together(spark):
    t = RowTrail(spark)
    base = t.values([*VISITS, ("new", 300), ("new", 400), ("new", 20)], SCHEMA)
    found = isolate_frame(t, base, totals, F.col("total") > 650 + F.when(F.col("shop") == "new", 0).otherwise(10**6))
    assert sorted(r.spent for r in found.culprits.collect()) == [300, 400]


def test_isolate_over_all_branches(spark):
    """The culprit comes in by the second input of the join, which leads to the same table."""
    t = RowTrail(spark)
    base = t.values(FAULTY, SCHEMA)

    def query(s):
        most = s.group_by("shop").agg(F.max("spent").alias("most"))
        return most.join(s.select(F.col("shop").alias("at"), "spent"), F.col("shop") == F.col("at"))

    found = isolate_frame(t, base, query, F.col("spent") < 0)
    assert FAULTY[FAULT] in [tuple(r) for r in found.culprits.collect()]


def test_isolate_narrows_many_candidates(spark):
    t = RowTrail(spark)
    base = t.frame(spark.range(2000).select(F.col("id"), F.when(F.col("id") == 1234, 10**9).otherwise(1).alias("v")))
    sizes = []
    found = isolate_frame(t, base, lambda s: s.agg(F.sum("v").alias("total")), F.col("total") > 10**8, sizes.append)
    assert [r.id for r in found.culprits.collect()] == [1234] and sizes[-1] == 1 and sizes == sorted(sizes, reverse=True)


def test_isolate_leaves_causes_of_very_many_rows_as_they_are(spark, monkeypatch):
    from rowtrail.faults import isolate

    monkeypatch.setattr(isolate, "MOST_BUCKETS", 64)
    t = RowTrail(spark)
    base = t.frame(spark.range(600).select("id"))
    found = isolate_frame(t, base, lambda s: s.agg(F.count(F.lit(1)).alias("n")), F.col("n") >= 590)
    assert not found.minimal and found.culprits.count() >= 590


def test_isolate_nothing(spark):
    t = RowTrail(spark)
    found = isolate_frame(t, t.values(VISITS, SCHEMA), lambda s: s.group_by("shop").count(), F.col("count") > 999)
    assert found.culprits.count() == 0 and found.n_faulty == 0 and found.faulty.count() == 0


@pytest.mark.parametrize("witnesses", [None, f"shop = '{SHOPS[2]}'", f"shop = '{SHOPS[0]}'"])
def test_isolate_sql_restores_the_view(spark, witnesses):
    base = spark.createDataFrame(FAULTY, SCHEMA)
    found = isolate_sql(RowTrail(spark), "visits", base, "SELECT shop, sum(spent) AS total FROM visits GROUP BY shop", oracles.below("total", 0), witnesses=witnesses)
    assert [tuple(r) for r in found.culprits.collect()] == [FAULTY[FAULT]]
    assert spark.table("visits").count() == len(FAULTY)


def test_isolate_division_by_zero(spark):
    t = RowTrail(spark)
    base = t.values([(s, v, 1 if i != 7 else 0) for i, (s, v) in enumerate(VISITS)], "shop string, spent int, people int")
    found = isolate_frame(t, base, lambda s: s.select("shop", F.try_divide("spent", "people").alias("each")), oracles.missing("each"))
    assert [r.people for r in found.culprits.collect()] == [0]


@pytest.mark.parametrize("seed", range(4))
def test_oracles_by_plain_loops(spark, seed):
    rng = random.Random(seed)
    values = [round(rng.gauss(50, 9), 3) for _ in range(rng.choice([1, 2, 29, 30]))] + [9_000.0] * (seed > 1)
    out = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    middle, mean = sorted(values)[len(values) // 2], sum(values) / len(values)
    deviation = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    of = lambda r: r[0]
    wanted = {"low": [min(values)], "high": [v for v in values if v == max(values)], "far": sorted(v for v in values if abs(v - middle) > 2 * deviation)}
    columns = {"low": oracles.lowest(out, "v"), "high": oracles.highest(out, "v"), "far": oracles.far_from_median(out, "v", 2)}
    functions = {"low": oracles.rdd_lowest(of), "high": oracles.rdd_highest(of), "far": oracles.rdd_far_from_median(of, 2)}
    for name, want in wanted.items():
        assert sorted(r.v for r in out.where(columns[name]).collect()) == want
        assert sorted(r.v for r in out.rdd.filter(functions[name](out.rdd)).collect()) == want


def test_oracles_for_missing_values_and_empty_outputs(spark):
    odd = spark.createDataFrame([(None,), (float("nan"),), (1.0,)], "v double")
    assert odd.where(oracles.missing("v")).count() == 2 and odd.rdd.filter(oracles.rdd_missing(lambda r: r[0])(odd.rdd)).count() == 2
    none = odd.limit(0)
    assert none.where(oracles.lowest(none, "v")).count() == 0 and odd.where(oracles.far_from_median(none, "v", 1)).count() == 0
    assert odd.rdd.filter(oracles.rdd_highest(lambda r: r[0])(none.rdd)).count() == 0


def test_recall_and_leave_one_out(spark):
    t = RowTrail(spark)
    sources = {"visits": t.values(VISITS, SCHEMA)}
    query = lambda s: totals(s["visits"])
    assert recall_holds(t, sources, query, F.col("shop") == SHOPS[1])
    assert leave_one_out(t, sources, query, F.col("shop") == SHOPS[1], "visits")


def test_parts_are_tried_in_one_scan(spark):
    """All parts of a group-by query come out of one scan of the candidates; other queries fall back."""
    t = RowTrail(spark)
    base = t.values(FAULTY, SCHEMA)
    assert fits(totals, base.df) and not fits(lambda s: s.agg(F.sum("spent").alias("total")), base.df) and not fits(lambda s: totals(s).top(1, F.asc("total")), base.df)
    dealt = base.df.withColumn("__bucket", (F.col("__id.row") % 6).cast("int"))
    trials = iso.PartedTrials(None, totals, F.col("total") < 0)
    plain = iso.Trials(lambda rows: totals(base._same(rows)).result.where("total < 0"))
    parts = [(0, 1), (2,), (3, 4, 5), (0, 1, 2, 3, 4, 5), (), (1, 3, 5)]
    assert trials.fail(dealt, parts) == plain.fail(dealt, parts) and (trials.runs, plain.runs) == (1, 6)
    plan = totals(Parted(iso.members(dealt.drop("__id"), parts).withColumnRenamed("__part", "__id"))).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


@pytest.mark.parametrize("query", [
    lambda s: s.select("shop", (F.col("spent") * 2).alias("x")).distinct().group_by("shop").agg(F.min("x").alias("total")),
    lambda s: s.join(s.group_by("shop").agg(F.min("spent").alias("total")), "shop").where("spent > 0"),
    lambda s: s.join(s.rename("spent", "other").rename("shop", "s2"), F.col("shop") == F.col("s2")).group_by("shop").agg(F.min("other").alias("total")),
    lambda s: s.union(s.select("shop", "spent")).with_windows(["shop"], total=F.sum("spent")),
    lambda s: s.explode("half", F.array("spent", F.col("spent") / 2)).group_by("shop").agg(F.sum("half").alias("total")).order_by("total"),
])
def test_parted_queries_find_the_same(spark, query):
    t = RowTrail(spark)
    base = t.values(FAULTY, SCHEMA)
    assert fits(query, base.df)
    found = isolate_frame(t, base, query, F.col("total") < -60_000)
    # a row that is a witness alone need not be the culprit of a self-join
    assert FAULTY[FAULT] in [tuple(r) for r in found.culprits.collect()] and found.minimal


def test_rows_that_reach_most_faulty_groups_come_first(spark):
    """Two prices together spoil three users' totals; ranked, it takes fewer runs to find them."""
    t = RowTrail(spark)
    lists = [(f"user{u}", f"item{i}") for u in range(6) for i in range(u * 40, u * 40 + 45)] + [(f"user{u}", b) for u in range(3) for b in ("bad", "worse")]
    prices = t.keyed(spark.createDataFrame([(f"item{i}", 3) for i in range(300)] + [("bad", -1000), ("worse", -1200)], "item string, price int"), "item")
    bought = t.keyed(spark.createDataFrame(lists, "user string, item string"), "user", "item")
    spent = lambda p: bought.join(p, "item").group_by("user").agg(F.sum("price").alias("total"))
    runs = {}
    for ranked in (False, True):
        found = isolate_frame(t, prices, spent, F.col("total") < -1800, ranked=ranked)
        assert sorted(r.item for r in found.culprits.collect()) == ["bad", "worse"] and found.n_faulty == 3 and found.minimal
        runs[ranked] = found.runs
    assert fits(spent, prices.df)
    assert runs[True] < runs[False]
