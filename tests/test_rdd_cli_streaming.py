import pytest
from made import READERS, SHOPS, loans, spoilt, visits
from pyspark.sql import functions as F

from rowtrail.faults import cli, oracles
from rowtrail.faults.isolate_rdd import isolate_rdd
from rowtrail.operators.traced_rdd import TracedRDD
from rowtrail.plans.levels import TraceError, UnsupportedOperatorError
from rowtrail.session import RowTrail
from rowtrail.streaming.batches import trace_batches

LINES = ["rain and wind", "wind in the hills", "no wind or rain", "", "sun"]
VISITS = [r for r in visits() if r[0]]
LOANS = [(reader, (loan, days)) for loan, reader, days in loans()]
FAULT = next(i for i, r in enumerate(VISITS) if r[0] == SHOPS[3])


def places(rows, keep):
    return [i for i, r in enumerate(rows) if keep(r)]


def test_filter_and_word_count(spark):
    lines = TracedRDD.parallelize(spark.sparkContext, LINES, 2)
    assert lines.filter(lambda x: "rain" in x).lineage().show().collect() == [x for x in LINES if "rain" in x]
    counts = lines.flat_map(str.split).map(lambda w: (w, 1)).reduce_by_key(lambda a, b: a + b)
    at = counts.lineage(lambda kv: kv[0] == "rain")
    back = at.go_back()
    assert sorted(back.ids.collect()) == places(LINES, lambda x: "rain" in x.split())
    assert sorted(k for k, _ in back.go_next().show().collect()) == sorted({w for x in LINES if "rain" in x for w in x.split()})
    assert sorted(at.associations().distinct().collect()) == [("rain", i) for i in sorted(back.ids.collect())]
    with pytest.raises(TraceError):
        back.go_back()


@pytest.mark.parametrize("how", ["reduce", "group", "group_by", "aggregate", "combine", "distinct", "sort"])
def test_keyed_operators(spark, how):
    pairs = TracedRDD.parallelize(spark.sparkContext, VISITS, 3)
    add = lambda a, b: a + b
    made = {
        "reduce": lambda: pairs.reduce_by_key(add),
        "group": lambda: pairs.group_by_key(),
        "group_by": lambda: pairs.group_by(lambda v: v[0]),
        "aggregate": lambda: pairs.aggregate_by_key(0, add, add),
        "combine": lambda: pairs.combine_by_key(lambda v: v, add, add),
        "distinct": lambda: pairs.keys().distinct().map(lambda k: (k, None)),
        "sort": lambda: pairs.reduce_by_key(max).sort_by_key(),
    }[how]()
    assert sorted(made.lineage(lambda kv: kv[0] == SHOPS[1]).go_back().ids.collect()) == places(VISITS, lambda r: r[0] == SHOPS[1]) != []


@pytest.mark.parametrize("how", ["join", "left_outer_join", "right_outer_join", "full_outer_join", "subtract_by_key", "cogroup"])
def test_joins_by_plain_loops(spark, how):
    sc, names = spark.sparkContext, dict(READERS)
    lent, readers = TracedRDD.parallelize(sc, LOANS, 2), TracedRDD.parallelize(sc, READERS, 1)
    made = getattr(lent, how)(readers)
    known = {k for k, _ in LOANS}
    pairs = [(k, (v, names[k])) for k, v in LOANS if k in names]
    lone, unlent = [(k, (v, None)) for k, v in LOANS if k not in names], [(k, (None, n)) for k, n in READERS if k not in known]
    want = {
        "join": pairs, "left_outer_join": pairs + lone, "right_outer_join": pairs + unlent, "full_outer_join": pairs + lone + unlent, "subtract_by_key": [(k, v) for k, v in LOANS if k not in names],
        "cogroup": [(k, ([v for x, v in LOANS if x == k], [n for x, n in READERS if x == k])) for k in known | set(names)],
    }[how]
    assert sorted(made.collect(), key=repr) == sorted(want, key=repr)
    at = made.lineage(lambda kv: kv[0] == ("r2" if how != "subtract_by_key" else "r7"))
    assert {k for k, _ in at.go_back(0).show().collect()} <= {"r2", "r7"}
    if how == "join":
        assert sorted(at.go_back(0).show().collect()) == sorted(r for r in LOANS if r[0] == "r2") and at.go_back(1).show().collect() == [("r2", names["r2"])]


def test_union_partitions_and_intermediate_show(spark):
    sc = spark.sparkContext
    lent, readers = TracedRDD.parallelize(sc, LOANS, 2), TracedRDD.parallelize(sc, READERS, 2)
    both = lent.union(readers).lineage(lambda kv: kv[0] == "r3")
    assert both.go_back(1).show().collect() == [("r3", "reader 3")] and both.go_back(1).go_next().ids.collect() == [(1, 3)]
    assert sorted(both.go_back(0).show().collect()) == sorted(r for r in LOANS if r[0] == "r3")
    for refused in (lent.map_partitions, lent.map_partitions_with_index):
        with pytest.raises(UnsupportedOperatorError):
            refused(lambda *x: x[-1])
    assert lent.map_partitions(lambda it: it, one_to_one=True).count() == len(LOANS)
    numbered = lent.map_partitions_with_index(lambda n, it: ((n, v) for v in it), one_to_one=True)
    assert {n for n, _ in numbered.collect()} == {0, 1}
    sums = lent.zip_partitions(lambda a, b: [(len(list(a)), len(list(b)))], readers)
    at = sums.lineage(lambda v: v[0] > 0)
    assert at.go_back(1).ids.count() == len(READERS) and sorted(sums.collect()) == sorted([(15, 3), (15, 4)])
    assert lent.coalesce(1).lineage(lambda v: v[0] == "r3").show().count() == sum(k == "r3" for k, _ in LOANS)


def test_cursors_step_many_times(spark):
    pairs = TracedRDD.parallelize(spark.sparkContext, VISITS, 2)
    sums = pairs.reduce_by_key(lambda a, b: a + b).map(lambda kv: (kv[1] % 2, kv)).group_by_key()
    at = sums.lineage(lambda kv: kv[0] == 0)
    assert at.go_back_all(times=1).at is at.go_back().at and at.go_back_all().at_source
    home = at.go_back_all()
    assert home.go_next_all(times=1).ids.count() == at.go_back().ids.count() and sorted(home.go_next_all().ids.collect()) == sorted(at.ids.collect())
    assert at.get_back().ids.count() == len({s for s, _ in VISITS})
    shop = home.show().first()[0]
    shown = home.filter(lambda v: v[0] == shop)
    assert shown.go_next_all().ids.count() == 1 and shown.intersection(home).ids.count() == shown.ids.count()


def test_zip_and_sorting(spark):
    sc = spark.sparkContext
    a, b, c = (TracedRDD.parallelize(sc, x, 2) for x in ([("x", 1), ("y", 2)], ["p", "q"], [10, 20]))
    at = a.zip(b).lineage(lambda v: v[1] == "q")
    assert at.go_back(0).show().collect() == [("y", 2)] and at.go_back(1).show().collect() == ["q"]
    assert a.zip(b, c).collect() == [(("x", 1), "p", 10), (("y", 2), "q", 20)]
    assert a.repartition_and_sort_within_partitions(1, ascending=False).collect() == [("y", 2), ("x", 1)]
    assert sorted(v for v, _ in a.zip_with_unique_id().collect()) == [("x", 1), ("y", 2)]
    assert [v for v, _ in a.collect_with_id()] == a.collect() and sorted(i for _, i in a.collect_with_id()) == [0, 1]


def test_sources_and_sinks(spark, tmp_path):
    sc = spark.sparkContext
    TracedRDD.parallelize(sc, LINES, 2).save_as_text_file(str(tmp_path / "lines"))
    read = TracedRDD.text_file(sc, str(tmp_path / "lines"))
    assert sorted(read.filter(lambda x: "wind" in x).lineage().show().collect()) == sorted(x for x in LINES if "wind" in x)
    hadoop = TracedRDD.hadoop_file(sc, str(tmp_path / "lines"), "org.apache.hadoop.mapred.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    assert sorted(hadoop.values().collect()) == sorted(LINES)
    pairs = TracedRDD.parallelize(sc, VISITS, 2)
    pairs.save_as_hadoop_file(str(tmp_path / "pairs"), "org.apache.hadoop.mapred.SequenceFileOutputFormat")
    assert sorted(sc.sequenceFile(str(tmp_path / "pairs")).collect()) == sorted(VISITS)


def test_isolate_rdd(spark):
    source = TracedRDD.parallelize(spark.sparkContext, spoilt(VISITS, {FAULT}, 5_000_000), 2)
    found = isolate_rdd(source, lambda s: s.reduce_by_key(max), lambda kv: kv[1] > 1000)
    assert found.culprits.collect() == [(SHOPS[3], 5_000_000)] and found.provenance_size == sum(s == SHOPS[3] for s, _ in VISITS)
    same = isolate_rdd(source, lambda s: s.reduce_by_key(max), oracle=oracles.rdd_highest(lambda kv: kv[1]))
    assert same.culprits.collect() == found.culprits.collect() and same.n_faulty == 1
    assert isolate_rdd(source, lambda s: s, lambda kv: kv[1] < 0).n_faulty == 0


def test_isolate_rdd_follows_every_branch(spark):
    """The searched source is the join's second input; the first one's ids are not its own."""
    sc = spark.sparkContext
    readers = TracedRDD.parallelize(sc, [("x", 0)] * 5 + READERS, 2)
    rows = [(k, v[1]) for k, v in LOANS] + [("r2", -40_000)]
    source = TracedRDD.parallelize(sc, rows, 2)
    found = isolate_rdd(source, lambda s: readers.join(s), lambda kv: kv[1][1] < 0)
    assert found.culprits.collect() == [("r2", -40_000)] and found.provenance_size == sum(k == "r2" for k, _ in rows)


def test_isolate_rdd_narrows_many_records(spark):
    source = TracedRDD.parallelize(spark.sparkContext, [1] * 1500 + [10**9] + [1] * 200, 4)
    found = isolate_rdd(source, lambda s: s.map(lambda v: (0, v)).reduce_by_key(lambda a, b: a + b), lambda kv: kv[1] > 10**8)
    assert found.culprits.collect() == [10**9] and found.minimal


def test_command_line(spark, tmp_path):
    path, names = tmp_path / "visits.csv", tmp_path / "shops.csv"
    path.write_text("shop,spent\n" + "".join(f"{s},{v}\n" for s, v in spoilt(VISITS, {FAULT}, -70_000)))
    names.write_text("shop,town\n" + "".join(f"{s},town {s[-1]}\n" for s in SHOPS))
    said = cli.main(["sql", f"visits={path}", f"shops={names}", "SELECT town, sum(spent) AS total FROM visits JOIN shops USING (shop) GROUP BY town", "min total"])
    assert "spent=-70000" in said and said.count("Row(") == 1
    said = cli.main(["sql", f"visits={path}", "SELECT shop, sum(spent) AS total FROM visits GROUP BY shop", "lt total 0", "--where", f"shop = '{SHOPS[3]}'"])
    assert "spent=-70000" in said and f"provenance: {sum(s == SHOPS[3] for s, _ in VISITS)} rows" in said
    assert "weather" in cli.main(["list"])


@pytest.mark.parametrize(("name", "value"), [("airport", "minutes=-75"), ("weather", "snow=18500.0"), ("student", "mark=100000000.0")])
def test_scenarios(spark, name, value):
    assert value in cli.main(["run", name, "--rows", "3000"])


def test_micro_batches(spark, tmp_path):
    spark.createDataFrame(VISITS, "k string, v int").write.json(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema("k string, v int").json(str(tmp_path / "in")), []
    query = trace_batches(RowTrail(spark), stream, lambda t: t.group_by("k").count(), lambda r, n: seen.extend(x.v for x in r.trace(F.col("k") == SHOPS[0]).go_back().show().collect()), str(tmp_path / "checkpoint"))
    query.awaitTermination(60)
    assert sorted(seen) == sorted(v for s, v in VISITS if s == SHOPS[0])
