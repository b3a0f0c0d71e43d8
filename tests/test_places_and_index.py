"""Lines in place under other splits, and stored lineage indexes."""

import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowtrail.plans.index import Indexed
from rowtrail.session import RowTrail

RNG = random.Random(8)
LINES = [RNG.choice(["", "a", "naïve; text", "x" * RNG.randrange(200)]) + f"#{i}" for i in range(400)]


def scratch(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).iterdir()}


@pytest.fixture(params=[64, 700, 10**8])
def split(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if request.param < 10**6 else "4194304")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("lines")
    for i, end in enumerate(["\n", "\r\n", "\n"]):
        own = LINES[i * 100 : i * 100 + 150]
        (made / f"{i}.txt").write_bytes((end.join(own) + (end if i else "")).encode())
    (made / "3.txt").write_bytes(b"")
    return made


def test_lines_have_the_same_ids_under_any_split(spark, split, folder):
    before = scratch(spark)
    source = RowTrail(spark).text(str(folder))
    found = source.df.select("value", F.col("__id.file").alias("file"), F.col("__id.row").alias("row")).collect()
    assert len(found) == 450 and scratch(spark) == before
    by_file = {}
    for r in found:
        by_file.setdefault(r.file, {})[r.row] = r.value
    texts = sorted((tuple(lines[i] for i in range(150)) for lines in by_file.values()), key=repr)
    assert texts == sorted((tuple(LINES[i * 100 : i * 100 + 150]) for i in range(3)), key=repr)
    if split < 1000:
        assert source.df.rdd.getNumPartitions() > 3
    at = source.union(source).where("value like '%#7'").trace().go_back(1)
    assert {r.value for r in at.show().collect()} == {x for x in LINES if x.endswith("#7")} == {r.value for r in at.show(pruned=True).collect()}


CSV = 'id,name,price\n1,"a, b",2.5\n\n2,plain,\n#note\n3,"q""uote",-1\n 4 ,é,1e3\n'


def test_csv_equals_the_reader(spark, split, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(CSV if i else CSV.replace("\n", "\r\n"))
    before = scratch(spark)
    for schema, options in (("id string, name string, price double", {"header": True}), (None, {"header": True, "comment": "#", "inferSchema": True}), (None, {}), ("id int, name string, price double", {"header": "true", "ignoreLeadingWhiteSpace": True, "nullValue": "plain", "comment": "#"})):
        plain = spark.read.options(**options).csv(str(tmp_path), schema=schema)
        source = RowTrail(spark).csv(str(tmp_path), schema, **options)
        assert source.result.dtypes == plain.dtypes
        assert sorted(map(repr, source.collect())) == sorted(map(repr, plain.collect()))
        assert source.df.select("__id").distinct().count() == plain.count()
    assert scratch(spark) == before


def test_csv_that_only_the_reader_can_follow_is_copied(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"two\nlines"\n2,b\n')
    trail = RowTrail(spark)
    assert sorted(r[1] for r in trail.csv(str(tmp_path), "a int, b string", multiLine=True).collect()) == ["b", "two\nlines"]
    assert trail.size() > 0
    trail.release()


def test_json_in_place(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": [1, 2]}\n\n{"a": null}\nbroken\n')
    before = scratch(spark)
    source = RowTrail(spark).json(str(tmp_path))
    plain = spark.read.json(str(tmp_path))
    assert sorted(map(repr, source.collect())) == sorted(map(repr, plain.collect()))
    assert source.trace("a = 1").show().first().b == [1, 2] and scratch(spark) == before
    (tmp_path / "b.json").write_text('[{"a": 5}, {"a": 6}]\n')
    with pytest.raises(PySparkException, match="read such files with frame"):
        RowTrail(spark).json(str(tmp_path), "a int").df.collect()


def test_only_files_with_the_rows_are_read(spark, tmp_path):
    spark.range(200).repartitionByRange(20, "id").write.parquet(str(tmp_path / "t"))
    source = RowTrail(spark).parquet(str(tmp_path / "t"))
    at = source.group_by((F.col("id") % 50).alias("k")).count().indexed().trace("k = 3").go_back()
    shown = at.show(pruned=True)
    assert {r.id for r in shown.collect()} == {3, 53, 103, 153}
    read = at.level.cut([r[0] for r in at.ids.select("__id.file").distinct().collect()])
    assert read.select(F.input_file_name()).distinct().count() == 4
    scan = read._jdf.queryExecution().executedPlan()
    read.collect()
    assert "xxhash64" in scan.toString()


def orders(trail, spark):
    made = trail.keyed(spark.range(3000).select("id", (F.col("id") % 40).alias("c"), (F.col("id") * 7 % 100).alias("price")), "id", name="orders")
    people = trail.keyed(spark.range(40).select(F.col("id").alias("c"), F.concat(F.lit("city"), F.col("id") % 20).alias("city")), "c", name="people")
    return made.join(people, "c").group_by("city").agg(F.sum("price").alias("total"))


def files_of(df):
    return df.select(F.input_file_name()).distinct().count()


def test_a_second_trace_reads_few_files(spark):
    trail = RowTrail(spark)
    plain = orders(trail, spark)
    stored = plain.indexed(forward=True)
    assert isinstance(stored.level, Indexed) and "indexed" in stored.graph() and trail.size() > 0
    assert sorted(stored.collect()) == sorted(plain.collect())
    for where in ("city = 'city4'", "total > 0 and city in ('city1', 'city2')"):
        for branch in (0, 1):
            want, got = plain.trace(where).go_back().go_back(branch), stored.trace(where).go_back().go_back(branch)
            assert sorted(got.collect_ids()) == sorted(want.collect_ids()) != []
            assert sorted(got.show().collect()) == sorted(want.show().collect())
            assert sorted(got.go_next().go_next().collect_ids()) == sorted(want.go_next().go_next().collect_ids())
    ids = stored.trace("city = 'city4'").ids
    table = stored.level.tables[0]
    matching = table.where(F.col("bucket").isin([r[0] for r in ids.select(F.pmod(F.xxhash64("__id"), F.lit(64)).cast("int")).collect()]))
    assert files_of(matching) <= 0.1 * files_of(table)
    assert sorted(map(repr, stored.trace("city = 'city4'").associations().collect())) == sorted(map(repr, plain.trace("city = 'city4'").associations().collect()))
    stored.release()
    with pytest.raises(Exception, match="not exist|PATH_NOT_FOUND|FileNotFound|FAILED_READ"):
        stored.trace().go_back().collect_ids()
    assert trail.size() == 0
    trail.release()


def test_indexes_of_nested_levels(spark):
    trail = RowTrail(spark)
    nested = orders(trail, spark).group_by((F.col("total") % 3).alias("rest")).agg(F.count(F.lit(1)).alias("n"))
    stored, rest = nested.indexed(buckets=8), nested.result.first().rest
    for where in (f"rest = {rest}", "n > 0"):
        assert sorted(stored.trace(where).go_back_all().collect_ids()) == sorted(nested.trace(where).go_back_all().collect_ids())
    people = trail.keyed(spark.range(40).select(F.col("id").alias("c")), "c")
    semi = people.join(trail.keyed(spark.range(9).select("id", (F.col("id") % 3).alias("c")), "id"), "c", "semi")
    assert sorted(semi.indexed(4).trace("c = 1").go_back(1).collect_ids()) == sorted(semi.trace("c = 1").go_back(1).collect_ids()) != []
    several = people.rollup(F.col("c") % 4).count()
    several = several.rename(several.result.columns[0], "g")
    assert sorted(several.indexed(4).trace("g = 2").go_back().collect_ids()) == sorted(several.trace("g = 2").go_back().collect_ids()) != []
    trail.release()


def test_jdbc_export(spark, tmp_path):
    """Associations and ids in the database that comes with Spark."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
        spark._jvm.java.lang.Class.forName(driver["driver"])
    except Exception:
        pytest.skip("no Derby here")
    trail = RowTrail(spark)
    at = orders(trail, spark).trace("city = 'city4'")
    at.save_associations_jdbc(url, "pairs", properties=driver)
    at.go_back().go_back(1).save_jdbc(url, "people", properties=driver)
    pairs, people = (spark.read.jdbc(url, table, properties=driver) for table in ("pairs", "people"))
    assert pairs.count() == at.associations().count() > 0
    assert sorted(r[0] for r in people.collect()) == ['{"c":24}', '{"c":4}']
