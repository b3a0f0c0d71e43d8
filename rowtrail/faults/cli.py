"""Command line: ``python -m rowtrail.faults.cli sql sales=path.csv [more=path.csv ...] "SELECT ..." "lt total 0"``.

Oracles: ``lt|gt <column> <value>``, ``min|max|nan <column>``, ``sigma <column> <k>``.
``run airport|weather|student`` isolates a planted fault in generated data of
``--rows`` rows; ``list`` names these scenarios.
"""

from __future__ import annotations

import argparse
import shlex
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traced import Traced
from ..session import RowTrail
from . import oracles
from .isolate import Isolated, isolate_frame, isolate_sql


def oracle(spec: str, output: Callable[[], DataFrame]) -> Column:
    """The predicate that a specification names; ``output`` gives the original result where it is needed."""
    name, column, *rest = shlex.split(spec)
    made = {
        "lt": lambda: oracles.below(column, float(rest[0])),
        "gt": lambda: oracles.above(column, float(rest[0])),
        "min": lambda: oracles.lowest(output(), column),
        "max": lambda: oracles.highest(output(), column),
        "nan": lambda: oracles.missing(column),
        "sigma": lambda: oracles.far_from_median(output(), column, float(rest[0])),
    }
    if name not in made:
        raise ValueError(f"unknown oracle {name}; known are {', '.join(made)}")
    return made[name]()


def scenario(spark: SparkSession, name: str, rows: int) -> tuple[DataFrame, Callable[[Traced], Traced], str]:
    """Generated rows with one planted fault, the query, and the usual oracle."""
    base, odd = spark.range(rows), F.col("id") == rows // 3
    if name == "airport":  # minutes on the ground, one departure noted before its arrival
        stays = F.when(odd, F.lit(-75)).otherwise(25 + F.pmod(F.xxhash64("id"), F.lit(120)))
        data = base.select("id", F.concat(F.lit("gate"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).alias("gate"), F.pmod("id", F.lit(24)).alias("hour"), stays.alias("minutes"))
        return data, lambda t: t.group_by("gate", "hour").agg(F.sum("minutes").alias("total"), F.min("minutes").alias("least")), "lt least 0"
    if name == "weather":  # centimetres of snow by station, one reading in tenths of a millimetre
        data = base.select("id", F.pmod(F.xxhash64("id"), F.lit(90)).alias("station"), F.when(odd, F.lit(18500.0)).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(140)) / 2).alias("snow"))
        return data, lambda t: t.group_by("station").agg((F.max("snow") - F.min("snow")).alias("spread")), "gt spread 500"
    if name == "student":  # marks by course, one with a slipped decimal point
        data = base.select("id", F.pmod(F.xxhash64("id"), F.lit(12)).alias("course"), F.when(odd, F.lit(1e8)).otherwise(40 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(61))).alias("mark"))
        return data, lambda t: t.group_by("course").agg(F.avg("mark").alias("mean")), "gt mean 101"
    raise ValueError(f"unknown scenario {name}")


#: Rows of a report's list.
SHOWN = 20


def report(found: Isolated, sizes: list[int]) -> str:
    rows = "\n".join(f"  {r}" for r in found.culprits.limit(SHOWN).collect())
    progress = " -> ".join(map(str, [found.provenance_size, *sizes]))
    note = "" if found.minimal else " (not known to be minimal)"
    return f"faulty outputs: {found.n_faulty}\nprovenance: {found.provenance_size} rows\nruns: {found.runs}\ncandidates: {progress}\nculprits{note}:\n{rows}"


def main(arguments: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="rowtrail.faults.cli", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("scenario", choices=["airport", "weather", "student"])
    run.add_argument("oracle", nargs="?")
    run.add_argument("--rows", type=int, default=1_000_000)
    sql = commands.add_parser("sql")
    sql.add_argument("tables", nargs="+", help="name=path of CSV files with a header, the query, and the oracle; the first table is searched")
    sql.add_argument("--where", help="a condition on the searched table that holds for the candidates")
    commands.add_parser("list")
    given = parser.parse_args(arguments)
    if given.command == "list":
        return "airport\nweather\nstudent"
    spark = SparkSession.builder.appName("rowtrail").getOrCreate()
    trail, sizes = RowTrail(spark), []
    if given.command == "run":
        data, query, usual = scenario(spark, given.scenario, given.rows)
        base = trail.keyed(data, "id", name=given.scenario)
        test = oracle(given.oracle or usual, lambda: query(base).result)
        return report(isolate_frame(trail, base, query, test, sizes.append), sizes)
    *tables, query, spec = given.tables
    if not tables:
        parser.error("sql needs name=path, a query and an oracle")
    frames = {}
    for table in tables:
        name, _, path = table.partition("=")
        frames[name] = spark.read.csv(path, header=True, inferSchema=True)
        frames[name].createOrReplaceTempView(name)
    searched = next(iter(frames))
    test = oracle(spec, lambda: spark.sql(query))
    return report(isolate_sql(trail, searched, frames[searched], query, test, sizes.append, given.where), sizes)


if __name__ == "__main__":
    print(main())
