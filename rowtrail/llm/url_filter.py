"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix. Its canonical key is the host with its labels
reversed, a slash (no host contains one), and the path; the keys that start with
it form an interval. The distinct URLs are looked up once for each suffix of their
host that carries rules. URL keys and the ends of intervals are sorted together
and swept: the number of open intervals is the height of a stack of nested rules,
and the innermost rule at a key is the last one opened at the present height.

The sorted keys are cut into ranges so that many tasks sweep at once; a rule is
handed to each range that it reaches into. Cut points come from a bounded sample
and change the balance alone, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: URL keys from which the cut points of the ranges are taken.
SAMPLED_KEYS = 20_000
ADDED = ("host", "path", "rule", "verdict", "__salt")


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(F.col(url), at + F.lit(3), F.length(url))).otherwise("")


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def reversed_key(host: Column, path: Column) -> Column:
    """The canonical key as bytes, which sort as the intervals need them."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path), "UTF-8")


def innermost_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule) for each key that an interval holds; rules have lo, hi and rule."""
    spark = keys.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("key")
    sample = sorted(bytes(r.key) for r in keys.orderBy(order, "key").limit(SAMPLED_KEYS).collect())
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    step = math.isqrt(len(cuts)) + 1
    places, coarse = (F.array(*[F.lit(bytearray(c)) for c in some]).cast("array<binary>") for some in (cuts, cuts[::step]))

    def range_of(key: Column) -> Column:
        """How many cut points are at or before the key: first among every ``step``-th one, then among those after it."""
        before = F.size(F.filter(coarse, lambda c: c <= key))
        near = F.slice(places, F.greatest((before - 1) * step + 1, F.lit(1)), F.lit(step))
        return F.when(before == 0, F.lit(0)).otherwise((before - 1) * step + F.size(F.filter(near, lambda c: c <= key)))

    spread = rules.withColumn("part", F.explode(F.sequence(range_of(F.col("lo")), range_of(F.col("hi")))))
    opens = spread.select("part", F.col("lo").alias("key"), F.lit(1).alias("step"), "rule")
    closes = spread.select("part", F.col("hi").alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("rule"))
    asked = keys.select(range_of(F.col("key")).alias("part"), "key", F.lit(0).alias("step"), F.lit(None).cast("string").alias("rule"))
    # at one key: first what closes, then what opens, then the URLs
    turn = F.when(F.col("step") == -1, 0).when(F.col("step") == 1, 1).otherwise(2)
    events = opens.unionByName(closes).unionByName(asked).withColumn("turn", turn)
    so_far = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    stacked = events.withColumn("height", F.sum("step").over(so_far))
    slot = Window.partitionBy("part", "height").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("step") == 1, F.col("rule")), ignorenulls=True).over(slot)
    return stacked.withColumn("rule", top).where("step = 0 and height > 0").select("key", "rule")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Verdicts: key, host, path, rule, verdict.

    ``rules`` has host, path and verdict; hosts are lower-cased. A rule whose host is
    null or holds a slash fits no URL; a null path counts as empty. A rule fits its host and all subdomains if the path starts with the
    rule's. The longest rule (host and path as one text) wins, of equally long ones
    the longer host, then the greater text; of rules with equal host and path the
    greater verdict. Where none fits, ``rule`` is null and the verdict is ``otherwise``.
    A null URL, or one without ``://``, has an empty host and path. Repeated rows and
    null keys are judged like any other row; an empty table gives an empty table. A key
    that is called like a column of the result is refused.
    """
    if key in ADDED:
        raise ValueError(f"the key is called {key}, like a column of the result")
    rows = pages.select(F.col(key), host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    clean = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and instr(host, '/') = 0").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lo = reversed_key(F.col("host"), F.col("path"))
    intervals = clean.select(lo.alias("lo"), F.concat(lo, F.lit(bytearray(b"\xff"))).alias("hi"), F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    urls = rows.select("host", "path").where("host <> ''").distinct()
    # each suffix of the host that carries rules
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked = urls.withColumn("suffix", F.explode(suffixes)).join(clean.select(F.col("host").alias("suffix")).distinct(), "suffix", "left_semi")
    looked = written(looked.select("host", "path", "suffix", reversed_key(F.col("suffix"), F.col("path")).alias("key")), "url-keys")
    found = innermost_rules(looked.select("key").distinct(), intervals)
    best = looked.join(found, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), F.length("suffix").alias("host_size"), "rule", "suffix")).alias("best"))
    verdicts = best.select("host", "path", "best.rule", F.col("best.suffix").alias("rule_host"))
    of_rule = clean.select(F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"), F.col("verdict").alias("own"))
    # written, so that the last join meets plain rows on both sides and Spark can split a URL of very many pages
    verdicts = written(verdicts.join(of_rule, ["rule", "rule_host"]).withColumn("__salt", F.lit(0).cast("long")), "url-verdicts")
    dropped(looked)
    # no rule fits an empty host: those rows go to as many tasks as there are
    rows = rows.withColumn("__salt", F.when(F.col("host") == "", F.xxhash64(key)).otherwise(0))
    return rows.join(verdicts, ["host", "path", "__salt"], "left").select(key, "host", "path", "rule", F.coalesce("own", F.lit(otherwise)).alias("verdict"))
