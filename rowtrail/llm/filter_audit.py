"""How filters act together: failing-id relations, joined by left-anti and left-semi.

Each filter has one stored table of the rows that fail it. The survivors of every
set of filters come from one relation (set, row): each round offers each row the next
filter, and a left-anti join with the filter's table takes out those that fail it. What
a filter removes after a set is its table's left-semi join with the survivors; what it
finds removed already is its left-anti join with them. Rows that fail nothing survive
every set and are only counted. An order's prefix matters by its set alone, so the
orders look their figures up by (set, filter).

All these joins are sort-merge joins by their hints. Stored ids take about a byte a row and
some 40 in memory, so Spark would take the files of millions for small, and send
several such relations at once through the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of, written

#: The filters' relations double with each filter, and orders grow with the factorial.
MAX_FILTERS = 6
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text's own columns decide: few words, repetitive, many capitals, odd signs."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, key: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One pass over the texts: row (a number), key, part, a flag for each of A to D, and the text's digest; written once."""
    words = F.array_remove(F.split(F.col("text"), WORD.replace("^", "")), "")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_of(text_col).alias("text")).withColumn("words", words)
    rows = rows.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "key", "part", *(c.alias(n) for n, c in conditions(F.col("text")).items()), digest), "audit-rows")


def repeated(rows: DataFrame) -> DataFrame:
    """Rows of (row, key, digest) whose text a smaller key has; null keys are neither smaller nor larger."""
    groups = rows.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    # written, so that Spark can split a text with very many rows
    first = written(groups.where("most > least").select("digest", "least"), "audit-repeats")
    return rows.join(first.hint("merge"), "digest").where("key > least").select("row")


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, part, good, toxic) of rows: good and toxic are 1 if any label of the row's key says so."""
    said = labels.groupBy(F.col(key).alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # written, so that Spark can split a key with very many rows
    said = written(said, "audit-labels").hint("merge")
    keyed = rows.where("key is not null").join(said, "key", "left").select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # rows without a key meet no label, and do not all go to one task to learn that
    return keyed.unionByName(rows.where("key is null").select("row", "part", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def survivors(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with a number ``state`` for each set of filters that the row survives; bit i is the i-th filter."""
    alive = rows.withColumn("state", F.lit(0))
    for i, ids in enumerate(failing.values()):
        bit = 1 << i
        alive = alive.withColumn("state", F.explode(F.array(F.col("state"), F.col("state") + bit)))
        asked = (F.col("row") == F.col("failed")) & (F.col("state").bitwiseAND(bit) != 0)
        alive = alive.join(ids.select(F.col("row").alias("failed")).hint("merge"), asked, "left_anti")
    return alive


def figures(rows: DataFrame, failing: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Counts by part: (part, state, kept), and (part, filter, state, removed, redundant, good_lost, toxic_lost).

    ``state`` is the set of filters applied before; there are no rows for counts of 0.
    """
    failed = reduce(DataFrame.unionByName, failing.values()).distinct().hint("merge")
    met, clean = rows.join(failed, "row", "left_semi"), rows.join(failed, "row", "left_anti")
    alive = written(survivors(met, failing), "audit-survivors")
    every = list(range(1 << len(failing)))
    clean = clean.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.explode(F.array(*map(F.lit, every))))
    kept = alive.groupBy("part", "state").agg(F.count(F.lit(1)).alias("n")).unionByName(clean).groupBy("part", "state").agg(F.sum("n").alias("kept"))
    each = []
    for i, (name, ids) in enumerate(failing.items()):
        ids = ids.select("row").hint("merge")
        without = [s for s in every if not s >> i & 1]
        removed = alive.where(F.col("state").isin(without)).join(ids, "row", "left_semi").groupBy("part", "state")
        removed = removed.agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"), F.lit(0).cast("long").alias("redundant"))
        earlier = rows.join(ids, "row", "left_semi").select("row", "part", F.explode(F.array(*map(F.lit, without))).alias("state")).join(alive.select("row", "state").hint("merge"), ["row", "state"], "left_anti")
        zeros = [F.lit(0).cast("long").alias(n) for n in ("removed", "good_lost", "toxic_lost")]
        earlier = earlier.groupBy("part", "state").agg(*zeros, F.count(F.lit(1)).alias("redundant"))
        each.append(removed.unionByName(earlier).withColumn("filter", F.lit(name)))
    made = reduce(DataFrame.unionByName, each).groupBy("part", "filter", "state")
    return kept, made.agg(*(F.sum(n).alias(n) for n in ("removed", "redundant", "good_lost", "toxic_lost")))


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """What each filter does at each step of each order, by part.

    ``rows`` has row (unique), part, good and toxic (0 or 1); ``failing`` one table of
    row for each filter, at most MAX_FILTERS. Returns part, filter_order, step and FIGURES, zeros
    included: one row for each part, order and step. No rows give no parts. Rows that
    fail nothing are counted as kept; a part whose name is null is its own.
    """
    if len(failing) > MAX_FILTERS:
        raise ValueError(f"more than {MAX_FILTERS} filters")
    names, n = list(failing), len(failing)
    kept, facts = (written(df, "audit-figures") for df in figures(rows, failing))
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = []
    for order in permutations(names):
        for i, name in enumerate(order):
            state = sum(bit[x] for x in order[:i])
            steps.append(("".join(order), i + 1, name, state, state | bit[name]))
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state int, after int")
    # a set of k filters comes before the next one in k! * (n - 1 - k)! orders
    orders_of = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("state") + 1)
    others = (1 << n) - 1
    of_filter = facts.withColumn("own", F.element_at(F.create_map(*(x for name in names for x in (F.lit(name), F.lit(others - bit[name])))), F.col("filter")))
    of_filter = of_filter.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"), F.sum(F.when(F.col("state") == F.col("own"), F.col("removed")).otherwise(0)).alias("unique_fails"))
    # every part has the set of no filters
    parts = kept.where("state = 0").select("part").withColumn("filter", F.explode(F.array(*map(F.lit, names))))
    grid = parts.join(F.broadcast(orders), "filter")  # n! * n rows
    same = lambda *columns: reduce(Column.__and__, (F.col(f"g.{a}").eqNullSafe(F.col(f"x.{b}")) for a, b in columns))
    for found, on in ((facts, ("filter", "state")), (of_filter, ("filter",)), (kept.withColumnRenamed("state", "after"), ("after",))):
        pairs = [("part", "part"), *((c, c) for c in on)]
        grid = grid.alias("g").join(found.alias("x").hint("merge"), same(*pairs), "left").select("g.*", *(f"x.{c}" for c in found.columns if c in FIGURES))
    return grid.select("part", "filter_order", "step", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FIGURES))


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of filters A to D, and E: another row with a smaller key has the same text.

    A null text counts as empty and null parts as the part ''. Rows repeated with the same key
    count each and are no copies of each other; a row without a key fails E never and has no
    label. Labels repeated for a key count once. Other columns are not read.
    """
    rows = judged(docs, key, text_col, part_col)
    failing = {name: written(rows.where(name).select("row"), f"failing-{name}") for name in "ABCD"}
    failing["E"] = written(repeated(rows.select("row", "key", "digest")), "failing-E")
    return audit(written(labelled(rows.select("row", "key", "part"), labels, key), "audit-labelled"), failing)
