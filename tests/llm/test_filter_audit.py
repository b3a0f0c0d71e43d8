"""The filter audit against plain loops over sets of failing rows."""

import collections
import itertools

import pytest
from pyspark.sql import functions as F

from rowtrail.llm import filter_audit

PLENTY = " ".join(f"word{i}" for i in range(250))
TEXTS = [None, "", " \n\t ", PLENTY, PLENTY, PLENTY, "a " * 300, "LOUD " + PLENTY, PLENTY.upper(), PLENTY + " 100 %", "A a " * 150 + "#", "word " * 30_000, "x\x0by\x0cz"]
DOCS = "doc_id long, text string, source string, part string, row string, key string"
ROWS = [(i, t, [None, "", "a", "b"][i % 4], "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
ROWS += [(3, PLENTY, "a", None, None, None), (None, PLENTY, "b", None, None, None), (None, None, None, None, None, None)]
LABELS = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (6, 1, None), (6, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1)]


def fails(doc_id, text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(other[0] is not None and other[0] < doc_id and (other[1] or "") == text for other in ROWS),
    }


def expected():
    good, toxic = {k for k, q, _ in LABELS if q == 1 and k is not None}, {k for k, _, t in LABELS if t == 1 and k is not None}
    docs = [(r[2] or "", {n for n, failed in fails(*r[:2]).items() if failed}, r[0] in good, r[0] in toxic) for r in ROWS]
    out, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, kept = [d for d in left if name in d[1]], [d for d in left if name not in d[1]]
                failing = [d for d in own if name in d[1]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (len(kept), len(gone), len(failing) - len(gone), sum(d[1] == {name} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), (part, name))
                left = kept
    return {k: (*v[:-1], shapley[v[-1]]) for k, v in out.items()}


def test_audit_equals_plain_loops(spark):
    found = filter_audit.audit_documents(spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", *filter_audit.FIGURES]
    got = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert got == expected()


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(ROWS[:5], DOCS), spark.createDataFrame(LABELS[:1], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(docs.where("false"), labels).count() == 0
    found = filter_audit.audit_documents(docs, labels.where("false"))
    assert found.count() == 600 * 3 and found.where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_any_filters(spark):
    """The operator itself takes relations of any filters, also of ids that all or none fail."""
    rows = spark.range(10).select(F.col("id").alias("row"), F.lit("p").alias("part"), F.lit(1).alias("good"), F.lit(0).alias("toxic"))
    failing = {"x": rows.where("row < 4").select("row"), "y": rows.select("row"), "z": rows.where("false").select("row")}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.audit(rows, failing).collect()}
    assert len(got) == 18 and got["xyz", 1] == (6, 4, 0, 0, 4, 12) and got["xyz", 2] == (0, 6, 4, 6, 6, 48) and got["yxz", 2] == (0, 0, 4, 0, 0, 12) and got["zyx", 1] == (10, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="more than"):
        filter_audit.audit(rows, {str(i): rows for i in range(7)})


def test_relations_of_rows_are_not_broadcast(spark):
    """However small their files: stored ids take a byte a row, and many times that in memory. The 600 steps of the orders alone are sent."""
    docs, labels = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    judged = filter_audit.judged(docs)
    rows = filter_audit.labelled(judged, labels)
    failing = {name: filter_audit.written(judged.where(name).select("row"), "failing") for name in "AB"}
    plans = [rows, filter_audit.repeated(judged), filter_audit.survivors(rows, failing), *filter_audit.figures(rows, failing), filter_audit.audit(rows, failing)]
    sent = [df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") for df in plans]
    assert sent == [0, 0, 0, 0, 0, 1]
