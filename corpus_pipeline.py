"""A pipeline over documents: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrail.llm import bpe, exact_dedup, language_id, minhash, mixing
from rowtrail.llm.common import written
from rowtrail.llm.queries import source_weights, tokenizer_json

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the least score of documents in a known language below which a document is in none.
FLOOR = 0.5
#: Files whose names are small enough to broadcast, some 20 MB; more are joined by a shuffle.
BROADCAST_FILES = 100_000
#: Not expressible in SQL: profiles, signatures, the flow and the tokenizer.
ORACLE_SQL = None


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, ``row``.

    Rows of Parquet files are numbered by the file and their place in it, so nothing
    is copied; only the files' names pass the driver. Other rows are written once.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), name)
    files = sorted(r.file for r in placed.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    if len(files) <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    return placed.join(numbers, "file").select(*COLUMNS, (F.col("number") * 2**40 + F.col("place")).alias("row"))


def one_of_each(rows: DataFrame, groups: DataFrame, group: str, best: Column) -> DataFrame:
    """The rows that are the best of their group; only numbers and keys meet, not texts."""
    kept = rows.select("row", "doc_id").join(groups.select("row", group), "row").groupBy(group).agg(best.alias("best")).select("best.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without any letter, and those in no known language.

    A document is in none if its score is below FLOOR times the least score of all
    documents whose language is told as labelled. Without such documents, or without
    profiles, only the letters decide.
    """
    docs = docs.select(*COLUMNS)
    profiles = language_id.learn(docs)
    if not profiles:
        profiles = {"": []}
    told = written(language_id.predict(docs, profiles), "pipeline-languages")
    least = told.where("lang = lang_pred").agg(F.min("score")).first()[0]
    return told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= FLOOR * (least or 0.0))).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep one row, with the largest doc_id; a null doc_id only where no other row has the text."""
    rows = numbered(docs, "pipeline-copies")
    copies = exact_dedup.deduplicate_once(rows, key="row")
    return one_of_each(rows, copies, "keep_id", F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) keep one row, with the least doc_id; a null doc_id comes last."""
    rows = numbered(docs, "pipeline-near-copies")
    near = minhash.near_duplicates(rows, key="row")
    return one_of_each(rows, near, "component_id", F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources' words have weights 5, 2, 1, repeating; each row is a document of its own."""
    rows = numbered(docs, "pipeline-mixing")
    taken = mixing.mix(rows, source_weights(rows), mixing.n_words(), F.array("source"), key="row").where("copies > 0").select("row", "copies")
    return rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and a check that they decode to its text."""
    return bpe.digests(docs, tokenizer_json())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
