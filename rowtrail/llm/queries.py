"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, filter_audit, language_id, line_dedup, lm, media, minhash, mixing, pii, quality, url_filter
from .common import documents

#: Name of a tokenizer file in the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"
#: Tokenizers A and B of the alignment.
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Rules of the URL filter: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MAX_SOURCES = 500_000


def tokenizer_json(name: str = TOKENIZER) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def remainder(by: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def source_weights(docs: DataFrame) -> dict:
    """5, 2, 1, repeating, for the sources by code point, null last."""
    found = [r.source for r in docs.select("source").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    ordered = sorted((s for s in found if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in found)
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    weights = source_weights(docs)
    mixed = mixing.mix(docs, weights, mixing.n_words(), F.array("source")).withColumn("source", F.get("sources", F.lit(0)))
    rows = mixed.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    sizes = {r.source: r.source_size for r in rows}
    targets = mixing.quotas(weights, sizes, sum(sizes.values()), 3)
    by_source = spark.createDataFrame([(s, n, float(targets[s])) for s, n in sizes.items()], "s string, source_size long, target double")
    return mixed.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir, "doc_id", "text"))
    counts = [F.size(F.filter("base", pii.is_kind(number))).cast("long").alias(f"n_{kind}") for number, kind in enumerate(pii.BASE)]
    more = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added")]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), *more)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate_once(documents(spark, sf_dir, "doc_id", "text"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = media.to_streams(documents(spark, sf_dir, "doc_id", "text"))
    return media.describe(streams, keep=("doc_id", "n_bytes"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir, "doc_id", "text"), tokenizer_json())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", remainder(5) == 0)
    profiles = language_id.learn(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return cleaned.select("doc_id", "n_removed", spans.alias("removed"), F.array_join("copied_from", ",").alias("copied_from"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("clean_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), width=3, percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir, "doc_id", "text"), remainder(7) != 2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(documents(spark, sf_dir, "doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model tells all bytes apart."""
    return quality.rate(documents(spark, sf_dir, "doc_id", "text", "lang"), alphabet=quality.BYTES)


def tokenizer_bytes(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A's rank file has the vocabulary of ``byte_bpe_50k.json``; a test compares both."""
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"), tokenizer_bytes(RANKS), tokenizer_bytes(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_media": op4_media,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash": op8_minhash,
    "op9_url_filter": op9_url_filter,
    "op10_lm": op10_lm,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality": op12_quality,
    "op13_alignment": op13_alignment,
}
