"""Near-duplicate detection by circulant MinHash.

A document is the set of its word shingles. Two permutations of the numbers below
2**32 make the whole signature: the first scatters the shingles, the second,
shifted circularly by 0, 1, 2, ... places, gives one coordinate for each shift.
The coordinates are banded; documents that share a band are candidates, and each
link is confirmed by the exact Jaccard similarity of the full sets.

Documents with equal sets form a class and only one of them takes part. In each
bucket the members are first held against the least one, which joins most large
groups at once. Only members of a bucket that are still in different components
are then held against each other. So a group of copies costs a multiple of its
size, and no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import dropped, extended, words_of, written

#: The chance that banding misses a pair that is exactly as similar as the threshold.
MISS = 1e-6
ROWS = 6
CACHED_WORDS = 200_000
#: Buckets up to this size are worked out pair by pair, larger ones in blocks of members.
FEW, BLOCK = 16, 512
U64 = np.uint64


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
    return x ^ x >> U64(31)


class Shingler:
    """Shingle sets of whole texts, as sorted 64-bit numbers."""

    def __init__(self, width: int):
        self.width, self.numbers = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, U64)
        if len(self.numbers) > CACHED_WORDS:
            self.numbers.clear()
        numbers = self.numbers
        for w in set(words).difference(numbers):
            numbers[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(numbers.__getitem__, words), U64, len(words))
        n = min(self.width, len(codes))
        total = np.full(len(codes) - n + 1, n, U64)
        for i in range(n):
            total = mixed(total + codes[i : len(codes) - n + 1 + i])
        return np.unique(total)


def permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit numbers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x735A2D97)
    x ^= x >> np.uint32(15)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The circulant MinHash of a set that is not empty."""
    scattered = (mixed(shingles + U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), 1024):
        np.minimum(out, permuted(scattered[None, at : at + 1024] + shifts).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit number for each band; the band's own number goes into it."""
    bands = sig.reshape(-1, rows).astype(U64)
    key = np.arange(1, len(bands) + 1, dtype=U64)
    for i in range(rows):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + bands[:, i])
    return key.view(np.int64)


def signed(docs: DataFrame, key: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    schema = extended(StructType([StructField("id", docs.schema[key].dataType)]), "n long, same binary, bands array<long>")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in it:
            counts, digests, keys = [], [], []
            for text in batch.column(1):
                found = shingler(text.as_py())
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(found, bands * rows), rows) if len(found) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(key).alias("id"), F.col(text_col).cast("string")).mapInArrow(batches, schema)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, shingles): the full sets as 64-bit numbers."""
    schema = extended(StructType([docs.schema["id"]]), "shingles binary")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=schema.names)

    return docs.select("id", "text").mapInArrow(batches, schema)


def similar(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union."""
    schema = StructType([pairs.schema["a"], pairs.schema["b"]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fits, last, x = [], None, None
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                one = one.as_buffer()
                if last is None or not one.equals(last):
                    last, x = one, np.frombuffer(one, U64)
                y = np.frombuffer(other.as_buffer(), U64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                fits.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    one, other = full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), full.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(batches, schema)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) of every linked id: the least id that it reaches.

    Alternately hangs the larger and the smaller neighbours of each id on its least
    neighbour, until nothing changes; then all hang on the roots. Each step is
    written, so a lost executor costs one step at most, and a step's tables go when
    the next is there. The least neighbours are written too: both sides of the join
    with them are plain tables, so Spark can split an id with very many neighbours.
    """

    def hung(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-least")
        near = both.join(least, "a")
        if larger:
            moved = near.where("b > a").select("m", "b")
        else:
            moved = near.where("b < a").select("m", "b").union(least.select("m", F.col("a").alias("b")))
        out = written(moved.select(F.col("m").alias("a"), "b").where("a <> b").distinct(), name)
        dropped(least)
        dropped(edges)
        return out

    def print_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = print_of(edges)
    while True:
        edges = hung(hung(edges, True), False)
        now = print_of(edges)
        if now == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = now


def linked_in_blocks(many: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between members of large buckets (bucket, id, root, first) that are in different components.

    Buckets that share members are taken together, so that each set travels once.
    Members outside the largest component of such a cluster are held against all
    members, block by block: a task holds two blocks of about BLOCK members, and the
    common shingles of one member with all others come from one sorted index. Of
    the links of a member to one component, one is returned.
    """
    hung = written(many.select("id", "first", "root").distinct(), "minhash-large")
    cluster = components(hung.select(F.col("first").alias("a"), F.col("id").alias("b")))
    own = written(hung.select("id", "root").distinct().join(cluster.withColumnRenamed("root", "cluster"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id")), "minhash-clusters")
    sizes = own.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.sum("m").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = own.join(large, "cluster").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asked = dealt.where("root <> largest").select("cluster", F.col("own").alias("i"), F.explode(every).alias("j"), "id", "root", F.lit(True).alias("asks"))
    held = dealt.select("cluster", F.explode(every).alias("i"), F.col("own").alias("j"), "id", "root", F.lit(False).alias("asks"))
    rows = asked.union(held).join(full, "id").select("cluster", "i", "j", "asks", "id", "root", "shingles")
    schema = StructType([StructField("a", full.schema["id"].dataType), StructField("b", full.schema["id"].dataType)])

    def block(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids, found_roots = table.column("id").to_pylist(), table.column("root").to_pylist()
        taken = [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles")]
        there = np.flatnonzero(~asks)
        sizes_ = np.array([len(taken[i]) for i in there], np.int64)
        codes = {r: c for c, r in enumerate(dict.fromkeys(found_roots))}
        roots_ = np.array([codes[found_roots[i]] for i in there], np.int64)
        index = np.concatenate([taken[i] for i in there]) if len(there) else np.empty(0, U64)
        order = np.argsort(index, kind="stable")
        index, owner = index[order], np.repeat(np.arange(len(there)), sizes_)[order]
        out: list[tuple] = []
        for q in np.flatnonzero(asks):
            mine = taken[q]
            low, high = np.searchsorted(index, mine), np.searchsorted(index, mine, side="right")
            spans = high - low
            at = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            both = np.bincount(owner[at], minlength=len(there))
            fits = (100 * both >= percent * (len(mine) + sizes_ - both)) & (roots_ != codes[found_roots[q]])
            hits = np.flatnonzero(fits)
            for h in hits[np.unique(roots_[hits], return_index=True)[1]]:
                out.append((ids[q], ids[there[h]]))
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.Table.from_arrays([pa.array(c, table.schema.field("id").type) for c in columns], names=["a", "b"])

    return rows.groupBy("cluster", "i", "j").applyInArrow(block, schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """Groups of near duplicates: key, n_shingles, class_id, component_id, kept.

    Texts are linked if 100 * intersection >= percent * union of their sets of
    ``width``-word shingles (A-Z lower-cased; shorter texts are one shingle).
    ``class_id`` is the least key with an equal set, ``component_id`` the least key
    reachable by links; ``kept`` marks that row. Null and empty texts have no
    shingles and no links; a row with a null key stands alone and is kept. Repeated
    rows share a class. An empty table gives an empty table.
    """
    bands = bands_for(percent / 100, rows)
    base = written(signed(docs, key, text_col, width, bands, rows), "minhash-signatures")
    usable = base.where(F.col("n") > 0).where(F.col("id").isNotNull())
    classes = written(usable.groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    keys = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # for a link the smaller set must have percent of the larger one's size
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    members = written(keys.join(shared.select("bucket", "hub"), "bucket").select("bucket", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "minhash-buckets")
    stars = members.where(F.col("id") != F.col("hub")).where(fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = members.select("id").distinct()
    full = written(sets(texts.join(wanted, "id", "left_semi"), width).dropDuplicates(["id"]), "minhash-sets")
    links = written(similar(stars, full, percent), "minhash-links")
    roots = components(links)
    # members of one bucket that are not joined yet, hubs aside, are held against each other
    placed = members.where(F.col("id") != F.col("hub")).join(roots, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where("low <> high")
    rest = written(placed.join(open_.select("bucket", "size", "first"), "bucket"), "minhash-open")
    few = rest.where(F.col("size") <= FEW)
    one, other = few.alias("p"), few.alias("q")
    apart = one.join(other, "bucket").where("p.id < q.id and p.root <> q.root").where(fits(F.col("p.n"), F.col("q.n")))
    more = similar(apart.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct(), full, percent)
    many = rest.where(F.col("size") > FEW)
    roots = components(links.union(more).union(linked_in_blocks(many, full, percent)))
    by_set = classes.select("same", F.col("id").alias("class_id")).join(roots.withColumnRenamed("id", "class_id"), "class_id", "left").select("same", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    placed = base.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("same")).alias("same")).join(by_set, "same", "left")
    component = F.coalesce("component_id", "id")
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
