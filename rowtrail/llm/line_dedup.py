"""Substring dedup by line or paragraph hashing.

A text is cut into units: sentences within lines, lines, or paragraphs. A passage
that was pasted into the middle of a line shares no line with its source, but it
shares whole sentences. Short units recur by chance, so what is hashed is a block:
the shortest run of adjacent units from a given one on that has ``min_words`` words.
The digests of the normalised blocks are grouped over the whole corpus. The block
that comes first by (document key, position) stays; the others are removed, and
the offsets they had in the original text are kept.

Overlapping blocks are removed as one span. Every unit of a removed block has an
equal unit at an earlier place, so of each passage one occurrence stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import extended, written

#: Where a unit ends; the break belongs to the unit before it.
BREAKS = {
    "sentence": re.compile(r"[.!?][\x20\x09\x0B-\x0D]|\n"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"),
}
MIN_WORDS = 20
ADDED = ("n_removed", "removed", "copied_from")


def units_of(text: str, unit: str) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, number of words) of each unit that has words."""
    begin = 0
    for end in [*(m.end() for m in BREAKS[unit].finditer(text)), len(text)]:
        words = text[begin:end].lower().encode("utf-8", "surrogatepass").split()
        if words:
            yield begin, end, b" ".join(words), len(words)
        begin = end


def blocks_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the block that begins at each unit, and of the block that ends with the text."""
    units = list(units_of(text, unit))
    size = last = 0
    for first in range(len(units)):
        while last < len(units) and size < min_words:
            size += units[last][3]
            last += 1
        if size < min_words:
            break
        yield hashed(units[first:last])
        size -= units[first][3]
    # the last block from the front may leave a few words at the end
    first, size = len(units), 0
    while first and size < min_words:
        first -= 1
        size += units[first][3]
    if size >= min_words:
        yield hashed(units[first:])


def hashed(block: list) -> tuple[int, int, bytes]:
    return block[0][0], block[-1][1], hashlib.blake2b(b" ".join([u[2] for u in block]), digest_size=16).digest()


def text_print(text_col: str) -> Column:
    """Tells rows with one key and different texts apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def hashed_blocks(docs: DataFrame, key: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """One row for each block: id, print, start, end, and the digest as two numbers."""
    schema = extended(StructType([StructField("id", docs.schema[key].dataType)]), "print long, start int, end int, high long, low long")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                which, found = [], []
                for i, text in enumerate(rows.column(2)):
                    made = dict.fromkeys(blocks_of(text.as_py() or "", unit, min_words))
                    which += [i] * len(made)
                    found += made
                which = pa.array(which, pa.int64())
                starts, ends, digests = zip(*found, strict=True) if found else ((), (), ())
                halves = [pa.array([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests], pa.int64()) for i in (0, 8)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(which), rows.column(1).take(which), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *halves], names=schema.names)

    return docs.select(F.col(key).alias("id"), text_print(text_col).alias("print"), F.col(text_col).cast("string")).mapInArrow(batches, schema)


def repeated_blocks(docs: DataFrame, key: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The blocks to remove: id, print, start, end (code points), first_id.

    ``first_id`` is the key of the document whose block stays: the least by key (a
    null key comes last) and position. Null and empty texts, and texts of fewer than
    ``min_words`` words, have no blocks. Rows repeated with the same key and text
    count as one document; rows with the same key and other texts do not.
    """
    blocks = written(hashed_blocks(docs, key, text_col, unit, min_words), "line-blocks")
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "print", "start")
    first = blocks.groupBy("high", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first, "line-repeats")  # so that Spark can split a digest with very many blocks
    return blocks.join(first, ["high", "low"]).where(place != F.col("first")).select("id", "print", "start", "end", F.col("first.id").alias("first_id"))


def merged(blocks: Iterable[dict]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for b in blocks:
        if out and b["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b["end"])
        else:
            out.append((b["start"], b["end"]))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its repeated blocks taken out of the text.

    Adds ``n_removed`` long, ``removed`` array<struct<start, end>> (spans in the
    original text, code points) and ``copied_from`` (distinct keys of the documents
    whose blocks stay instead, null left out); columns of ``docs`` with these names
    are replaced. A text of nothing but repeats becomes empty; null stays null. An
    empty table gives an empty table.
    """
    docs = docs.drop(*ADDED)
    found = repeated_blocks(docs, key, text_col, unit, min_words).groupBy("id", "print").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__blocks"), F.sort_array(F.collect_set("first_id")).alias("__from")
    )
    same = F.col(key).eqNullSafe(F.col("id")) & (text_print(text_col) == F.col("print"))
    rows = docs.alias("d").join(found.alias("f"), same, "left").select("d.*", "__blocks", "__from")
    schema = extended(docs.schema, "n_removed long, removed array<struct<start:int,end:int>>")
    schema = StructType([*schema.fields, StructField("copied_from", found.schema["__from"].dataType)])
    place, kind = docs.columns.index(text_col), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            spans = [merged(x.as_py() or ()) for x in batch.column("__blocks")]
            columns = batch.columns[:-2]
            texts = [t.as_py() for t in columns[place]]
            columns[place] = pa.array([without_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            cut = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
            origin = batch.column("__from")
            origin = pa.array([x.as_py() or [] for x in origin], origin.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, spans), pa.int64()), cut, origin], names=schema.names)

    return rows.mapInArrow(batches, schema)
