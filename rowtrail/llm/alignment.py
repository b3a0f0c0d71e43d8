"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut the same bytes. Where tokens of both end, the text is cut into
groups, and every token of the one is linked with every token of the other in its
group. Documents are gathered in segments. A segment is an inverted index: for each pair
of ids a compressed bitmap of the segment's documents that hold the pair linked, and
bit planes that say how often. Blocks of documents are OR-merged into a segment;
segments have different documents, so a pair's documents in the corpus are the sum of the
popcounts of its bitmaps, and its links the weighted sum of those of its planes.

The sums are dealt by the id of tokenizer A, so a task also knows the highest of each
id. Every segment asks for its own pairs and sets the answers against its postings,
which return each document's scores.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPLIT
from .common import extended, written
from .lm import pack, planes, unpack, unplaned

#: Characters that are encoded and inverted at once, and those of a segment; documents of a segment, whose numbers have 16 bits.
BLOCK_CHARS, SEGMENT_CHARS, SEGMENT_DOCS = 1_000_000, 4_000_000, 60_000
#: Characters of the corpus for each slice of the pairs, and segments that ask one copy of a slice.
SLICE_CHARS, ASKING = 32_000_000, 2048
#: Links of a group up to which they are listed one by one; of larger groups only the different pairs are.
LISTED = 64
DOC_BITS = 16
#: Units whose encodings a worker keeps; bounds memory and changes no result.
MAX_CACHED = 300_000
SEGMENTS = "segment long, docs binary, n_docs int, pairs binary, sizes binary, bitmaps binary, planes binary"
SPACE_SIGN = "▁"
#: Before a space that follows no white space, neither A's words nor B's pieces go on, so what lies between is encoded alone.
UNITS = re.compile(r"(?<=\S)(?= )")


class Tokenizers:
    """Tokenizer A from the lines of a rank file, B from a piece model; their tokens' bytes and encodings."""

    def __init__(self, ranks: bytes, model: bytes):
        entries = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.a = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=entries, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.pieces = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.width = size
        self.a_bytes = np.zeros(max(entries.values()) + 1, np.int64)
        self.a_bytes[list(entries.values())] = [len(token) for token in entries]
        self.b_bytes = np.array([len(p) for p in self.pieces], np.int64)
        # where no piece has a space behind another sign, no merge of B crosses the border of two units
        self.by_unit = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.lone_space = np.array([self.b.piece_to_id(SPACE_SIGN)], np.int32)
        self.units: dict[str, int] = {}
        self.known_a, self.known_b = Encodings(), Encodings()
        self.lossy: set[str] = set()
        #: Decimal ids, each followed by one of the four separators, and their lengths.
        shown = [f"{i}{sep}".encode() for i in range(max(len(self.a_bytes), size)) for sep in (",", "|", ";", "")]
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.shown = np.array(shown, f"S{self.shown_sizes.max()}").view(np.uint8).reshape(len(shown), -1)
        self.filled = np.arange(self.shown.shape[1]) < self.shown_sizes[:, None]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def learn(self, units: set[str]) -> None:
        """Encode the units that are not known yet; each begins with a space, which B adds."""
        new = list(units - self.units.keys())
        if len(self.units) + len(new) > MAX_CACHED:
            self.units, self.known_a, self.known_b, self.lossy, new = {}, Encodings(), Encodings(), set(), list(units)
        if not new:
            return
        self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
        found = [ids if unit != " " else self.lone_space for unit, ids in zip(new, self.b.encode([u[1:] for u in new], num_threads=1), strict=True)]
        raw = [u.encode() for u in new]
        flat, ends = self.known_b.add(found)
        lengths = np.r_[0, np.cumsum(self.b_bytes[flat])][ends]
        if not np.array_equal(lengths, np.cumsum([len(r) for r in raw])) or self.joined(flat.tolist()) != b"".join(raw):
            self.lossy.update(u for u, r, ids in zip(new, raw, found, strict=True) if self.joined(ids) != r)
        self.known_a.add(list(map(self.a.encode_ordinary, new)))

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For both tokenizers, all texts' ids and how many each has; none where the text is empty or its bytes are lost."""
        cut = [UNITS.split(f" {t}") if t else [] for t in texts]
        if self.by_unit:
            self.learn(set(chain.from_iterable(cut)))
        if self.by_unit and (not self.lossy or self.lossy.isdisjoint(chain.from_iterable(cut))):
            sizes = np.array([len(units) for units in cut], np.int64)
            units = np.fromiter(map(self.units.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
            return self.known_a.of(units, sizes), self.known_b.of(units, sizes)
        found = []
        for text in texts:
            ids = self.b.encode(text)
            lost = not text or self.joined(ids) != f" {text}".encode()
            found.append(([], []) if lost else (self.a.encode_ordinary(f" {text}"), ids))
        return tuple((np.array(list(chain.from_iterable(own)), np.int64), np.array([len(x) for x in own], np.int64)) for own in ([f[i] for f in found] for i in (0, 1)))


class Encodings:
    """One tokenizer's ids of the known units, side by side in one array."""

    def __init__(self):
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """The new ids, one after another, and where those of each unit end."""
        flat, ends = np.fromiter(chain.from_iterable(found), np.int32), np.cumsum([len(ids) for ids in found])
        self.ids, self.ends = np.concatenate((self.ids, flat)), np.concatenate((self.ends, self.ends[-1] + ends))
        return flat, ends

    def of(self, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units of all texts, ``sizes`` units each, and the number of ids of each text."""
        begins, lengths = self.ends[units], self.ends[units + 1] - self.ends[units]
        upto = np.cumsum(lengths)
        ids = self.ids[np.repeat(begins - upto + lengths, lengths) + np.arange(int(lengths.sum()))]
        return ids.astype(np.int64), np.diff(np.r_[0, upto][np.r_[0, np.cumsum(sizes)]])


@lru_cache(maxsize=2)
def tokenizers(ranks: bytes, model: bytes) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(ranks, model)


def links_of(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b, times) of the links, those of large groups summed by pair."""
    small = n_a * n_b <= LISTED
    begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    left = np.flatnonzero(small[group_a])
    times = n_b[group_a[left]]
    ends = np.cumsum(times)
    groups = np.repeat(group_a[left], times)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times, times)
    parts = [(groups, np.repeat(a[left], times), b[begin_b[groups] + within], np.ones(len(groups), np.int64))]
    for g in np.flatnonzero(~small):
        own_a, times_a = np.unique(a[begin_a[g] : begin_a[g] + n_a[g]], return_counts=True)
        own_b, times_b = np.unique(b[begin_b[g] : begin_b[g] + n_b[g]], return_counts=True)
        size = len(own_a) * len(own_b)
        parts.append((np.full(size, g), np.repeat(own_a, len(own_b)), np.tile(own_b, len(own_a)), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Block:
    """The alignment of some texts: figures and digests by document, and postings (pair, document) with their times."""

    def __init__(self, texts: list[str | None], t: Tokenizers):
        (a, self.n_a), (b, self.n_b) = t.encode([x or "" for x in texts])
        # both cut the same bytes, so places in all texts together are comparable
        ends_a, ends_b = np.cumsum(t.a_bytes[a]), np.cumsum(t.b_bytes[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        doc_of = np.repeat(np.arange(len(texts)), self.n_a)[np.cumsum(in_a) - 1] if len(cuts) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(doc_of, minlength=len(texts))
        self.digests = self.digested(t, a, b, group_a, group_b, in_a, in_b)
        groups, left, right, times = links_of(a, b, group_a, group_b, in_a, in_b)
        keys = (left * t.width + right) << DOC_BITS | doc_of[groups]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.times = keys[first], np.add.reduceat(times[order], first) if len(keys) else times

    def digested(self, t: Tokenizers, a, b, group_a, group_b, in_a, in_b) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``, or nothing without tokens."""
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        if len(a):
            last_a[upto_a - 1], last_b[upto_b - 1] = 1, 2
            last_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        out[np.arange(len(a)) + (upto_b - in_b)[group_a]] = a * 4 + last_a
        out[np.arange(len(b)) + upto_a[group_b]] = b * 4 + last_b
        text = t.shown[out][t.filled[out]].tobytes()
        ends = np.r_[0, np.cumsum(t.shown_sizes[out])][np.cumsum(self.n_a + self.n_b)].tolist()
        return [hashlib.sha256(text[i:j]).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends, strict=False)]


def or_merged(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The postings of all blocks, in order of pair and document; each block's documents follow the former ones'."""
    offset, keys = 0, []
    for block in blocks:
        keys.append(block.keys + offset)
        offset += len(block.n_a)
    keys, times = np.concatenate(keys), np.concatenate([x.times for x in blocks])
    order = np.argsort(keys, kind="stable")
    return keys[order], times[order]


def bitmaps_of(docs: np.ndarray, sizes: np.ndarray, n_docs: int) -> bytes:
    """A bitmap for each pair: the numbers of its documents, or a bit for each document where that is shorter."""
    dense = sizes * 16 > n_docs
    of_dense = np.repeat(dense, sizes)
    bits = np.zeros((int(dense.sum()), n_docs), bool)
    bits[np.repeat(np.arange(len(bits)), sizes[dense]), docs[of_dense]] = True
    sparse = docs[~of_dense].astype(np.uint16)
    return pack(len(sparse).to_bytes(8, "little") + sparse.tobytes() + np.packbits(bits, axis=1).tobytes())


def documents_of(bitmaps: bytes, sizes: np.ndarray, n_docs: int) -> np.ndarray:
    """The documents of all pairs, one after another."""
    raw, dense = unpack(bitmaps), sizes * 16 > n_docs
    n = int.from_bytes(raw[:8], "little")
    of_dense, out = np.repeat(dense, sizes), np.empty(int(sizes.sum()), np.int64)
    out[~of_dense] = np.frombuffer(raw, np.uint16, n, 8)
    bits = np.frombuffer(raw, np.uint8, offset=8 + 2 * n).reshape(int(dense.sum()), -(-n_docs // 8))
    out[of_dense] = np.nonzero(np.unpackbits(bits, axis=1, count=n_docs))[1]
    return out


def planes_of(times: np.ndarray) -> bytes:
    """Bit planes of the postings' times, the lowest first; all but the first mostly empty."""
    return pack(b"".join(np.packbits(times >> k & 1).tobytes() for k in range(int(times.max(initial=0)).bit_length())))


def times_of(data: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(unpack(data), np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n).astype(np.int64) if n else np.zeros((0, 0), np.int64)
    return (bits << np.arange(len(bits))[:, None]).sum(axis=0) if n else np.zeros(0, np.int64)


def segment_row(number: int, keys: list[pa.Array], blocks: list[Block]) -> pa.RecordBatch:
    postings, times = or_merged(blocks)
    pairs, starts = np.unique(postings >> DOC_BITS, return_index=True)
    sizes = np.diff(np.r_[starts, len(postings)])
    n_docs = sum(len(x.n_a) for x in blocks)
    own = pa.table({"key": pa.chunked_array(keys), **{n: np.concatenate([getattr(x, n) for x in blocks]) for n in ("n_a", "n_b", "n_groups")}, "groups_sha256": [d for x in blocks for d in x.digests]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema) as writer:
        writer.write_table(own)
    values = number, pack(sink.getvalue().to_pybytes()), n_docs, planes(np.diff(pairs, prepend=0)), planes(sizes.astype(np.int32)), bitmaps_of(postings & (1 << DOC_BITS) - 1, sizes, n_docs), planes_of(times)
    types = pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])


def pairs_in(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, np.int64))


def segments(docs: DataFrame, ranks: bytes, model: bytes, key: str = "doc_id", text_col: str = "text", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The inverted index as SEGMENTS, one row for each segment."""
    block_chars = min(BLOCK_CHARS, segment_chars)

    def inverted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(ranks, model), TaskContext.get().partitionId() << 32
        keys, blocks, chars, n = [], [], 0, 0
        for batch in it:
            begin, texts, size = 0, [], 0
            for i, x in enumerate(batch.column(1)):
                texts.append(x.as_py())
                size += len(texts[-1] or "")
                if size >= block_chars or i + 1 == batch.num_rows or n + len(texts) >= SEGMENT_DOCS:
                    keys.append(batch.column(0).slice(begin, len(texts)))
                    blocks.append(Block(texts, t))
                    chars, n = chars + size, n + len(texts)
                    begin, texts, size = i + 1, [], 0
                    if chars >= segment_chars or n >= SEGMENT_DOCS:
                        yield segment_row(number, keys, blocks)
                        keys, blocks, chars, n, number = [], [], 0, 0, number + 1
        if blocks:
            yield segment_row(number, keys, blocks)

    return docs.select(key, F.col(text_col).cast("string")).mapInArrow(inverted, SEGMENTS)


def pair_counts(index: DataFrame, width: int) -> DataFrame:
    """(a, b, n, links): in how many documents each pair of ids is linked, and how often; ``width`` is the size of B's vocabulary."""

    def popcounts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged() -> Iterator[pa.RecordBatch]:
            pairs, back = np.unique(np.concatenate([p for p, _, _ in held]), return_inverse=True)
            sums = [np.bincount(back, weights=np.concatenate([h[i] for h in held]), minlength=len(pairs)).astype(np.int64) for i in (1, 2)]
            for i in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (pairs, *sums)], names=["pair", "n", "links"])

        for batch in it:
            for pairs, sizes, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, n = pairs_in(pairs), unplaned(sizes, np.int32).astype(np.int64)
                if len(own):
                    held.append((own, n, np.add.reduceat(times_of(marks, int(n.sum())), np.cumsum(n) - n)))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    yield from merged()
                    held = []
        if held:
            yield from merged()

    sums = index.select("pairs", "sizes", "planes").mapInArrow(popcounts, "pair long, n long, links long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))
    return sums.select((F.col("pair") / width).cast("long").alias("a"), (F.col("pair") % width).alias("b"), "n", "links")


def dealt(pairs: np.ndarray, slices: int, width: int) -> list[tuple[int, np.ndarray]]:
    """(slice, places of its pairs), by slice; a slice has all pairs of its A ids."""
    place = pairs // width % slices
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[order])) + 1
    return [(int(place[own[0]]), own) for own in np.split(order, edges) if len(own)]


def asked(index: DataFrame, slices: int, copies: int, width: int) -> DataFrame:
    """(slice, copy, segment, pairs): the pairs of each segment, dealt by their A id."""
    names, types = ["slice", "copy", "segment", "pairs"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def asks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for segment, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = pairs_in(packed)
                copy = (segment * 0x9E3779B1 >> 8) % copies
                own = [(s, copy, segment, planes(np.diff(pairs[at], prepend=0))) for s, at in dealt(pairs, slices, width)]
                for i in range(0, len(own), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[i : i + 256], strict=True), types, strict=True)], names=names)

    return index.select("segment", "pairs").mapInArrow(asks, "slice long, copy long, segment long, pairs binary")


def answered(asks: DataFrame, counts: DataFrame, slices: int, copies: int, width: int) -> DataFrame:
    """(segment, slice, n, best): for each pair asked for, its count, and whether it is the highest of its A id."""

    def array(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("pair")
        return pa.table({"slice": [key[0].as_py()], "pairs": [planes(own.column("pair").to_numpy())], "n": [planes(own.column("n").to_numpy())], "best": [pack(np.packbits(own.column("best").to_numpy()).tobytes())]})

    # an A id has at most as many pairs as B has pieces, so neither the window nor a slice grows with one id
    marked = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    rows = marked.select((F.col("a") % slices).alias("slice"), (F.col("a") * width + F.col("b")).alias("pair"), "n", "best")
    arrays = rows.groupBy("slice").applyInArrow(lambda k, t: array(k, t), "slice long, pairs binary, n binary, best binary")
    arrays = written(arrays, "alignment-counts").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    def answer(own: pa.Table, known: pa.Table) -> pa.Table:
        segments, out = own.column("segment").to_pylist(), ([], [])
        if segments:
            pairs, n = (unplaned(known.column(c)[0].as_py(), np.int64) for c in ("pairs", "n"))
            best = np.unpackbits(np.frombuffer(unpack(known.column("best")[0].as_py()), np.uint8), count=len(pairs))
            for x in own.column("pairs"):
                at = np.searchsorted(pairs, pairs_in(x.as_py()))
                out[0].append(planes(n[at]))
                out[1].append(pack(np.packbits(best[at]).tobytes()))
        return pa.table({"segment": pa.array(segments, pa.int64()), "slice": own.column("slice"), "n": pa.array(out[0], pa.binary()), "best": pa.array(out[1], pa.binary())})

    return asks.groupBy("slice", "copy").cogroup(arrays.groupBy("slice", "copy")).applyInArrow(answer, "segment long, slice long, n binary, best binary")


def returned(index: DataFrame, answers: DataFrame, schema, slices: int, width: int) -> DataFrame:
    """The postings of each segment return its documents' scores."""

    def scores(own: pa.Table, told: pa.Table) -> pa.Table:
        one = {c: own.column(c)[0].as_py() for c in own.column_names}
        docs, pairs = pa.ipc.open_stream(unpack(one["docs"])).read_all(), pairs_in(one["pairs"])
        sizes, n_docs = unplaned(one["sizes"], np.int32).astype(np.int64), one["n_docs"]
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        told = {s: (c, b) for s, c, b in zip(*(told.column(c).to_pylist() for c in ("slice", "n", "best")), strict=True)}
        for s, at in dealt(pairs, slices, width):
            n[at] = unplaned(told[s][0], np.int64)
            best[at] = np.unpackbits(np.frombuffer(unpack(told[s][1]), np.uint8), count=len(at))
        owner, times = documents_of(one["bitmaps"], sizes, n_docs), times_of(one["planes"], int(sizes.sum()))
        # integers below 2^53 are exact as doubles
        summed = lambda weights: pa.array(np.bincount(owner, weights=weights, minlength=n_docs).astype(np.int64))
        columns = [summed(times), summed(times * np.repeat(best, sizes)), summed(times * np.repeat(n, sizes))]
        return pa.Table.from_arrays([*(docs.column(c).combine_chunks() for c in ("key", "n_a", "n_b", "n_groups")), *columns, docs.column("groups_sha256").combine_chunks()], names=schema.names)

    return index.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(scores, schema)


def align(docs: DataFrame, ranks: bytes, model: bytes, key: str = "doc_id", text_col: str = "text", segment_chars: int = SEGMENT_CHARS, asking: int = ASKING) -> DataFrame:
    """How the tokens of two tokenizers meet in each row's whole text.

    ``ranks`` is the content of a byte-level rank file (A, over space and text), ``model`` that
    of a piece model (B, which adds the space). Returns key, n_a, n_b, n_groups, n_links,
    n_best, count_sum long and groups_sha256 string. Null and empty texts, and those that
    B does not give back byte for byte, have zeros and ''. Repeated rows count as documents of
    their own. Keys may be null or repeated. An empty table gives an empty table. The size of
    segments, and how many of them ask one copy of a slice, change no result.
    """
    width = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    index = written(segments(docs, ranks, model, key, text_col, segment_chars), "alignment-index")
    chars = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slices, copies = max(8, chars // SLICE_CHARS), max(1, -(-index.count() // asking))
    counts = written(pair_counts(index, width), "alignment-pairs")
    answers = answered(asked(index, slices, copies, width), counts, slices, copies, width)
    schema = extended(docs.select(F.col(key).alias("key")).schema, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return returned(index, answers, schema, slices, width).withColumnRenamed("key", key)
