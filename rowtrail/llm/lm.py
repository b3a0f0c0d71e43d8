"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs of the training texts are counted over the whole corpus. A
count is quantised to ``1 + floor(log2(count))`` levels, and the filter holds the
pair (n-gram, level) for each level up to it. A count is read back by probing the
levels in turn until one is missing. A token's probability interpolates the
quantised pair frequency with the add-one word frequency.

Documents are cut into blocks, whose tokens are numbered and written once. Words and
n-grams are dealt to slices by hash. A slice of the n-grams builds its part of the
filter, with the same bits an entry at every size, and reads back the n-grams that
each block asked for; a slice of the words sends back the exact counts behind the
add-one base score. The answers then meet the block's tokens. So no task and no
driver holds the whole filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, text_of, words_of, written
from .minhash import mixed

U64 = np.uint64
END = b""  #: no word is empty
BLOCK_CHARS, SLICE_CHARS = 2_000_000, 16_000_000
BITS, PROBES, LEVELS = 8, 4, 60
#: Low bits of an n-gram's hash that are dropped; of 1e9 n-grams, 48 bits confuse about 4 in a million.
GRAM_SHIFT = U64(16)
WEIGHT = 0.7  #: of the pair frequency
BLOCKS = "block long, rows binary, words binary, codes binary"
#: Asked: words or differences of n-grams, and their counts. Answered: counts or levels, in the same order.
ASKED, ANSWERED = "kind string, slice long, block long, what binary, counts binary", "kind string, slice long, block long, answer binary"


def pack(values) -> bytes:
    return zstandard.ZstdCompressor(1).compress(values if isinstance(values, bytes) else values.tobytes())


def unpack(data: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


class Words:
    """Numbers for words, kept for the worker's later blocks."""

    def __init__(self):
        self.hashes: dict[bytes, int] = {}

    def block(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, their hashes, the word numbers of all tokens, and each text's token count."""
        if len(self.hashes) > 200_000:
            self.hashes.clear()
        number: dict[bytes, int] = {END: 0}
        codes, sizes = [], []
        for text in texts:
            words = words_of(text)
            words.append(END)
            for w in set(words).difference(number):
                number[w] = len(number)
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
        for w in number.keys() - self.hashes.keys():
            self.hashes[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(self.hashes.__getitem__, number), U64, len(number))
        return list(number), hashes, np.concatenate(codes), np.array(sizes, np.int64)


def one(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes + U64(1))


def two(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left + U64(2)) + right)


def lefts(codes: np.ndarray) -> np.ndarray:
    """The token before each one; each text starts after an end, and every block ends with one."""
    return np.concatenate((codes[-1:], codes[:-1]))


def blocks_of(it: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in it:
        begin, texts, chars = 0, [], 0
        for i, x in enumerate(batch.column(text_at)):
            texts.append(x.as_py() or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(begin, len(texts)), texts
                begin, texts, chars = i + 1, [], 0


def planes(values: np.ndarray) -> bytes:
    """The numbers byte by byte, packed: first all low bytes, then all next ones."""
    return pack(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def unplaned(data: bytes, kind) -> np.ndarray:
    raw = unpack(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def grams_of(hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block, its distinct words first and then its distinct pairs, and each token's pair."""
    pairs, back = np.unique(lefts(codes) * len(hashes) + codes, return_inverse=True)
    grams = np.concatenate((one(hashes), two(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])))
    return grams >> GRAM_SHIFT << GRAM_SHIFT, back


def tokenised(rows: DataFrame) -> DataFrame:
    """From (key, train, text) to BLOCKS: the rows' keys and sizes, the block's distinct words, most frequent first, and the number of each token."""

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = Words(), TaskContext.get().partitionId() << 32
        for batch, texts in blocks_of(it, 2):
            found, _, codes, sizes = words.block(texts)
            order = np.argsort(-np.bincount(codes, minlength=len(found)), kind="stable")
            number = np.empty(len(found), np.uint32)
            number[order] = np.arange(len(found), dtype=np.uint32)
            own = pa.Table.from_batches([batch.select([0, 1])]).append_column("n_tokens", pa.array(sizes))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_table(own)
            columns = [block], [pack(sink.getvalue().to_pybytes())], [pack(b"\n".join(found[i] for i in order))], [planes(number[codes])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])
            block += 1

    return rows.mapInArrow(blocks, BLOCKS)


def opened(rows: bytes, words: bytes, codes: bytes) -> tuple[pa.Table, list[bytes], np.ndarray, np.ndarray]:
    """A block's keys, words, the words' hashes, and the tokens' numbers."""
    found = unpack(words).split(b"\n")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U64, len(found))
    return pa.ipc.open_stream(unpack(rows)).read_all(), found, hashes, unplaned(codes, np.uint32).astype(np.int64)


def asked(blocks: DataFrame, slices: int) -> DataFrame:
    """From BLOCKS to ASKED: each block's words and n-grams with their counts in training texts."""
    names = [x.split()[0] for x in ASKED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, found, hashes, codes = opened(*packed)
                trained = np.repeat(keys.column(1).to_numpy(), keys.column("n_tokens").to_numpy())
                counts, out = np.bincount(codes[trained], minlength=len(found)), []
                for s, own in zip(*by_run(*placed(hashes, slices)), strict=True):
                    out.append(("word", s, block, pack(b"\n".join(found[i] for i in own)), planes(counts[own])))
                # all n-grams, also those that no training text of the block has: their levels are asked for
                grams, back = grams_of(hashes, codes)
                order = np.argsort(grams)
                n = np.concatenate((counts, np.bincount(back[trained], minlength=len(grams) - len(found))))[order]
                grams = grams[order]
                edges = np.searchsorted(grams, np.array([(s << 64) // slices for s in range(1, slices)], U64)).tolist()
                for s, (i, j) in enumerate(zip([0, *edges], [*edges, len(grams)], strict=True)):
                    if i < j:
                        out.append(("gram", s, block, planes(np.diff(grams[i:j] >> GRAM_SHIFT, prepend=U64(0))), planes(n[i:j].astype(np.int32))))
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), types, strict=True)], names=names)

    return blocks.mapInArrow(stats, ASKED)


def placed(hashes: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice of each word, and the words' order by slice."""
    place = (hashes % U64(slices)).astype(np.int64)
    return place, np.argsort(place, kind="stable")


def by_run(place: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    sorted_ = place[order]
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    return [int(sorted_[i]) for i in (0, *edges)], np.split(order, edges)


def reduced(kind: str, number: int, table: pa.Table, bits: int) -> pa.Table:
    """One slice of the words or n-grams: rows of ASKED to rows of ANSWERED.

    Each block gets back the exact counts of its words and the levels of its
    n-grams, in the order in which it sent them. The slice's part of the filter
    never leaves this task.
    """
    what, counts = (lambda: (x.as_py() for x in table.column("what"))), (x.as_py() for x in table.column("counts"))
    answers: list[bytes] = []
    if kind == "gram":
        values = [np.cumsum(unplaned(x, U64), dtype=U64) << GRAM_SHIFT for x in what()]
        ends = np.cumsum([len(x) for x in values])[:-1]
        grams, back = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([unplaned(x, np.int32) for x in counts])).astype(np.int64)
        part = CountFilter([(0, *filled(grams, total, bits))], 1)
        answers = [pack(own) for own in np.split(part.levels(grams).astype(np.uint8)[back], ends)]
        totals = b""
    else:
        number_of: dict[bytes, int] = {}
        words = [np.array([number_of.setdefault(w, len(number_of)) for w in unpack(x).split(b"\n")], np.int64) for x in what()]
        total = np.zeros(len(number_of), np.int64)
        for own, x in zip(words, counts, strict=True):
            total[own] += unplaned(x, np.int64)
        answers = [planes(total[own]) for own in words]
        totals = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
    blocks = table.column("block").to_pylist()
    if totals:
        kinds, blocks, answers = [kind] * len(blocks) + ["total"], [*blocks, 0], [*answers, totals]
    else:
        kinds = [kind] * len(blocks)
    columns = kinds, [number] * len(kinds), blocks, answers
    types = pa.string(), pa.int64(), pa.int64(), pa.binary()
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ANSWERED.split(", ")])


def filled(grams: np.ndarray, counts: np.ndarray, bits: int = BITS) -> tuple[bytes, int]:
    """The slice's part of the filter and its size in bits: ``bits`` for each entry.

    N-grams whose count is 0 have no entry.
    """
    grams, counts = grams[counts > 0], counts[counts > 0]
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    size = max(64, int(levels.sum()) * bits // 8 * 8)
    held = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        entry = grams[levels >= level]
        for probe in range(PROBES):
            held[position(entry, level, probe, U64(size))] = True
    return np.packbits(held, bitorder="little").tobytes(), size


def position(grams: np.ndarray, level: int, probe: int, size) -> np.ndarray:
    h = mixed(grams + U64((level * 8 + probe + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(32)
    return (h * size >> U64(32)).astype(np.int64)


class CountFilter:
    """Reads quantised counts back from the filter's parts."""

    def __init__(self, parts: list[tuple[int, bytes, int]], slices: int):
        size = dict.fromkeys(range(slices), 0) | {s: bits for s, _, bits in parts}
        self.sizes = np.array([size[s] for s in range(slices)], U64)
        self.begins = np.cumsum(self.sizes.astype(np.int64)) - self.sizes.astype(np.int64)
        self.edges = np.array([(s << 64) // slices for s in range(1, slices)], U64)
        self.data = np.frombuffer(b"".join(part for _, part, _ in sorted(parts)), np.uint8)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """How many levels of each n-gram the filter holds, from repeated membership probes."""
        place = np.searchsorted(self.edges, grams, side="right")
        left = np.flatnonzero(self.sizes[place])
        found = np.zeros(len(grams), np.int64)
        sizes, begins = self.sizes[place], self.begins[place]
        for level in range(1, LEVELS):
            for probe in range(PROBES):
                if not len(left):
                    return found
                at = begins[left] + position(grams[left], level, probe, sizes[left])
                left = left[self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
            found[left] = level
        return found


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the range of counts that share the level; 0 if the n-gram is absent."""
    low = 2.0 ** (levels.astype(np.float64) - 1)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


def finished(blocks: DataFrame, answers: DataFrame, schema, slices: int, train_tokens: int, distinct: int) -> DataFrame:
    """Puts what the slices answered to each block's tokens: key, held_out, n_tokens, n_known, base_score, score."""
    whole = train_tokens + distinct + 1.0

    def block(own: pa.Table, answered: pa.Table) -> pa.Table:
        keys, words, hashes, codes = opened(*(own.column(c)[0].as_py() for c in ("rows", "words", "codes")))
        sizes = keys.column("n_tokens").to_numpy()
        answered = answered.sort_by([("kind", "ascending"), ("slice", "ascending")])
        parts = list(zip(answered.column("kind").to_pylist(), answered.column("answer"), strict=True))
        total = np.empty(len(words), np.int64)
        total[placed(hashes, slices)[1]] = np.concatenate([unplaned(x.as_py(), np.int64) for kind, x in parts if kind == "word"])
        grams, back = grams_of(hashes, codes)
        levels = np.empty(len(grams), np.uint8)
        levels[np.argsort(grams)] = np.concatenate([unpack(x.as_py(), np.uint8) for kind, x in parts if kind == "gram"])
        single, pair = middle(levels[: len(words)]), middle(levels[len(words) :])[back]
        follows = np.minimum(pair / np.maximum(single[lefts(codes)], 1.0), 1.0)
        logs = np.log10(WEIGHT * follows + (1 - WEIGHT) * np.minimum((single[codes] + 1.0) / whole, 1.0))
        begin = np.cumsum(sizes) - sizes
        sums = lambda values: pa.array(np.add.reduceat(values, begin))
        held = pa.array([not x for x in keys.column(1).to_pylist()])
        columns = [keys.column(0), held, pa.array(sizes), sums((total > 0)[codes].astype(np.int64)), sums((np.log10(total + 1.0) - np.log10(whole))[codes]), sums(logs)]
        return pa.Table.from_arrays(columns, names=schema.names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block, schema)


def score(docs: DataFrame, train, key: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Scores of all rows by a model of those for which the column ``train`` is true.

    Returns key, held_out boolean (not trained on), n_tokens, n_known, train_tokens
    long, base_score and score double. Tokens are the words of the whole text, A-Z
    lower-cased, and one end; a null text counts as empty and has the end alone. A
    null ``train`` counts as false. Repeated rows count as often as they occur and
    get equal scores. Without training rows all counts are 0. An empty table gives
    an empty table. ``bits`` are those of the filter for each of its entries.
    """
    rows = docs.select(F.col(key), F.coalesce(train, F.lit(False)).alias("train"), text_of(text_col).alias("text"))
    chars = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slices = max(8, chars // SLICE_CHARS)
    blocks = written(tokenised(rows), "lm-blocks")
    answers = asked(blocks, slices).groupBy("kind", "slice").applyInArrow(lambda k, t: reduced(k[0].as_py(), k[1].as_py(), t, bits), ANSWERED)
    answers = written(answers, "lm-answers")
    total = np.zeros(2, np.int64)
    for r in answers.where("kind = 'total'").select("answer").collect():
        total += np.frombuffer(r.answer, np.int64)
    train_tokens, distinct = map(int, total)
    schema = extended(rows.select(F.col(rows.columns[0]).alias("key")).schema, "held_out boolean, n_tokens long, n_known long, base_score double, score double")
    done = finished(blocks, answers.where("kind <> 'total'"), schema, slices, train_tokens, distinct)
    return done.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
