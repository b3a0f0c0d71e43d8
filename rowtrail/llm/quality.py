"""Quality rules with the perplexity of a modified Kneser-Ney model.

The model is over n-grams of symbols, and one border between texts. Symbols are the bytes
of the text as they are, or folded to 64 classes, which makes a smaller model. Spark counts
the n-grams of the whole corpus; the shorter ones get their continuation counts,
discounts come from the counts of counts, and each order is kept as a sorted array of
n-gram hashes (the symbols, packed) with its probabilities. The arrays are sent to every
worker. Of what grows with the corpus, n-grams of the highest order, a worker has SLICE
entries at a time; where there are more, the texts pass once for each slice. All else has
at most 256^3 entries whatever the corpus.

A document is rejected if the logarithm of its perplexity leaves the band of its
language: the median of the language's documents and so many of their median deviations
around it. A text that the corpus cannot foresee lies above, one that says little below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, extended, written

ORDER = 4
#: Characters that are folded and counted at once.
BLOCK_CHARS = 4_000_000
#: Entries of the highest order that a worker holds at once, when it counts and when it rates.
SLICE = 1 << 22
#: A row of a stored model has hashes of one range, which is as long as 2^18 or a 4,096th of all.
PART_BITS, LEAST_RANGE = 12, 18
#: Half the width of a band, in median deviations; above the median perplexity, and below it.
UPPER, LOWER = 6.0, 6.0
#: A language's least deviation of the logarithm (base 10) of perplexity, so that very even languages have a band too.
LEAST_DEVIATION = 0.01
#: Bins of the logarithm of perplexity in which medians are taken, for each unit.
BINS = 2000
SPACE = " \t\n\v\f\r"
SYMBOL_SIGNS = "#*$%&|<>"  # fixed values
MIN_WORDS, MAX_REPEATED = 50, 50


def folded() -> np.ndarray:
    """The class of each byte: letters without case, digits, space, nine groups of signs, controls, and 24 classes of bytes beyond ASCII."""
    classes = np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            classes[b] = 40 + b % 24
        elif c.isalpha():
            classes[b] = ord(c.lower()) - ord("a") + 1
        elif c.isdigit():
            classes[b] = 27
        elif c in SPACE:
            classes[b] = 28
        elif c.isprintable():
            classes[b] = 29 + b % 10
        else:
            classes[b] = 39
    return classes


@dataclass(frozen=True, eq=False)
class Alphabet:
    """The symbol of each byte, of so many bits, and the one that stands between texts."""

    symbols: np.ndarray
    bits: int
    border: int


FOLD = folded()
FOLDED = Alphabet(FOLD, 6, 0)
#: Byte 255 never occurs in UTF-8.
BYTES = Alphabet(np.arange(256, dtype=np.uint32), 8, 255)


def range_bits(alphabet: Alphabet, n: int) -> int:
    return max(LEAST_RANGE, alphabet.bits * n - PART_BITS)


def packed(texts: list[str | None], alphabet: Alphabet = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, and the number of symbols of each text.

    A text's last symbol is a border, as are the symbols before its first.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    own = [alphabet.symbols[np.frombuffer(r, np.uint8)] for r in raw]
    border = np.full(ORDER - 1, alphabet.border, np.uint32)
    symbols = np.concatenate([x for o in own for x in (border, o, border[:1])])
    grams = symbols.copy()
    for i in range(1, ORDER):
        grams[i:] |= symbols[:-i] << np.uint32(alphabet.bits * i)
    sizes = np.array([len(o) + 1 for o in own], np.int64)
    ends = np.cumsum(sizes + ORDER - 1)
    keep = np.ones(len(symbols), bool)
    for i in range(ORDER - 1):
        keep[ends - sizes - 1 - i] = False
    return grams[keep], sizes


def in_blocks(it: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in it:
        begin, texts, chars = 0, [], 0
        for i, x in enumerate(batch.column(text_at)):
            texts.append(x.as_py())
            chars += len(texts[-1] or "")
            if chars >= BLOCK_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(begin, len(texts)), texts
                begin, texts, chars = i + 1, [], 0


def counted(docs: DataFrame, text_col: str = "text", alphabet: Alphabet = FOLDED) -> DataFrame:
    """(gram, n): how often each n-gram of the highest order occurs in all texts."""

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 100_000].astype(np.int64)), pa.array(total[i : i + 100_000])], names=["gram", "n"])

        for _, texts in in_blocks(it, 0):
            own, n = np.unique(packed(texts, alphabet)[0], return_counts=True)
            both = np.concatenate([found, own])
            order = np.argsort(both, kind="stable")
            begins = np.flatnonzero(np.diff(both[order], prepend=-1))
            found, total = both[order][begins], np.add.reduceat(np.concatenate([total, n])[order], begins)
            if len(found) > SLICE:  # Spark adds up
                yield from told()
                found, total = found[:0], total[:0]
        yield from told()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(grams: DataFrame) -> list[float]:
    """The modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from the counts of counts.

    Where the corpus is too small for these, as one without n-grams that occur once,
    a discount is 0.5 of what it may be at most.
    """
    n = dict.fromkeys(range(1, 5), 0) | {r.n: r["count"] for r in grams.where("n < 5").groupBy("n").count().collect()}
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return [x if 0 < x < k else 0.5 * k for k, x in enumerate(found, 1)]


def estimated(grams: DataFrame, alphabet: Alphabet = FOLDED) -> list[tuple[DataFrame, DataFrame]]:
    """For each order, lowest first, (gram, p) of what occurs and (context, rest) of what is left to the next lower order.

    ``p`` has the lower orders' share in it; ``rest`` is the weight of the lower order
    after a context, also for n-grams that do not occur.
    """
    counts = [grams]
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: how many different symbols stand before the shorter n-gram
        shorter = F.col("gram").bitwiseAND((1 << alphabet.bits * n) - 1)
        counts.insert(0, written(counts[0].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"quality-counts-{n}"))
    lower = grams.sparkSession.createDataFrame([(0, 1.0 / (1 << alphabet.bits))], "gram long, p double")
    models = []
    for n, own in enumerate(counts, 1):
        d = discounts(own)
        context = F.shiftright("gram", alphabet.bits).alias("context")
        shorter = F.col("gram").bitwiseAND((1 << alphabet.bits * (n - 1)) - 1).alias("short")
        taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = own.select("gram", context, shorter, "n", taken.alias("taken"))
        rest = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("rest"))
        made = rows.join(rest, "context").join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
        p = written(made.select("gram", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("rest") * F.col("below")).alias("p")), f"quality-order-{n}")
        models.append((p, rest.select("context", "rest")))
        lower = p
    return models


def fit(docs: DataFrame, text_col: str = "text", alphabet: Alphabet = FOLDED) -> DataFrame:
    """The model as a stored table of sorted arrays: kind ("p" or "rest"), n, part, hashes and values.

    ``hashes`` are ascending unsigned 32-bit integers, ``values`` doubles. A row has the
    hashes of one range. Null texts count as empty.
    """
    grams = written(counted(docs, text_col, alphabet), "quality-counts")

    def array(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("hash")
        hashes, values = own.column("hash").to_numpy().astype(np.uint32), own.column("value").to_numpy()
        return pa.table({"kind": own.column("kind")[:1], "n": own.column("n")[:1], "part": own.column("part")[:1], "hashes": [hashes.tobytes()], "values": [values.tobytes()]})

    each = []
    for n, (p, rest) in enumerate(estimated(grams, alphabet), 1):
        for kind, table, column in (("p", p.select(F.col("gram").alias("hash"), F.col("p").alias("value")), n), ("rest", rest.select(F.col("context").alias("hash"), F.col("rest").alias("value")), n - 1)):
            part = F.shiftright("hash", range_bits(alphabet, column)).alias("part")
            each.append(table.select(F.lit(kind).alias("kind"), F.lit(n).alias("n"), part, "hash", "value"))
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    schema = "kind string, n int, part long, hashes binary, values binary"
    return written(rows.groupBy("kind", "n", "part").applyInArrow(lambda k, t: array(k, t), schema), "quality-model")


def table_of(arrays: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], bits: int = FOLDED.bits, order: int = ORDER) -> np.ndarray:
    """The probability of each n-gram of an order, found or not."""
    below = np.full(1, 1.0 / (1 << bits))
    for n in range(1, order + 1):
        rest = np.ones(1 << bits * (n - 1))
        at, values = arrays.get(("rest", n), (np.zeros(0, np.uint32), np.zeros(0)))
        rest[at] = values
        # the n-gram's context, and its shorter n-gram, which repeats with every first symbol
        p = np.repeat(rest, 1 << bits)
        p *= np.tile(below, 1 << bits)
        at, values = arrays.get(("p", n), (np.zeros(0, np.uint32), np.zeros(0)))
        p[at] = values
        below = p if n == ORDER else p.astype(np.float32)
    return below


def found_in(hashes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number stands in ascending hashes, and whether it does."""
    if not len(hashes):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
    return at, hashes[at] == asked


class Model:
    """The arrays of a stored model; each worker spreads out once what it needs.

    ``parts``, if given, are the first and the last part of the highest order that is taken; an n-gram of another counts nothing.
    """

    spread: dict[tuple[str, str], np.ndarray] = {}

    def __init__(self, table: DataFrame, name: str, alphabet: Alphabet = FOLDED, parts: tuple[int, int] | None = None):
        # bounded: the lower orders and the contexts have at most 256^3 entries, a slice has SLICE or is one part
        if parts:
            table = table.where((F.col("kind") != "p") | (F.col("n") < ORDER) | F.col("part").between(*parts))
        found: dict[tuple[str, int], list] = {}
        for r in table.collect():
            found.setdefault((r.kind, r.n), []).append((r.part, r.hashes, r["values"]))
        self.name, self.alphabet, self.parts = name, alphabet, parts
        self.arrays = {k: tuple(b"".join(x[i] for x in sorted(parts)) for i in (1, 2)) for k, parts in found.items()}

    def array(self, kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = self.arrays.get((kind, n), (b"", b""))
        return np.frombuffer(hashes, np.uint32), np.frombuffer(values)

    def kept(self, what: str, made: Callable[[], np.ndarray]) -> np.ndarray:
        if (self.name, what) not in Model.spread:
            for other in [k for k in Model.spread if k[0] != self.name]:
                del Model.spread[other]
            Model.spread[self.name, what] = made()
        return Model.spread[self.name, what]

    def logs(self) -> np.ndarray:
        """log10 of the probability of each n-gram of the highest order, found or not, of a model of few symbols."""
        return self.kept("logs", lambda: np.log10(table_of({k: self.array(*k) for k in self.arrays})).astype(np.float32))

    def unseen(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of n-grams that the model has not: the weight that their context leaves, and the shorter n-gram."""
        bits = self.alphabet.bits
        below = self.kept("below", lambda: table_of({k: self.array(*k) for k in self.arrays if k[1] < ORDER}, bits, ORDER - 1))
        contexts, rests = self.array("rest", ORDER)
        context = grams >> np.uint32(bits)
        at, known = found_in(contexts, context)
        left = np.ones(len(grams))
        left[known] = rests[at[known]]
        return np.log10(left * below[grams & np.uint32((1 << bits * (ORDER - 1)) - 1)])

    def rated(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram, 0 where another slice has it."""
        if self.alphabet.bits == FOLDED.bits and not self.parts:
            return self.logs()[grams].astype(np.float64)
        hashes = self.array("p", ORDER)[0]
        values = self.kept("top", lambda: np.append(np.log10(self.array("p", ORDER)[1]), 0.0))
        at, known = found_in(hashes, grams)
        logs = values[at]
        missed = np.flatnonzero(~known)
        logs[missed] = 0.0
        if self.parts:
            part = grams[missed] >> np.uint32(range_bits(self.alphabet, ORDER))
            missed = missed[(part >= self.parts[0]) & (part <= self.parts[1])]
        if len(missed):
            logs[missed] = self.unseen(grams[missed])
        return logs


def slices(table: DataFrame) -> list[tuple[int, int]]:
    """Ranges of parts of the highest order with about SLICE entries each, which together take in every part."""
    sizes = table.where((F.col("kind") == "p") & (F.col("n") == ORDER)).select("part", (F.length("hashes") / 4).cast("long").alias("n")).orderBy("part").collect()
    begins, held = [0], 0
    for r in sizes:
        if held and held + r.n > SLICE:
            begins.append(r.part)
            held = 0
        held += r.n
    return list(zip(begins, [*(b - 1 for b in begins[1:]), (1 << PART_BITS) - 1], strict=True))


def log_sums(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log10 of the probabilities of each text's symbols, as far as the model's slice tells them, and their number."""
    grams, sizes = packed(texts, model.alphabet)
    return np.add.reduceat(model.rated(grams), np.cumsum(sizes) - sizes), sizes


def repeated(words: np.ndarray, width: int) -> int:
    """Words in windows of three that occur twice or more in the text."""
    if width:
        windows = (words[:-2] << 2 * width) | (words[1:-1] << width) | words[2:]
    else:
        pairs = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(words) + pairs[1:]
    ordered = np.sort(windows)
    often = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(often):
        return 0
    starts = np.flatnonzero(np.isin(windows, often))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measured(texts: list[str | None]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    number: dict[bytes, int] = {}
    codes, out = [], np.zeros((5, len(texts)), np.int64)
    for i, text in enumerate(texts):
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()  # at exactly the six signs of white space
        for w in set(words).difference(number):
            number[w] = len(number)
        codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        out[:4, i] = len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOL_SIGNS)), len(lines) - len(set(lines))
    # a word's number has 21 bits, so that a window of three fits into 63, unless the block has more words than that
    width = 21 if len(number) < 1 << 21 else 0
    for i, own in enumerate(codes):
        if len(own) > 3:
            out[4, i] = repeated(own, width)
    return list(out)


def bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high) from all scored documents: medians and median deviations of their logarithms, in bins."""

    def median(counts: DataFrame, name: str) -> DataFrame:
        upto = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy("lang").orderBy("bin")), "all": F.sum("n").over(Window.partitionBy("lang"))})
        return upto.where("2 * upto >= all").groupBy("lang").agg(F.min("bin").alias(name))

    # only counts by bin meet, so a language with most documents is no larger than another
    counts = written(scored.groupBy("lang", F.round(F.col("log_ppl") * BINS).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")), "quality-bins")
    middle = written(median(counts, "middle"), "quality-medians")
    away = counts.join(middle, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("middle")).alias("bin")).agg(F.sum("n").alias("n"))
    wide = F.greatest("away", F.lit(LEAST_DEVIATION * BINS))
    return middle.join(median(away, "away"), "lang").select("lang", ((F.col("middle") - LOWER * wide) / BINS).alias("low"), ((F.col("middle") + UPPER * wide) / BINS).alias("high"))


def rate(docs: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: DataFrame | None = None, alphabet: Alphabet = FOLDED) -> DataFrame:
    """Measures of each row's whole text, and whether it stays.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long,
    base_failed, kept boolean and log_ppl double. A row stays unless base_failed (fewer
    than 50 words, or more than half of them in repeated windows) or its perplexity leaves the
    band of its language. Bands come from all rows that pass the base rules; a language
    none of whose rows do has none and needs none. Null languages share a band. Null texts
    count as empty and fail. Repeated rows count as often as they occur. An empty table gives an
    empty table. ``model`` is one of an earlier ``fit`` over the same ``alphabet``; without it, these rows are fitted.
    """
    model = fit(docs, text_col, alphabet) if model is None else model
    name = f"{id(docs)}-{np.random.default_rng().integers(2**62)}"
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"), F.lit(0.0).alias("logs"))
    *earlier, last = slices(model)
    whole = rows.schema
    for parts in earlier:  # of a model that no worker should hold at once
        shared = docs.sparkSession.sparkContext.broadcast(Model(model, f"{name}-{parts[0]}", alphabet, parts))

        def added(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in in_blocks(it, 2):
                logs = batch.column(3).to_numpy() + log_sums(texts, shared.value)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logs)], names=whole.names)

        before, rows = rows, written(rows.mapInArrow(added, whole), "quality-sums")
        dropped(before, docs)
    shared = docs.sparkSession.sparkContext.broadcast(Model(model, f"{name}-{last[0]}", alphabet, last if earlier else None))
    measures = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    schema = extended(rows.select("key", "lang").schema, ", ".join(f"{m} long" for m in measures) + ", base_failed boolean, log_ppl double")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_blocks(it, 2):
            found = measured(texts)
            logs, sizes = log_sums(texts, shared.value)
            ppl = -(logs + batch.column(3).to_numpy()) / sizes
            failed = (found[0] < MIN_WORDS) | (100 * found[4] > MAX_REPEATED * found[0])
            columns = [batch.column(0), batch.column(1), *map(pa.array, found), pa.array(failed), pa.array(ppl)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    scored = written(rows.mapInArrow(batches, schema), "quality-scores")
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    # written, so that its small size is known, or a language with most documents can be split
    told = scored.join(written(bands(scored.where("not base_failed")), "quality-bands"), "lang", "left")
    return told.select(F.col("key").alias(key), *measures, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "log_ppl")
