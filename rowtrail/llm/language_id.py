"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (n = 1 to 3,
words marked by their borders), most frequent first. A document's own profile is
compared with each language's by the out-of-place distance: the sum, over the
document's n-grams, of how far each stands from its place in the language's list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended

UNDETERMINED = "und"
PROFILE_SIZE = 400
#: More languages than this are refused: the profiles go to every worker.
MAX_LANGUAGES = 1000
#: Characters whose n-grams are counted at a time.
CHUNK = 1_000_000
BORDER = np.uint64(1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def coded(text: str) -> np.ndarray:
    """The text in lower case as numbers: a letter is its code point + 2, each run of others one border."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[points]
    out = np.where(known, points + np.uint32(2), np.uint32(1)).astype(np.uint64)
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first border after a letter
    out = out[keep]
    return np.concatenate(([BORDER], out, [BORDER])) if len(out) else out


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams of one to three signs as numbers, without the lone border and without those that run from one text into the next."""
    if not len(codes):
        return codes
    two = codes[:-1] << np.uint64(21) | codes[1:]
    inside = two != (BORDER << np.uint64(21) | BORDER)
    three = two[:-1] << np.uint64(21) | codes[2:]
    return np.concatenate((codes[codes != BORDER], two[inside], three[inside[:-1] & inside[1:]]))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def profile_of(text: str | None, size: int) -> np.ndarray:
    """The document's most frequent n-grams, most frequent first, ties by n-gram; empty if no letter."""
    codes = coded(text or "")
    if not len(codes):
        return codes
    values, counts = counted(grams(codes))
    if len(values) > size:  # all n-grams that can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:size]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """The profiles of all languages in ``labelled``, from every row's whole text.

    Rows whose text or language is null teach nothing. Ties go to the lesser n-gram.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                texts.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, own in sorted(texts.items()):
                block, chars = [], 0
                for i, text in enumerate(own):
                    block.append(coded(text))
                    chars += len(text)
                    if chars >= CHUNK or i + 1 == len(own):
                        values, counts = counted(grams(np.concatenate(block)))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
                        block, chars = [], 0

    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    found = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("grams")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: [g.gram for g in r.grams] for r in sorted(found, key=lambda r: r.lang)}


class Places:
    """The place of each known n-gram in each language's profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.languages = sorted(profiles)
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.size = size
        self.places = np.full((len(self.known) + 1, len(self.languages)), -1, np.int64)
        for i, lang in enumerate(self.languages):
            self.places[np.searchsorted(self.known, np.array(profiles[lang], np.uint64)), i] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile_of(text, self.size)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == own, at, len(self.known)) if len(self.known) else at
        places = self.places[at]
        distance = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """All columns of ``docs``, ``lang_pred`` and ``score``; columns of ``docs`` with these names are replaced.

    ``lang_pred`` is the language at the least distance (ties: the lesser name), or
    ``und`` with score 0 where the text is null or has no letter. ``score`` is 1 for
    identical lists and 0 for lists that share nothing. Only the text is looked at.
    """
    docs = docs.drop("lang_pred", "score")
    schema = extended(docs.schema, "lang_pred string, score double")
    place = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Places(profiles, size)
        for batch in it:
            langs, scores = [], []
            for text in batch.column(place):
                lang, score = model.predict(text.as_py())
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(batches, schema)
