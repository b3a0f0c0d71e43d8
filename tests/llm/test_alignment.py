"""The alignment against the tokenizers themselves and plain loops over all links."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtrail.llm import alignment
from rowtrail.llm.queries import PIECES, RANKS, tokenizer_bytes

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BOTH = alignment.Tokenizers(tokenizer_bytes(RANKS), tokenizer_bytes(PIECES))
TEXTS = [None, "", " ", "   ", "a", "The cat's hat isn't flat.", "The cat's hat isn't flat.", "tab\tand\n\nlines \n end ", "<|endoftext|> <s> </s> <0x0A>", "日本語 😀 ½ é \x00 \x7f", "lost ▁ sign", "▁", "x" * 3000, "ab" * 900 + " " * 500 + "c", "=" * 700 + "-" * 700, "internationalisation of misunderstandings"] + [f"number {i} of the list, {i * i}." for i in range(40)]
DOCS = "doc_id long, text string, n_a string, segment string, key string"


def tokens(text):
    """Ids and bytes of both tokenizers' tokens."""
    byte = {v: k for k, v in alignment_bytes().items()}
    a = LIBRARY.encode(" " + text, add_special_tokens=False).ids if text else []
    b = MODEL.encode(text) if text else []
    bytes_a = [bytes(byte[c] for c in LIBRARY.id_to_token(i)) for i in a]
    shown = [MODEL.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, shown)]
    whole = (" " + text).encode()
    return (a, b, bytes_a, bytes_b) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def alignment_bytes():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def groups_of(text):
    a, b, bytes_a, bytes_b = tokens(text or "")
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    cuts, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for cut in cuts:
        own_a, own_b = [], []
        while i < len(a) and ends_a[i] <= cut:
            own_a.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= cut:
            own_b.append(b[j])
            j += 1
        groups.append((own_a, own_b))
    return len(a), len(b), groups


def expected(texts):
    made = [groups_of(t) for t in texts]
    links = [collections.Counter((x, y) for a, b in groups for x in a for y in b) for _, _, groups in made]
    count = collections.Counter(pair for own in links for pair in own)
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (n_a, n_b, groups), own in zip(made, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((n_a, n_b, len(groups), sum(own.values()), sum(t for p, t in own.items() if count[p] == best[p[0]]), sum(t * count[p] for p, t in own.items()), hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out, count, links


def encoded(texts):
    (a, n_a), (b, n_b) = BOTH.encode(texts)
    cut = lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []
    return list(zip(cut(a, n_a), cut(b, n_b), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n▁<|>s/ab'1é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_encodings_equal_the_libraries(texts):
    assert encoded(texts) == [tokens(t)[:2] for t in texts]


def test_every_sign_alone():
    texts = [f"a{chr(i)}{chr(i)} {chr(i)}b" for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    assert encoded(texts) == [tokens(t)[:2] for t in texts]


def test_alignment_equals_plain_loops(spark):
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], None, None, None)], DOCS).repartition(3)
    found = alignment.align(docs, tokenizer_bytes(RANKS), tokenizer_bytes(PIECES))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[1:]) for r in found.collect()}
    want, count, links = expected([*TEXTS, TEXTS[5]])
    for i, row in enumerate(want):
        assert got[i if i < len(TEXTS) else None] == row, (i, TEXTS[i] if i < len(TEXTS) else None)
    index = alignment.segments(docs, tokenizer_bytes(RANKS), tokenizer_bytes(PIECES))
    pairs = {(r.a, r.b): (r.n, r.links) for r in alignment.pair_counts(index, BOTH.width).collect()}
    times = sum(links, collections.Counter())
    assert pairs == {p: (n, times[p]) for p, n in count.items()}


def test_many_segments_and_copies_of_slices(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: tuple(r[1:]) for r in alignment.align(docs, tokenizer_bytes(RANKS), tokenizer_bytes(PIECES), segment_chars=60, asking=4).collect()}
    assert [got[i] for i in range(len(TEXTS))] == expected(TEXTS)[0]


def test_bitmaps_and_planes():
    sizes, docs = np.array([1, 40, 3]), np.array([7, *range(40), 2, 30, 39])
    assert alignment.documents_of(alignment.bitmaps_of(docs, sizes, 40), sizes, 40).tolist() == docs.tolist()
    times = np.array([1, 5, 1, 300, 2])
    assert alignment.times_of(alignment.planes_of(times), 5).tolist() == times.tolist()
    assert alignment.times_of(alignment.planes_of(times[:0]), 0).tolist() == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    found = alignment.align(docs, tokenizer_bytes(RANKS), tokenizer_bytes(PIECES))
    assert sorted(map(tuple, found.collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
    assert alignment.align(docs.where(F.lit(False)), tokenizer_bytes(RANKS), tokenizer_bytes(PIECES)).count() == 0
