"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import random
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtrail.llm import bpe, exact_dedup, language_id, lm, media, mixing
from rowtrail.llm.queries import tokenizer_json

LONG = "word " * 30_000
TEXTS = [None, "", " \n\t ", "a", "It's 2024, the caf\u00e9 isn't 日本語 😀 ½²  \n\n x", "<|endoftext|>a<|endoftext|>", "x" * 5000, LONG, "a b c d e f g", "a b c d e f g", "A  b\nc"]
DOCS = "doc_id long, text string, lang string, source string, n_tokens string, size string"
ROWS = [(i, t, "en", f"s{i % 3}", "clash", "clash") for i, t in enumerate(TEXTS)] + [(8, "a b c d e f g", None, None, None, None), (None, "lost", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


ENCODER = bpe.TrieEncoder(bpe.Vocabulary(tokenizer_json()))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_bpe_equals_the_library(texts):
    found = [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]
    assert found == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_bpe_borders_equal_plain_merging():
    v = ENCODER.v
    ids = [i for b, i in v.ids.items() if len(b) <= 3][:400]
    for left, right in zip(ids, ids[7:] + ids[:7], strict=True):
        a, b = v.bytes[left], v.bytes[right]
        assert ENCODER.may_follow(left, right) == (v.merged(a + b) == [a, b])


def test_bpe_digests(docs, spark):
    got = {r.doc_id: r for r in bpe.digests(docs, tokenizer_json()).collect()}
    for i, text in enumerate(TEXTS):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0), tokenizer_json()).count() == 0


def test_bpe_stored_ids_decode_to_the_texts(docs):
    stored = bpe.encode(docs.drop("n_tokens"), tokenizer_json(), keep=("doc_id", "source"))
    assert stored.columns == ["doc_id", "source", "n_tokens", "ids"]
    back = bpe.decode(stored, tokenizer_json())
    assert rows(back) == sorted(((r[0], r[1] or "") for r in ROWS), key=repr)
    with pytest.raises(ValueError):
        bpe.encode(docs, tokenizer_json(), keep=("n_tokens",))


def test_media_round_trip(docs):
    got = media.describe(media.to_streams(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = (ROWS[r.doc_id][1] if r.doc_id is not None else "lost") or ""
        payload = media.padded(text.encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.lost) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), 0)
        assert r.timestamps == [i * media.TICKS for i in range(math.ceil(len(payload) / media.UNIT))] and r.access_points[0] == 0
    assert media.describe(media.to_streams(docs.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000), st.integers(0, 3))
def test_media_streams_hold_any_payload(data, times):
    payload = media.padded(data * (1 + 40 * times))
    stream = media.mux(payload)
    found = media.demux(stream)
    assert found.payload == payload and len(stream) % media.PACKET == 0 and found.lost == 0


def test_media_counts_lost_packets():
    stream = media.mux(media.padded(b"x" * 5000))
    assert media.demux(stream[: 188 * 5] + stream[188 * 6 :]).lost == 1
    with pytest.raises(ValueError):
        media.demux(b"x" * 188)


def test_digest_index_grows_over_batches(spark, tmp_path):
    """Several batches in one folder that is closed and opened again; held against plain loops."""
    rng, path, first = random.Random(7), str(tmp_path / "index"), {}
    for number in range(6):
        batch = [(100 * number + i, f"text {rng.randrange(60)}") for i in range(40)]
        docs = spark.createDataFrame(batch, "doc_id long, text string")
        index = exact_dedup.DigestIndex(spark, path, buckets=3)
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(docs, index).collect()}
        for text in {t for _, t in batch} - first.keys():
            first[text] = max(i for i, t in batch if t == text)
        assert got == {i: (first[t], first[t] == i) for i, t in batch}
        assert sorted(r.keep_id for r in index.read().collect()) == sorted(first.values())
        if number < 5:
            index.close()
    assert index.generation > 0 and sorted(p.name for p in (tmp_path / "index").iterdir())[0] == f"base-{index.generation}"
    # a merge that did not finish leaves the last complete base in place
    (tmp_path / "index" / f"base-{index.generation + 1}").mkdir()
    assert exact_dedup.DigestIndex(spark, path, buckets=3).generation == index.generation
    index.merge()
    files = list((tmp_path / "index" / f"base-{index.generation}").glob("*.parquet"))
    assert len(files) == 3 and index.read().count() == len(first)
    # neither a shuffle nor a sort between the base and the join
    with exact_dedup.sorted_buckets(spark):
        base = index.parts()[0].select("digest").hint("merge")
        plan = docs.select(exact_dedup.digest().alias("digest")).join(base, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    assert spark.conf.get(exact_dedup.BUCKET_ORDER) == "false"


def test_exact_dedup(docs, spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = exact_dedup.deduplicate(docs, index)
    assert rows(got.where("doc_id in (8, 9)"), "doc_id", "keep_id", "group_size", "kept") == [(8, 9, 3, False), (8, 9, 3, False), (9, 9, 3, True)]
    assert rows(got.where("doc_id in (0, 1)"), "doc_id", "kept") == [(0, False), (1, True)]
    assert rows(got.where("doc_id is null"), "kept") == [(True,)]
    later = spark.createDataFrame([(50, "a"), (51, "new"), (52, "new")], "doc_id long, text string")
    assert rows(exact_dedup.deduplicate(later, index), "doc_id", "keep_id", "kept") == [(50, 3, False), (51, 52, False), (52, 52, True)]
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    assert again.read().count() == index.read().count() == len({t or "" for _, t, *_ in ROWS}) + 1
    assert exact_dedup.deduplicate(docs.limit(0), exact_dedup.DigestIndex(spark, buckets=2)).count() == 0
    before = {t.name for t in spark.catalog.listTables()}
    assert rows(exact_dedup.deduplicate_once(docs)) == rows(got) and {t.name for t in spark.catalog.listTables()} == before
    assert exact_dedup.buckets_for(10) == exact_dedup.LEAST_BUCKETS and exact_dedup.buckets_for(10**11) == 25_000


def test_language_id(spark):
    words = {"en": "the and with that house river", "de": "und der nicht schön straße über", "fr": "et les être où garçon chez"}
    train = [(lang, f"{text} " * k) for lang, text in words.items() for k in (1, 2, 3)] + [(None, "the"), ("en", None)]
    profiles = language_id.learn(spark.createDataFrame(train, "lang string, text string"))
    assert sorted(profiles) == ["de", "en", "fr"]
    asked = spark.createDataFrame([(1, "The HOUSE and that river", "x"), (2, "nicht über die Straße", "x"), (3, "123 ... !", "x"), (4, None, "x"), (5, "", "x"), (6, LONG, "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(asked, profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[6].lang_pred in profiles
    assert language_id.predict(asked, language_id.learn(spark.createDataFrame([], "lang string, text string"))).where("lang_pred <> 'und'").count() == 0


def test_language_grams_by_brute_force():
    text = "Ab, ab! é"
    signs = "_ab_ab_é_"
    want = collections.Counter(signs[i : i + n] for n in (1, 2, 3) for i in range(len(signs) - n + 1))
    del want["_"]
    values, counts = language_id.counted(language_id.grams(language_id.coded(text)))

    def shown(v):
        out = ""
        while v:
            c, v = int(v) & 0x1FFFFF, int(v) >> 21
            out = ("_" if c == 1 else chr(c - 2)) + out
        return out

    assert {shown(v): int(c) for v, c in zip(values, counts, strict=True)} == dict(want)


def test_lm_base_scores_and_filter(docs):
    train = F.col("doc_id") % 3 != 0
    got = lm.score(docs, train).collect()
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t, *_ in ROWS]
    counts = collections.Counter(w for d, ws in tokens if d is not None and d % 3 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=repr) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm.score(docs.limit(0), train).count() == 0


def test_count_filter_reads_levels_back():
    grams = np.unique(lm.mixed(np.arange(5000, dtype=np.uint64)))
    counts = np.arange(1, len(grams) + 1) % 50 + 1
    bits, size = lm.filled(grams, counts)
    model = lm.CountFilter([(0, bits, size)], 1)
    level = 1 + np.floor(np.log2(counts)).astype(int)
    assert (model.levels(grams) >= level).all() and (model.levels(grams) == level).mean() > 0.95
    assert (model.levels(lm.mixed(grams)) > 0).mean() < 0.06


@pytest.mark.parametrize("n", [3, 400])
def test_mixing_hits_targets(spark, n):
    data = [(i, "w " * (1 + i * 7 % 50), "ab" if i % 3 == 0 else "a" if i % 3 == 1 else None) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    weights = {"a": 5, "ab": 2, None: 1}
    mixed = mixing.mix(docs, weights, mixing.n_words(), F.array("source"))
    got = mixed.collect()
    assert rows(mixing.mix(docs, weights, mixing.n_words(), F.array("source"))) == sorted(map(tuple, got), key=repr)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", data[r.doc_id][1])) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        sizes[r.sources[0]] += r["size"]
        taken[r.sources[0]] += r.taken
    targets = mixing.quotas(weights, sizes, sum(sizes.values()), 3)
    assert abs(float(sum(targets.values())) - sum(sizes.values())) < 1e-6
    for s, t in targets.items():
        assert t <= 3 * sizes[s] and abs(taken[s] - t) <= (0.01 * t if n > 100 else max(r["size"] for r in got))


def test_mixing_edge_cases(docs):
    got = mixing.mix(docs.drop("size", "n_tokens"), {"s0": 1, "s1": 1, None: 1}, mixing.n_words(), F.array("source")).collect()
    assert len(got) == len(ROWS) and all(r.taken == 0 for r in got if r.sources == ["s2"])
    assert mixing.mix(docs.limit(0), {}, mixing.n_words(), F.array("source")).count() == 0


def test_flow_prefers_fresh_tokens_and_reroutes():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 10, "b": 10}, 3)
    assert flow[("a",)] == {"a": 10} and {s: n for s, n in flow[("a", "b")].items() if n} == {"b": 10}
    flow = mixing.route({("a", "b"): 10, ("b",): 4}, {"a": 12, "b": 8}, 3)
    assert sum(f.get("a", 0) for f in flow.values()) == 12 and sum(f.get("b", 0) for f in flow.values()) == 8
    assert sum(flow[("b",)].values()) >= 4


def test_lm_slices_keep_their_bits_at_any_number_of_slices(spark):
    """A slice's part of the filter must not shrink as the corpus and so the slices grow."""
    texts = [(i, True, " ".join(f"w{i * 20 + k}" for k in range(20))) for i in range(300)]
    wanted = (1000, False, " ".join(f"w{k * 37 % 6000}" for k in range(2000)))
    docs = spark.createDataFrame([*texts, wanted], "doc_id long, train boolean, text string").coalesce(1)
    table = lm.asked(lm.tokenised(docs), 1).where("kind = 'gram'").toArrow()
    (row,) = lm.reduced("gram", 0, table, lm.BITS).to_pylist()
    levels, counts = lm.unpack(row["answer"], np.uint8), lm.unplaned(table.to_pylist()[0]["counts"], np.int32)
    assert (levels >= (counts > 0)).all() and (counts == 0).sum() > 1900
    assert (levels[counts == 0] > 0).mean() < 0.06


def test_lm_scores_by_brute_force(docs):
    """With ample bits the filter holds the quantised counts, so the model's score can be worked out by hand."""
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = lm.score(docs, train, bits=4000).collect()
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t, *_ in ROWS]
    single, pair = collections.Counter(), collections.Counter()
    for d, ws in tokens:
        if d is not None and d % 3:
            single.update(ws)
            pair.update(zip([b"", *ws], ws, strict=False))
    whole = sum(single.values()) + len(single) + 1
    middle = lambda n: 0 if not n else (3 * 2 ** math.floor(math.log2(n)) - 1) / 2
    follows = lambda a, b: min(1, middle(pair[a, b]) / max(1, middle(single[a])))
    log = lambda a, b: math.log10(lm.WEIGHT * follows(a, b) + (1 - lm.WEIGHT) * min(1, (middle(single[b]) + 1) / whole))
    want = sorted(((d, round(sum(log(a, b) for a, b in zip([b"", *ws], ws, strict=False)), 5)) for d, ws in tokens), key=repr)
    assert sorted(((r.doc_id, round(r.score, 5)) for r in got), key=repr) == want


def test_mixing_passes_over_documents_that_do_not_fit(spark):
    sizes = [5000] + [10] * 500
    docs = spark.createDataFrame([(i, n, "a") for i, n in enumerate(sizes)], "doc_id long, n int, source string")
    for seed in range(3):
        mixed = mixing.mix(docs, {"a": 1}, F.col("n"), F.array("source"), total=2000, seed=seed)
        assert sum(r.taken for r in mixed.collect()) == 2000
