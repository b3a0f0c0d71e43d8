"""The pipeline's stages, each against a brute-force version on its own input."""

import collections
import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowtrail.llm import language_id, mixing
from rowtrail.llm.queries import source_weights

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(11), []
    for i in range(120):
        words = [rng.choice(["the", "and", "river", "house", "stone"]) + str(rng.randrange(500)) for _ in range(rng.choice([8, 40, 90]))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}" if i % 7 else None, 0))
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(10)]
    rows += [(300 + i, rows[i][1] + " more", "en", "s1", 0) for i in range(10, 30)]
    rows += [(400, None, None, None, None), (401, "", "en", "s2", 0), (402, "123 +-", "en", "s2", 0), (403, "Ω", None, "s3", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        after = docs.collect()
        seen.append(name)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept = collections.Counter(r.doc_id for r in after)
        if name == "language_id":
            told = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(before, SCHEMA), language_id.learn(spark.createDataFrame(before, SCHEMA))).collect()}
            floor = 0.5 * min(r.score for r in told.values() if r.lang == r.lang_pred)
            assert set(kept) == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "") and told[r.doc_id].score >= floor}
            assert 403 not in kept and {400, 401, 402}.isdisjoint(kept) and set(range(120)) <= set(kept)
        elif name == "exact_dedup":
            last = {r.text: r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}
            assert kept == collections.Counter(last.values())
        elif name == "minhash_dedup":
            sets, root = [(r.doc_id, shingles(r.text)) for r in before], {r.doc_id: r.doc_id for r in before}
            for a, x in sets:
                for b, y in sets:
                    if a < b and 100 * len(x & y) >= 80 * len(x | y):
                        low, high = sorted((root[a], root[b]))
                        root = {d: low if r == high else r for d, r in root.items()}
            assert kept == collections.Counter({r for r in root.values()})
        elif name == "source_mixing":
            size = {r.doc_id: len(r.text.split()) for r in before}
            source = {r.doc_id: r.source for r in before}
            sizes, taken = collections.Counter(), collections.Counter()
            for d, n in size.items():
                sizes[source[d]] += n
                taken[source[d]] += n * kept[d]
            targets = mixing.quotas(source_weights(spark.createDataFrame(before, SCHEMA)), sizes, sum(sizes.values()), 3)
            assert max(kept.values()) <= 3 and all(abs(taken[s] - t) <= max(size.values()) for s, t in targets.items())
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = [(r.doc_id, hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in before]
            assert sorted(want) == sorted((r.doc_id, r.ids_sha256) for r in after)
    assert seen == ["language_id", "exact_dedup", "minhash_dedup", "source_mixing", "bpe"]


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_id_without_any_label(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 0), (2, "12 +", None, "s", 0), (3, None, None, "s", 0)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]


def test_rows_of_files_have_numbers_of_their_own(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.numbered(docs, "numbered")
    first, again = ({r.row: r.doc_id for r in rows.select("row", "doc_id").collect()} for _ in range(2))
    assert first == again and len(first) == docs.count() and rows.columns == [*corpus_pipeline.COLUMNS, "row"]
    assert corpus_pipeline.numbered(docs.limit(0), "numbered").count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_null_and_repeated_keys(spark, tmp_path, stored):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(1)), (None, text(2)), (5, text(2)), (7, text(3)), (7, text(3)), (8, text(4)), (8, text(5))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    if stored:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    once = sorted([(None, text(1)), (5, text(2)), (7, text(3)), (8, text(4)), (8, text(5))], key=repr)
    assert seen(corpus_pipeline.identify_language(spark, docs, "")) == sorted(rows, key=repr)
    assert seen(corpus_pipeline.drop_copies(spark, docs, "")) == once
    assert seen(corpus_pipeline.drop_near_copies(spark, docs, "")) == once
    mixed = collections.Counter(seen(corpus_pipeline.mix_sources(spark, docs, "")))
    assert mixed == collections.Counter(rows)
