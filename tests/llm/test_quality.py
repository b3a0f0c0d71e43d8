"""Quality rules against plain loops, and the model against a plain modified Kneser-Ney."""

import collections
import math
import random
import statistics

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rowtrail.llm import quality, queries

SPACE = " \t\n\v\f\r"
WORDS = "the cat sat on a mat and then it went away to see what they all said about that".split()


def plain_measures(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in SPACE for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\v\x0b\x1c\x85 |#é😀", max_size=60)), min_size=1, max_size=6))
def test_measures(texts):
    found = np.array(quality.measured(texts)).T.tolist()
    assert list(map(tuple, found)) == [plain_measures(t) for t in texts]


def symbols(text):
    return [0] * 3 + [int(quality.FOLD[b]) for b in (text or "").encode("utf-8", "surrogatepass")] + [0]


def plain_model(texts):
    """p(symbol, context) by the book: counts, continuation counts, three discounts, interpolation down to 1/64."""
    counts = [collections.Counter() for _ in range(5)]
    for t in texts:
        s = symbols(t)
        counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for n in (3, 2, 1):
        counts[n].update(g[1:] for g in counts[n + 1])
    models = {}
    for n in range(1, 5):
        of = collections.Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        d = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k for k in (1, 2, 3)]
        d = [x if 0 < x < k else 0.5 * k for k, x in enumerate(d, 1)]
        total, left = collections.Counter(), collections.Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        models[n] = d, total, left

    def p(gram):
        if not gram:
            return 1 / 64
        d, total, left = models[len(gram)]
        c, context = counts[len(gram)][gram], gram[:-1]
        if context not in total:
            return p(gram[1:])
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / total[context] + left[context] / total[context] * p(gram[1:])

    return p


def made(seed=3, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(55, 90))) + "." for _ in range(n)]
    noise = "".join(chr(rng.randrange(33, 127)) if i % 7 else " " for i in range(900))
    return [*texts, noise, "é" * 400, None, "", " \n ", "cat " * 30_000, "short text", texts[0], "\ud800 surrogate".encode("utf-8", "replace").decode()]


def test_model_equals_the_book_and_bands_reject_noise(spark):
    texts = made()
    langs = ["en" if i % 2 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, key string")
    got = {r.doc_id: r for r in quality.rate(docs).collect()}
    p = plain_model(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r[1:6]) == plain_measures(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        s = symbols(t)
        if len(s) < 5000:
            logs = [math.log10(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))]
            assert abs(r.log_ppl + statistics.fmean(logs)) < 1e-5
    noise, plain = got[60], [got[i] for i in range(60)]
    assert not noise.base_failed and not noise.kept
    assert sum(r.kept for r in plain if not r.base_failed) >= 0.95 * sum(not r.base_failed for r in plain)


def test_probabilities_sum_to_one(spark):
    model = quality.fit(spark.createDataFrame([(t,) for t in made(n=8)], "text string"))
    assert {r.kind for r in model.select("kind").distinct().collect()} == {"p", "rest"}
    for r in model.collect():
        assert (np.diff(np.frombuffer(r.hashes, np.uint32).astype(np.int64)) > 0).all()
    sums = (10.0 ** quality.Model(model, "sums").logs().astype(np.float64)).reshape(-1, 64).sum(axis=1)
    assert np.abs(sums - 1).max() < 1e-4


def test_stored_model_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made(n=20))], "doc_id long, text string, lang string")
    model = quality.fit(docs)
    again = {r.doc_id: r.log_ppl for r in quality.rate(docs.where("doc_id < 5"), model=model).collect()}
    assert again == {r.doc_id: r.log_ppl for r in quality.rate(docs).where("doc_id < 5").collect()}
    assert quality.rate(docs.where("false")).count() == 0
    assert quality.rate(docs.select("doc_id", "lang", docs.text.substr(1, 0).alias("text"))).where("kept").count() == 0


def byte_symbols(text):
    return [255] * 3 + list((text or "").encode("utf-8", "surrogatepass")) + [255]


def byte_model(texts):
    """p(gram) over all 256 bytes, by the book."""
    counts = [collections.Counter() for _ in range(5)]
    for t in texts:
        s = byte_symbols(t)
        counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for n in (3, 2, 1):
        counts[n].update(g[1:] for g in counts[n + 1])
    models = {}
    for n in range(1, 5):
        of = collections.Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        d = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k for k in (1, 2, 3)]
        d = [x if 0 < x < k else 0.5 * k for k, x in enumerate(d, 1)]
        total, left = collections.Counter(), collections.Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        models[n] = d, total, left

    def p(gram):
        if not gram:
            return 1 / 256
        d, total, left = models[len(gram)]
        c, context = counts[len(gram)][gram], gram[:-1]
        if context not in total:
            return p(gram[1:])
        return (c - d[min(c, 3) - 1] if c else 0) / total[context] + left[context] / total[context] * p(gram[1:])

    return p


def test_query_tells_all_bytes_apart(spark, tmp_path):
    """Signs, capitals, digits and letters beyond ASCII that one class of the folded alphabet holds."""
    texts = [f"Un été à {i} {t}, dit-il. " for i, t in enumerate(made(n=20)[:20])]
    other = "".join(c.swapcase() if c.isascii() else c for c in texts[0].translate(str.maketrans(".,é", "$\"Ñ")))
    texts = [*texts, other]
    assert np.array_equal(quality.packed([texts[0]])[0], quality.packed([other])[0])
    spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_ppl for r in queries.QUERIES["op12_quality"](spark, str(tmp_path)).collect()}
    p = byte_model(texts)
    for i, t in enumerate(texts):
        s = byte_symbols(t)
        assert abs(got[i] + statistics.fmean(math.log10(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s)))) < 1e-5
    assert abs(got[20] - got[0]) > 0.01


def test_slices_of_a_byte_model_rate_as_the_whole(spark, monkeypatch):
    """Texts that were fitted, and others, whose n-grams the model has not."""
    texts, others = made(n=20), [*made(seed=4, n=3)[:3], "Żółw 42 % <tag>", None, "\0\x7f"]
    docs, foreign = (spark.createDataFrame([(i, t, "en") for i, t in enumerate(x)], "doc_id long, text string, lang string") for x in (texts, others))
    model = quality.fit(docs, alphabet=quality.BYTES)
    rated = lambda: [sorted(map(tuple, quality.rate(d, model=model, alphabet=quality.BYTES).collect())) for d in (docs, foreign)]
    whole = rated()
    p = byte_model(texts)
    for t, r in zip(others, whole[1], strict=True):
        s = byte_symbols(t)
        assert abs(r[-1] + statistics.fmean(math.log10(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s)))) < 1e-5
    monkeypatch.setattr(quality, "SLICE", 200)
    assert len(quality.slices(model)) > 3
    for a, b in zip(sum(whole, []), sum(rated(), []), strict=True):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-9
