"""The flow against an independent solver, the mixing query against its contract, and language ID against plain loops."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rowtrail.llm import language_id, mixing, queries


def cheapest(patterns, demand, repeats):
    """Min-cost flow by Bellman-Ford, one arc for each use of a pattern; returns (flow, cost)."""
    nodes = ["in", *patterns, *(("quota", s) for s in demand), "out"]
    arcs = []  # from, to, capacity, cost; each next to its reverse
    add = lambda a, b, n, c: arcs.extend([[a, b, n, c], [b, a, 0, -c]])
    for p, n in patterns.items():
        for k in range(repeats):
            add("in", p, n, k)
        for s in p:
            if s in demand:
                add(p, ("quota", s), 10**9, 0)
    for s, n in demand.items():
        add(("quota", s), "out", n, 0)
    flow = cost = 0
    while True:
        far, by = {n: float("inf") for n in nodes} | {"in": 0}, {}
        for _ in nodes:
            for i, (a, b, n, c) in enumerate(arcs):
                if n and far[a] + c < far[b]:
                    far[b], by[b] = far[a] + c, i
        if far["out"] == float("inf"):
            return flow, cost
        path, at = [], "out"
        while at != "in":
            path.append(by[at])
            at = arcs[by[at]][0]
        amount = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= amount
            arcs[i ^ 1][2] += amount
        flow, cost = flow + amount, cost + amount * far["out"]


def cost_of(used, n):
    return sum(max(0, min(used - k * n, n)) * k for k in range(3))


@pytest.mark.parametrize("seed", range(60))
def test_flow_is_the_largest_and_cheapest(seed):
    rng = random.Random(seed)
    sources = "abcd"[: rng.randint(1, 4)]
    every = [p for n in range(1, len(sources) + 1) for p in itertools.combinations(sources, n)]
    patterns = {p: rng.randint(0, 12) for p in rng.sample(every, rng.randint(1, len(every)))}
    demand = {s: rng.randint(0, 30) for s in sources}
    flow = mixing.route(patterns, demand, 3)
    used = {p: sum(f.values()) for p, f in flow.items()}
    for s, n in demand.items():
        assert sum(f.get(s, 0) for f in flow.values()) <= n
    assert all(0 <= used[p] <= 3 * n for p, n in patterns.items()) and all(v >= 0 and s in p for p, f in flow.items() for s, v in f.items())
    assert (sum(used.values()), sum(cost_of(used[p], n) for p, n in patterns.items())) == cheapest(patterns, demand, 3)


def test_mixing_documents_of_several_sources(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 40), rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "b", "c"]])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, own array<string>")
    weights, total = {"a": 5, "b": 2, "c": 3}, sum(n for _, n, _ in rows)
    got = {r.doc_id: r for r in mixing.mix(docs, weights, F.col("n"), F.col("own")).collect()}
    sizes, capacity = collections.Counter(), collections.Counter()
    for _, n, own in rows:
        capacity[tuple(own)] += n
        for s in own:
            sizes[s] += n
    wanted = {s: int(q) for s, q in mixing.quotas(weights, sizes, total, 3).items()}
    taken = collections.Counter()
    for i, n, own in rows:
        assert got[i].copies <= 3 and got[i].taken == n * got[i].copies
        taken[tuple(own)] += got[i].taken
    flow, _ = cheapest(capacity, wanted, 3)
    assert abs(sum(taken.values()) - flow) <= 40 * len(capacity) and flow == sum(wanted.values())
    # the patterns of a source must be able to fill it: Hall's condition, up to one document a pattern
    for some in itertools.chain.from_iterable(itertools.combinations(weights, n) for n in (1, 2, 3)):
        assert sum(t for p, t in taken.items() if set(p) & set(some)) >= sum(wanted[s] for s in some) - 40 * len(capacity)


def test_mixing_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, None if i == 7 else " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(["s1", "s1", "s1", "s2", "s10", None])) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_mixing(spark, str(tmp_path)).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by = collections.Counter()
    for i, _, s in rows:
        by[s] += size[i]
    # weights 5, 2, 1, 5 by code point, null last; what exceeds three times a source is shared anew
    weight, limit, fixed = {"s1": 5, "s10": 2, "s2": 1, None: 5}, {s: 3 * n for s, n in by.items()}, {}
    while True:
        free = {s: w for s, w in weight.items() if s not in fixed}
        share = {s: (sum(by.values()) - sum(fixed.values())) * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > limit[s]]
        if not over:
            break
        fixed |= {s: limit[s] for s in over}
    target = {s: fixed.get(s, share.get(s)) for s in weight}
    taken = collections.Counter()
    for i, _, s in rows:
        r = got[i]
        assert (r["size"], r.source_size) == (size[i], by[s]) and abs(r.target - target[s]) < 1e-6 and r.taken in (0, size[i], 2 * size[i], 3 * size[i])
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(5, 0.01 * target[s]) for s in weight)


def grams_by_hand(text):
    signs = "_" + "_".join(re.findall(r"[^\W\d_]+", text.lower())) + "_"
    found = collections.Counter(signs[i : i + n] for n in (1, 2, 3) for i in range(len(signs) - n + 1))
    return {g: n for g, n in found.items() if g != "_"}


def number(gram):
    value = 0
    for c in gram:
        value = value << 21 | (1 if c == "_" else ord(c) + 2)
    return value


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


@pytest.mark.parametrize("size", [20, 400])
def test_out_of_place_distance_by_plain_loops(spark, size):
    rng = random.Random(size)
    words = {"en": "the and with that house river of in to".split(), "de": "und der nicht schön straße über die ein".split(), "fr": "et les être où garçon chez une de".split()}
    text = lambda lang: " ".join(rng.choice(words[lang]) + rng.choice(["", ".", " 12", ","]) for _ in range(rng.randint(1, 60)))
    train = [(lang, text(lang)) for lang in words for _ in range(15)]
    profiles = language_id.learn(spark.createDataFrame(train, "lang string, text string"), size=size)
    by_hand = {}
    for lang in words:
        counts = collections.Counter()
        for own, t in train:
            if own == lang:
                counts.update(grams_by_hand(t))
        by_hand[lang] = ranked(counts, size)
    assert profiles == {lang: [number(g) for g in p] for lang, p in by_hand.items()}
    asked = [(i, text(rng.choice(list(words))), "clash") for i in range(60)] + [(90, "Über ÉTRE the", "x"), (91, "1 2 3", "x")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, score string"), profiles, size=size).collect()}
    for i, t, _ in asked:
        own = ranked(grams_by_hand(t), size) if re.search(r"[^\W\d_]", t) else []
        distance = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)) for lang, p in by_hand.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert got[i] == (("und", 0.0) if not own else (best, pytest.approx(1 - distance[best] / (size * len(own)))))
