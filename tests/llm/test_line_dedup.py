"""Line dedup against a plain rereading of its definition, on texts with pasted passages."""

import random
import re

import pytest

from rowtrail.llm import line_dedup

BREAKS = {"sentence": r"[^\n.!?]*(?:[.!?]+[^\n.!?\x20\x09\x0B-\x0D][^\n.!?]*)*(?:[.!?]+[\x20\x09\x0B-\x0D]|[.!?]*\n|[.!?]*$)", "line": r"[^\n]*(?:\n|$)"}


def by_brute_force(rows, unit, least):
    """rows: (key, text) with distinct keys; returns key -> (clean text, spans, keys copied from)."""
    first, later, rank = {}, {}, lambda k: (k is None, k or 0)
    for key, text in sorted(rows, key=lambda r: rank(r[0])):
        units, at = [], 0
        for piece in re.findall(BREAKS[unit], text or ""):
            words = re.findall(r"[^\x20\x09-\x0D]+", piece.lower())
            if words:
                units.append((at, at + len(piece), words))
            at += len(piece)
        assert at == len(text or "")
        count = lambda a, b, u=units: sum(len(x[2]) for x in u[a:b])
        blocks = {(a, next(b for b in range(a + 1, len(units) + 1) if count(a, b) >= least)) for a in range(len(units)) if count(a, len(units)) >= least}
        if blocks:
            blocks.add((max(a for a in range(len(units)) if count(a, len(units)) >= least), len(units)))
        for a, b in sorted(blocks):
            whole = " ".join(w for u in units[a:b] for w in u[2])
            place = (key, units[a][0])
            if first.setdefault(whole, place) != place:
                later.setdefault(key, []).append((units[a][0], units[b - 1][1], first[whole][0]))
    out = {}
    for key, text in rows:
        gone = later.get(key, [])
        covered = {i for a, b, _ in gone for i in range(a, b)}
        spans = [i for i in sorted(covered) if i - 1 not in covered], [i + 1 for i in sorted(covered) if i + 1 not in covered]
        clean = None if text is None else "".join(c for i, c in enumerate(text) if i not in covered)
        out[key] = clean, list(zip(*spans, strict=True)), sorted({f for *_, f in gone if f is not None})
    return out


def pasted(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["Haus", "der", "été", "river", "and", "x" + str(rng.randrange(300))]) for _ in range(rng.randint(1, 9))) + rng.choice([". ", "! ", ".\n", "\n", "... ", ".a "])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(3)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(passages) if rng.random() < 0.15 else sentence() for _ in range(rng.randint(0, 14)))
        at = rng.randrange(len(text) + 1)
        rows.append((i, text[:at] + " of " + rng.choice(passages).upper() + text[at:] if i % 5 == 0 else text))
    return [*rows, (90, None), (91, ""), (92, "word " * 3000), (93, "Word.\n" * 400), (94, rows[3][1]), (95, "  \n \n"), (None, rows[5][1] + rows[0][1])]


@pytest.mark.parametrize(("unit", "least"), [("sentence", 20), ("sentence", 3), ("line", 12)])
def test_blocks_by_brute_force(spark, unit, least):
    rows = pasted(least)
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], "doc_id long, text string, removed string, other string")
    cleaned = line_dedup.remove_repeats(docs, unit=unit, min_words=least)
    assert cleaned.columns == ["doc_id", "text", "other", "n_removed", "removed", "copied_from"]
    got = {r.doc_id: (r.text, [tuple(s) for s in r.removed], r.copied_from) for r in cleaned.collect()}
    want = by_brute_force(rows, unit, least)
    assert got == want and any(spans for _, spans, _ in got.values())
    assert line_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_a_passage_inside_a_line_goes_and_short_lines_stay(spark):
    passage = "The first of these lines is long enough to count here. The second one follows it at once and has as many words. So does this third, which ends the passage and the test. "
    texts = {1: f"Own words.\n{passage}\nAll rights reserved.", 2: f"Other words run into {passage}and on.\nAll rights reserved."}
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].text == texts[1] and got[2].n_removed == 1 and got[2].copied_from == [1]
    assert got[2].text == "Other words run into The first of these lines is long enough to count here. and on.\nAll rights reserved."


def test_rows_with_one_key(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "own " * 5), (1, f"more\n{text}"), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_repeats(docs).collect())
    kept = [r for r in got if r[0] == 1 and r[2] == 0]
    # equal rows stay together; of the two texts with key 1 one keeps the line
    assert (2, "", 1) in got and (1, "own " * 5, 0) in got and len(got) == 5 and any(text in r[1] for r in kept)


def test_lines_and_paragraphs(spark):
    shared = "This line of five words\n"
    texts = {1: f"own first\n{shared}end", 2: shared * 2 + "The END", 3: None, 4: "", 5: "this  LINE of five words", 6: "end\nend"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.remove_repeats(docs, unit="line", min_words=4).collect()}
    assert got[1].text == texts[1] and got[2].text == "The END" and got[5].text == "" and got[3].text is None and got[6].text == texts[6]
    assert [tuple(s) for s in got[2].removed] == [(0, 48)] and got[2].copied_from == [1]
    paragraphs = spark.createDataFrame([(1, "one two three four\nfive\n\nx"), (2, "y\n \none two three four\nfive")], "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup.remove_repeats(paragraphs, unit="paragraph", min_words=4).select("doc_id", "text").collect())[1] == (2, "y\n \n")
