from __future__ import annotations

import itertools
import random
import time

from postmill.llm.toxicity import Model, fit, op2_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op2_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(y for _, y, _ in held) >= 4
    assert sum(p != y for p, y, _ in held) <= 0.05 * len(held)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for p, _, s in held)


def best_segments(scores):
    """Maximal segments by their definition: repeatedly the best of what is left."""
    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        best = max(((sum(scores[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if best[0] > 1e-9:
            out.append((best[2], best[3], round(best[0], 6)))
            todo += [(lo, best[2]), (best[3], hi)]
    return sorted(out)


def test_segments_equal_their_definition():
    model = Model({"good ": 2.0, "fine ": 0.7}, other=-0.5)
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice(["good", "fine", "x", "y", "goods"]) for _ in range(rng.randrange(1, 14))]
        scores = [{"good": 2.0, "fine": 0.7}.get(w, -0.5) for w in words]
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        want = [(ends[a] - len(words[a]) - 1, ends[b - 1] - 1, s) for a, b, s in best_segments(scores)]
        assert [(a, b, round(s, 6)) for a, b, s in model.segments(" ".join(words))] == want


def test_stems_and_whole_words():
    model = Model({"vil": 2.0, "bad ": 3.0, "vilest ": 4.0}, other=-0.1)
    assert [(a, b, s) for a, b, s in model.hits("vile bad, badly evil vilest")] == [(0, 3, 2.0), (5, 8, 3.0), (21, 27, 4.0)]


def test_odd_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" vile" * 3 if i % 4 == 0 else "") for i in range(200)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(None, "vile vile vile", 1), (900, None, 1), (901, "", 1), (901, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    got = {(r.doc_id, r.score >= 0.5) for r in score_toxicity(docs, model).collect()}
    assert got == {(i, i % 4 == 0) for i in range(200)} | {(None, True), (900, False), (901, False)}
    assert score_toxicity(docs.limit(0), model).count() == 0
    assert {r.predicted for r in score_toxicity(docs, fit(docs, labels.limit(0))).collect()} <= {0, 1}


def test_the_scan_is_linear_in_the_hits():
    model = Model({"bad ": 1.0}, other=-0.2)
    for gap in (10, 2, 5):  # falling, rising and level running sums
        text = ("bad " + "x " * gap) * 100_000
        began = time.process_time()
        found = model.segments(text)
        assert time.process_time() - began < 4 and (len(found) == 100_000 if gap >= 5 else len(found) == 1)
    rng = random.Random(1)
    text = " ".join(rng.choice(["bad", "x", "x", "x", "x"]) for _ in range(400))
    scores = [1.0 if w == "bad" else -0.2 for w in text.split()]
    assert sorted(round(s, 6) for _, _, s in model.segments(text)) == sorted(s for _, _, s in best_segments(scores[:400]))
