from __future__ import annotations

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np

from postmill.llm import languages
from postmill.llm.languages import Leader, fit, gram_counts, identify_languages, op12_language_id, softmax, temperature

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and any(c.isalpha() for c in truth[r.doc_id][1])]
    assert len(held) > 200
    assert sum(r.lang_pred != truth[r.doc_id][0] for r in held) <= 0.02 * len(held)
    # calibration: the mean score is about the share of right answers
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id][0] for r in held])) < 0.05


def test_labels_of_the_held_out_fold_and_other_columns_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).toPandas()
    other = docs.copy()
    held = other.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    other.loc[held, "lang"] = "xx"
    other["source"] = "same"
    a, b = (spark.createDataFrame(d[["doc_id", "lang", "source", "text"]]) for d in (docs, other))
    assert sorted(identify_languages(a, fit(a)).collect()) == sorted(identify_languages(b, fit(b)).collect())


def plain_grams(text):
    """Runs of one to three characters of the folded text with a blank at an end at most."""
    folded = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    folded = f" {' '.join(folded.split())} "
    return Counter(folded[i : i + k] for k in (1, 2, 3) for i in range(len(folded) - k + 1) if " " not in folded[i : i + k][1:-1] and folded[i : i + k].strip())


def test_grams_equal_their_definition(monkeypatch):
    rng = random.Random(8)
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(languages, "STRETCH", stretch)
        for _ in range(50):
            text = "".join(rng.choice("aBcé Éñ1.\n語\U0001f600́") for _ in range(rng.randrange(1, 60)))
            if not any(unicodedata.category(c)[0] == "L" for c in text):
                assert gram_counts(text) is None
                continue
            want = plain_grams(text)
            found, counts = gram_counts(text)
            assert counts.sum() == want.total() and abs(len(found) - len(want)) <= 1  # two runs may share a bucket
    assert gram_counts(None) is gram_counts("") is gram_counts("12 .́") is None


def test_leader_equals_the_plain_rule():
    rng = np.random.default_rng(3)
    leader, z, n = Leader(6, 3, alpha=1.5, beta=0.3, l1=0.05, l2=0.01), np.zeros((7, 3)), np.zeros((7, 3))

    def weight(i, k):
        l1, l2 = (0.05, 0.01) if i < 6 else (0.0, 0.0)
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - math.copysign(l1, z[i, k])) / ((0.3 + math.sqrt(n[i, k])) / 1.5 + l2)

    for _ in range(60):
        found = np.sort(rng.choice(6, 3, replace=False))
        x, y = rng.random(3), int(rng.integers(3))
        inputs = [*zip(found, x), (6, 1.0)]
        p = softmax(np.array([sum(v * weight(i, k) for i, v in inputs) for k in range(3)]))
        steps = [(i, k, v * (p[k] - (k == y)), weight(i, k)) for i, v in inputs for k in range(3)]
        for i, k, g, w in steps:
            z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / 1.5 * w
            n[i, k] += g * g
        leader.learn(found, x, y)
    assert np.allclose(leader.z, z, atol=1e-4) and np.allclose(leader.n, n, atol=1e-4)
    strict = Leader(6, 3, l1=1e6)
    strict.learn(np.arange(3), np.ones(3), 1)
    assert not strict.weights(np.arange(6)).any() and strict.weights(np.array([6])).any()


def test_temperature_is_the_best_one():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(4000, 4))
    truth = np.array([rng.choice(4, p=p) for p in softmax(logits)])
    for factor in (0.2, 1.0, 5.0):
        assert abs(temperature(logits * factor, truth, np.ones(4000)) / factor - 1) < 0.15
    assert temperature(logits[:0], truth[:0], np.ones(0)) == 1.0


def test_odd_rows(spark):
    rng = random.Random(9)
    words = {"aa": ["lumo", "kero", "tali"], "bb": ["schtz", "grwmp", "zzkl"]}
    rows = [(i, la, " ".join(rng.choice(words[la]) for _ in range(8)), "t") for i in range(200) for la in [rng.choice(["aa", "bb"])]]
    odd = [(None, "bb", "lumo kero", "t"), (900, None, None, None), (901, "aa", "", "t"), (902, "aa", "12 .,\n", "t"), (903, None, "lumo tali " * 200_000, "t"), (904, "bb", "grwmp", "t"), (904, "bb", "grwmp", "t"), (905, "aa", "퟿\U0001f600", "t")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string, score string")
    model = fit(docs)
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in identify_languages(docs, model).collect()]
    assert len(got) == len(rows) + len(odd)
    assert {(i, la) for i, la, _ in got if i is not None and i < 200} == {(r[0], r[1]) for r in rows}
    assert {g[:2] for g in got if g[0] is None or g[0] in (900, 901, 902, 903, 904)} == {(None, "aa"), (900, "und"), (901, "und"), (902, "und"), (903, "aa"), (904, "bb")}
    assert not any(h for i, _, h in got if i is None)
    assert identify_languages(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify_languages(docs, fit(docs.limit(0))).collect()} == {"und"}
    one = fit(docs.filter("lang = 'aa'"))
    assert {r.lang_pred for r in identify_languages(docs, one).collect()} == {"und", "aa"}
    assert fit(docs, sample=40).langs == ["aa", "bb"]
