from __future__ import annotations

import hashlib
import random

from postmill.llm import arrays
from postmill.llm.substrings import op9_substring_dedup, remove_repeats

SF = "/root/testdata/sf0.001"


def brute(docs: list[tuple], window: int) -> dict:
    """docs: (id, text); plain reading of the contract."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op9_substring_dedup(spark, SF).collect()}
    want = brute(docs, 20)
    assert got == want and sum(n for _, n, _ in want.values()) > 0


def test_small_groups_and_chunks_give_the_same(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for d in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 80))]
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + passage[rng.randrange(5) : 20 + rng.randrange(10)] + words[at:])))
    docs += [(100, None), (101, ""), (102, "a " * 500), (103, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in remove_repeats(df, window=6, group=300, chunk=200).collect()}
    assert got == brute(docs, 6)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text, 1), (3, text, 2), (None, text, 3), (4, None, 4)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(-1, 40, 40), (3, 40, 0), (3, 40, 0), (4, 0, 0)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_arrays_survive_squeezing():
    import numpy as np

    for a in (np.array([], np.uint64), np.array([5, 9, 2**63], np.uint64)):
        assert (arrays.unsqueeze(arrays.squeeze(a, True), np.uint64, True) == a).all()
