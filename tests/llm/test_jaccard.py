from __future__ import annotations

import random
import re

from postmill.llm.graph import connected
from postmill.llm.jaccard import jaccard_components, keep_one_of_each, op7_jaccard_join

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(docs, k=5):
    sets = {d: shingle_set(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op7_jaccard_join(spark, SF).collect()} == want
    assert any(c != d for d, (_, c) in want.items())


def templated(n, seed):
    """Near copies of one text at many distances, with a common passage in unrelated texts."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for d in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        docs.append((d, " ".join(words)))
    docs += [(n + d, " ".join([f"u{d}_{i}" for i in range(rng.randrange(3, 30))] + base[:25])) for d in range(40)]
    return docs


def test_a_cluster_in_many_blocks(spark):
    docs = templated(150, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for rows, postings in ((512, 1 << 20), (16, 200)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, rows=rows, postings=postings).collect()}
        assert got == brute(docs)


def test_odd_rows(spark):
    docs = [(5, "One two three four five SIX"), (2, "one two three four five six"), (2, "one two three four five six"), (None, "ONE two three four five six"), (7, None), (8, ""), (9, " \t"), (10, "a b"), (11, "A b"), (None, "alone")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    want = [(5, 2, 2), (2, 2, 2), (2, 2, 2), (None, 2, 2), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (None, 1, None)]
    assert got == sorted(want, key=str)
    assert jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(5000, 5001)], "a long, b long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {i: 0 for i in range(1001)} | {5000: 5000, 5001: 5000}


def test_small_near_copies_are_found_whichever_columns_they_count(spark):
    """Pairs of 8 to 60 shingles around the threshold: one may count its low columns, the other all."""
    rng, docs = random.Random(7), []
    for pair in range(400):
        words = [f"p{pair}_{i}_{rng.randrange(10**6)}" for i in range(rng.randrange(12, 65))]
        n = len(words) - 4
        lost, more = rng.randrange(0, max(2, n // 6)), rng.randrange(0, max(2, n // 6))
        docs += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[lost:] + [f"m{pair}_{i}" for i in range(more)]))]
    want = brute(docs)
    linked = sum(c != d for d, (_, c) in want.items())
    assert 100 < linked < 400
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for postings in (1 << 20, 2000):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, postings=postings).collect()} == want


def test_one_of_each_with_reused_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, "a b c d e f", "first"), (1, "g h i j k l", "another text of id 1"), (2, "A b c d e f", "copy of the first"), (2, "m n o p q r", "clean, though id 2 is a copy elsewhere"),
        (None, "s t u v w x", "one"), (None, "s t u v w x", "one"), (None, "S t u v w x", "one in capitals"), (None, f"{long} end", "near"), (None, f"{long} fin", "near"),
        (None, "G h i j k l", "copy of id 1"), (None, None, "null"), (None, None, "null"), (3, " ", "blank"), (3, " ", "blank"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(3)
    got = sorted((str(r.doc_id), str(r.text).lower()) for r in keep_one_of_each(df).collect())
    near = {t for _, t in got} & {f"{long} end", f"{long} fin"}
    assert len(near) == 1
    want = [("1", "a b c d e f"), ("1", "g h i j k l"), ("2", "m n o p q r"), ("None", "s t u v w x"), ("None", near.pop()), ("None", "none"), ("None", "none"), ("3", " ")]
    assert got == sorted(want)
