"""Near copies: the exact join against brute force, and the min-hash form against the exact one."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from postmill.operators import dedupe
from tests.shuffled import shuffled_bytes

SF = "/root/testdata/sf0.01"


def classes(pairs):
    """Smallest member of each linked member's class."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def corpus(seed):
    """Random sets, a hot token, chains of small changes and a large group of near copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    sets = [set(rng.sample(vocabulary, rng.randrange(1, 12))) | ({"hot"} if rng.random() < 0.7 else set()) for _ in range(120)]
    for _ in range(60):
        one = set(rng.choice(sets))
        one.add(rng.choice(vocabulary))
        sets.append(one)
    base = [f"c{i}" for i in range(40)]
    sets += [set(base) - {base[i % 40]} | {f"x{i}"} for i in range(130)]
    return [(i, " ".join(sorted(s))) for i, s in enumerate(sets)] + [(900, "same words"), (901, "words same"), (902, None), (903, "")]


@pytest.mark.parametrize("hot", [3, 2000])
def test_exact_pairs_with_split_lists(spark, hot):
    rows = corpus(1)
    sets = {i: frozenset((t or "").split()) for i, t in rows}
    got = dedupe.near_duplicate_pairs(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.8, hot).collect()
    distinct = {}
    for i in sorted(sets):
        distinct.setdefault(sets[i], i)
    reps = sorted(v for s, v in distinct.items() if s)
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    want |= {(distinct[s], i) for i, s in sets.items() if s and distinct[s] != i}
    assert len(want) > 1000 and {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("full", [4, 50])
def test_minhash_finds_the_classes_of_near_copies(spark, full):
    df = spark.createDataFrame(corpus(2), "id int, t string")
    exact = {(r.id_a, r.id_b): r.jaccard for r in dedupe.near_duplicate_pairs(df, "id", "t", 0.8).collect()}
    found = {(r.id_a, r.id_b): r.jaccard for r in dedupe.near_duplicates_minhash(df, "id", "t", 0.8, full=full).collect()}
    assert all(abs(exact[k] - v) < 1e-9 for k, v in found.items())
    want, got = classes(exact), classes(found)
    assert sum(got.get(x) == c for x, c in want.items()) >= 0.9 * len(want)
    if full == 4:  # the large cluster comes out as stars, not as all its pairs
        assert len(found) < 0.5 * len(exact)
    assert dedupe.near_duplicates_minhash(df.limit(0), "id", "t").count() == 0


def test_minhash_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = {(r.id_a, r.id_b) for r in dedupe.near_duplicate_pairs(docs, "doc_id", "text", 0.8).collect()}
    found = {(r.id_a, r.id_b) for r in dedupe.near_duplicates_minhash(docs, "doc_id", "text", 0.8).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


@pytest.mark.parametrize("find, times", [(dedupe.near_duplicate_pairs, 3), (dedupe.near_duplicates_minhash, 1.5)])
def test_sets_are_not_shuffled_whole(spark, find, times):
    path = Path(SF, "documents.parquet")
    docs = spark.read.parquet(str(path))
    moved = shuffled_bytes(spark, lambda: find(docs, "doc_id", "text", 0.8).count())
    assert moved < times * path.stat().st_size


def test_a_pair_just_in_reach_is_kept_at_any_size(spark):
    rng, rows, want = random.Random(7), [], set()
    for n in range(1, 60):  # a set, and the largest and the smallest that are just near enough
        base = [f"k{n}x{i}" for i in range(n)]
        more = base + [f"m{n}x{i}" for i in range(n // 4)]
        less = base[: -(-4 * n // 5)]
        rows += [(10 * n, base), (10 * n + 1, more), (10 * n + 2, less)]
    sets = {i: frozenset(t) for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    want |= {(first[s], i) for i, s in sets.items() if first[s] != i}
    texts = [(i, " ".join(rng.sample(t, len(t)))) for i, t in rows]
    got = {(r.id_a, r.id_b) for r in dedupe.near_duplicate_pairs(spark.createDataFrame(texts, "id int, t string"), "id", "t", 0.8).collect()}
    assert got == want and len(want) > 100


def test_sets_of_a_cluster_move_once_for_each_block(spark):
    """Some 1,800 pairs of one cluster are checked, and no pair brings its two sets along."""
    words = [f"v{i}" for i in range(8000)]
    rows = [(i, " ".join([*words[:i], *words[i + 1 :], f"x{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")
        found = []
        moved = shuffled_bytes(spark, lambda: found.extend(dedupe.near_duplicate_pairs(df, "id", "t", 0.8).collect()))
    finally:
        spark.conf.set(limit, kept)
    assert len(found) == 60 * 59 // 2 and all(abs(r.jaccard - 7998 / 8002) < 1e-12 for r in found)
    assert moved < 30_000_000


@pytest.mark.parametrize("bucket", [7, 1024])
def test_minhash_compares_all_members_of_large_buckets(spark, monkeypatch, bucket):
    """By default no partner is dropped, whether a bucket is paired in one task or dealt into parts."""
    monkeypatch.setattr(dedupe, "BUCKET", bucket)
    df = spark.createDataFrame(corpus(2), "id int, t string")
    exact = {(r.id_a, r.id_b) for r in dedupe.near_duplicate_pairs(df, "id", "t", 0.8).collect()}
    rows = dedupe.near_duplicates_minhash(df, "id", "t", 0.8).collect()
    found = {(r.id_a, r.id_b) for r in rows}
    assert found <= exact and len(found) >= 0.99 * len(exact) > 5000 and len(rows) == len(found)
