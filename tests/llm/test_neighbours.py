from __future__ import annotations

import numpy as np

from postmill.llm.neighbours import comparable, nearest, op5_permutation_index

SF = "/root/testdata/sf0.1"


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    want = brute(ids, x, 20)
    got = {}
    for r in op5_permutation_index(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in {v for v, _, _ in found}
        assert [(v, s) for v, s, _ in found] == sorted(((v, s) for v, s, _ in found), key=lambda p: (-p[1], p[0]))
        at = {int(v): i for i, v in enumerate(ids)}
        assert all(abs(s - (x[at[v]] * x[at[q]]).sum()) < 1e-12 for v, s, _ in found)
        hits += len({v for v, _, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.92 * 20 * len(want)


def test_shards_and_blocks_merge_exactly(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    x[50:120] = x[40]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = comparable(rows)
    got = {}
    for r in nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=5, reranked=1.0, shard=70, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in f] for q, f in brute(np.arange(300), x, 5).items()}
    few = nearest(vectors, vectors.filter("vec_id = 40"), k=5, pivots=16, prefix=4, reranked=0.1, floor=10).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [50, 51, 52, 53, 54]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (20, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    vectors = comparable(df)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(vectors, vectors.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 0.5), (0, 2, 20, 0.0), (20, 1, 6, 1.0), (20, 2, 0, 0.0)]
    empty = comparable(df.limit(0))
    assert nearest(empty, empty).count() == 0
