"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its PREFIX nearest of PIVOTS pivots, in order of nearness. A
pivot's inverted file lists the vectors that have it, with its place. For a query the files
of its own pivots are read and the footrule distance (how far apart the places are; a
missing pivot counts as at the end) adds up per vector; the share RERANKED of the nearest
permutations, at least FLOOR of a shard, is ranked anew by the exact inner product.

Vectors are dealt to shards of SHARD by hash and queries to blocks of BLOCK; a task meets
one shard with one block, and the shards' best are merged exactly. Pivots come from the rows
of smallest hashed ids, PIVOTS of them however many rows there are; every row is posted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIVOTS = 128
PREFIX = 64
RERANKED = 0.35
FLOOR = 400
SHARD = 8192
BLOCK = 4096


def comparable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles): rows with an id and a vector of finite numbers that isn't zero.

    Rows that share an id count once, with the smallest vector; of several dimensions the
    most frequent takes part.
    """
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & good)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (common.n if common else 0))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) in the order of the ids."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks()
    flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
    order = np.argsort(ids)
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class PermutationIndex:
    """The pivots' inverted files of one shard."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.vectors, self.pivots, self.prefix = vectors, pivots, min(prefix, len(pivots))
        near = nearest_pivots(vectors, pivots, self.prefix)
        row, place = np.divmod(np.arange(near.size), self.prefix)
        order = np.argsort(near.ravel(), kind="stable")
        bounds = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))
        row, place = row[order], place[order].astype(np.int32)
        self.files = [(row[a:b], place[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    def search(self, query: np.ndarray, k: int, reranked: float, floor: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best of the candidates, best first, ties to the lower row; skip: a row left out, or -1."""
        n = len(self.vectors)
        saved = np.zeros(n, np.int32)
        for at, pivot in enumerate(nearest_pivots(query[None], self.pivots, self.prefix)[0]):
            rows, place = self.files[pivot]
            # the footrule of a pair without the pivot, less that of one with it
            saved[rows] += 2 * self.prefix - at - place - np.abs(place - at)
        if skip >= 0:
            saved[skip] = -1
        most = min(n, max(floor, math.ceil(reranked * n)))
        key = saved.astype(np.int64) * -n + np.arange(n)
        rows = np.argpartition(key, most - 1)[:most] if most < n else np.arange(n)
        rows = np.sort(rows[saved[rows] >= 0])
        scores = (self.vectors[rows] * query).sum(axis=1)
        best = np.argsort(-scores, kind="stable")[:k]
        return rows[best], scores[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, reranked: float = RERANKED, floor: int = FLOOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, ties to smaller ids.

    vectors: as comparable() gives them; queries: rows of the same form. A candidate with the
    query's id is the query itself and left out. An empty side gives no rows.
    """
    n, q = vectors.count(), queries.count()
    chosen = np.array([r.vector for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()])
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(q / block))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = vectors.select(deal(shards).alias("shard"), all_of(blocks).alias("block"), "vec_id", "vector")
    right = queries.select(all_of(shards).alias("shard"), deal(blocks).alias("block"), "vec_id", "vector")

    def meet(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(mine) and len(asked):
            ids, matrix = _matrix(mine)
            index = PermutationIndex(matrix, chosen, prefix)
            for query_id, query in zip(*_matrix(asked)):
                own = int(np.searchsorted(ids, query_id))
                rows, scores = index.search(query, k, reranked, floor, own if own < len(ids) and ids[own] == query_id else -1)
                out.append((np.full(len(rows), query_id), ids[rows], scores))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = comparable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
