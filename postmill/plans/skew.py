"""Plan shapes that stay balanced when one key holds a large share of the rows.

* ``first_per_key`` and ``mark_first`` replace ``row_number() = 1`` windows by
  aggregates, which combine before the shuffle.
* ``first_k`` keeps a rank filter, which Spark turns into a group limit on the
  map side.
* ``ordered_chunks`` with ``running`` computes running sums, maxima and last
  values per key without ever putting one key into one task: rows are range
  partitioned by (key, order), each chunk is scanned on its own, and only one
  summary row per key and chunk is carried across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import checkpoint

CHUNK = "_chunk"
CHUNK_ROWS = 1_000_000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join on keys by which a NULL meets a NULL; gives the left keys and the right side's other columns."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def mark_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Add a flag that is true on the first row of each key; ``order`` must be total."""
    rank = F.struct(*[F.col(c) for c in order])
    firsts = df.groupBy(*keys).agg(F.min(rank).alias("_min_rank"))
    return join_null_safe(df, firsts, keys).withColumn(flag, rank.eqNullSafe(F.col("_min_rank"))).drop("_min_rank")


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; ``rank`` names a 1-based rank to keep."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Range partition by (keys, order) and tag each row with its chunk.

    The chunks are written once, because range bounds come from a sample and
    must not move between the passes that use them. There are as many as keep
    a chunk at CHUNK_ROWS rows, counted first, and no fewer than the shuffle has.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = chunks or max(least, -(-df.count() // CHUNK_ROWS))
    ranged = df.repartitionByRange(count, *[F.col(c) for c in (*keys, *order)])
    return checkpoint(ranged.withColumn(CHUNK, F.spark_partition_id()))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Running aggregates per key, in order, over the output of ``ordered_chunks``.

    ``values`` maps a new column to ("sum" | "max" | "previous", expression).
    Sums and maxima include the current row; "previous" is the value of the
    row before, NULL on the first.
    """
    named = df.withColumns({f"_in_{n}": expr for n, (_, expr) in values.items()})
    order_cols = [F.col(c) for c in order]
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order_cols)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    summaries, local, carried, final = [], {}, {}, {}
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in values.items():
        value = F.col(f"_in_{name}")
        if kind == "previous":
            boxed = F.struct(value.alias("v"))
            summaries.append(F.max_by(boxed, F.struct(*order_cols)).alias(f"_sum_{name}"))
            local[f"_loc_{name}"] = F.lag(boxed).over(inside)
            carried[f"_car_{name}"] = F.lag(f"_sum_{name}").over(across)
            final[name] = F.coalesce(F.col(f"_loc_{name}"), F.col(f"_car_{name}"))["v"]
            continue
        agg = {"sum": F.sum, "max": F.max}[kind]
        summaries.append(agg(value).alias(f"_sum_{name}"))
        local[f"_loc_{name}"] = agg(value).over(so_far)
        carried[f"_car_{name}"] = agg(f"_sum_{name}").over(before)
        if kind == "sum":
            final[name] = F.col(f"_loc_{name}") + F.coalesce(F.col(f"_car_{name}"), F.lit(0))
        else:
            final[name] = F.greatest(F.col(f"_loc_{name}"), F.col(f"_car_{name}"))

    totals = named.groupBy(*keys, CHUNK).agg(*summaries).withColumns(carried)
    totals = totals.select(*keys, CHUNK, *carried)
    joined = join_null_safe(named.withColumns(local), totals, [*keys, CHUNK])
    scratch = [*(f"_in_{n}" for n in values), *local, *carried]
    return joined.withColumns(final).drop(*scratch)
