"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import checkpoint


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of its component, for every node that an edge names.

    Alternating large-star and small-star steps: each is an aggregation with a join back, so
    that no node's neighbours meet in one task, and about log(n) steps suffice. The edges are
    written to the shared checkpoint folder after each step; only a count and a checksum
    reach the driver.
    """
    hi, lo = F.greatest(a, b).alias("v"), F.least(a, b).alias("u")
    now, mark = checkpoint(edges.select(hi, lo).filter("v > u").distinct()), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select("u", "u").distinct())
        mark = seen
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = checkpoint(small.select("e.v", F.col("e.m").alias("u")).filter("v > u").distinct())
