"""All landed responses under one root, batch or stream, by a table of source specifications.

    {root}/source=greenhouse/token=acme/2024-05-01.json     one response per file
    {root}/source=greenhouse/token=acme/2024-05.jsonl       or one per line, under a root of its own

A specification names a source: where the list of items is in a body, how items become
postings, and when the source can be asked. ``register_source`` adds one or puts another in
its place. Files are opened by Spark's own reader, so they may lie wherever Spark can read, a
folder of a source is read for that source alone, and a stream's offsets are the reader's
list of files seen. Bodies, lists and items that cannot be read are told, not lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.session import checkpoint
from postmill.sources import payloads

LANDED = "value string, source string, token string"


@dataclass(frozen=True)
class SourceSpec:
    """A source: the path of its list, its mapping, the settings it needs, and whether it lists remote roles only."""

    name: str
    items: str
    mapping: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    remote_only: bool = False

    def missing(self, settings) -> list[str]:
        return [s for s in self.needs if s not in settings]


_ITEMS = {"lever": "$", "adzuna": "$.results", "themuse": "$.results", "arbeitnow": "$.data", "usajobs": "$.SearchResult.SearchResultItems"}
_ASKED = {name: (tuple(needed), remote) for name, _, needed, remote, _ in fixed.JOB_SOURCES}
SPECS: dict[str, SourceSpec] = {
    name: SourceSpec(name, _ITEMS.get(name, "$.jobs"), reader, *_ASKED.get(name, ((), False))) for name, reader in payloads.READERS.items()
}


def register_source(spec: SourceSpec) -> None:
    SPECS[spec.name] = spec


def _shaped(files: DataFrame, boards: DataFrame | None) -> DataFrame:
    """Files as a payload table: source, body, query_url, token, company (the token's own name where boards have none)."""
    rows = files.select("source", F.col("value").alias("body"), F.col("_file").alias("query_url"), "token")
    if boards is None:
        return rows.withColumn("company", F.col("token"))
    known = boards.groupBy("token").agg(F.min("company").alias("company"))
    return rows.join(known, "token", "left").select("source", "body", "query_url", "token", F.coalesce("company", "token").alias("company"))


def landed_payloads(spark: SparkSession, root: str, boards: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """Everything landed under a root; ``boards`` is (token, company).

    With ``lines`` each line of a file is a response. A crawl of many small responses should
    land so: opening a file costs more than reading a response, and such files can be split.
    """
    files = spark.read.schema(LANDED).format("text").option("wholetext", not lines).load(root)
    return _shaped(files.withColumn("_file", F.input_file_name()), boards)


def landed_postings(landed: DataFrame, settings=None) -> DataFrame:
    """Postings of all sources that have a specification and, if ``settings`` are given, what it needs.

    A source's branch filters by folder, so each file is read once however many sources there are.
    """
    specs = [s for s in SPECS.values() if settings is None or not s.missing(settings)]
    parts = [s.mapping(landed.filter(F.col("source") == s.name).drop("source")) for s in specs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def landed_unreadable(landed: DataFrame) -> DataFrame:
    """What is passed over: source, query_url, reason ('source', 'body', 'list' or 'item') and n."""
    known = [s.name for s in SPECS.values()]
    stray = landed.filter(~F.col("source").isin(known)).select("source", "query_url", F.lit("source").alias("reason"), F.lit(1).cast("long").alias("n"))
    parts = [
        payloads.unreadable(landed.filter(F.col("source") == s.name), s.items).select(F.lit(s.name).alias("source"), "query_url", "reason", "n")
        for s in SPECS.values()
    ]
    return reduce(DataFrame.unionByName, parts, stray)


def stream_landed(
    spark: SparkSession, root: str, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint_path: str, boards: DataFrame | None = None,
    files_per_batch: int = 10_000,
):
    """Writer that gives ``sink`` the postings and the unreadable parts of newly landed files, batch by batch.

    A batch that is run again has the same files and the same number; ``sink`` should replace
    what it wrote under it.
    """
    files = spark.readStream.schema(LANDED).format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(root)

    def take(batch: DataFrame, batch_id: int) -> None:
        landed = checkpoint(_shaped(batch, boards))
        sink(landed_postings(landed), landed_unreadable(landed), batch_id)

    return files.withColumn("_file", F.input_file_name()).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_path)
