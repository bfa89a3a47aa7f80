"""The operators that make sense on arriving data, under Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postmill import fixed
from postmill.operators import dedupe, store
from postmill.operators.buckets import BucketTable
from postmill.operators.tracker import FUNNEL_STAGES
from postmill.session import checkpoint, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the folder that the driver and all executors share."""
    return shared_folder(spark, name)


def _use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- ingest and dedupe ----------------------------------------------------------------


def stream_ingest_upsert(stream: DataFrame, store_path: str, as_of: Column, checkpoint_path: str, buckets: int = 16, keep: int = 2):
    """Writer that merges arriving job rows into a library in hash buckets of its key.

    Each batch rewrites the buckets of its own keys, on the newest version, whoever
    wrote that: a batch job, another stream or an earlier run. The batch's number is
    committed with its rows under a name from the stream's checkpoint, so a batch
    that is run again after its commit changes nothing, and one that broke before it
    leaves nothing behind that is read. The newest ``keep`` versions stay.
    """
    stream_id = hashlib.sha256(checkpoint_path.encode()).hexdigest()[:16]

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable.create(batch.sparkSession, store_path, batch.drop("ord").schema, store.JOB_KEYS, buckets)
        store.merge_jobs(table, batch, as_of, (stream_id, batch_id))
        table.vacuum(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_path)


def stream_dedupe(stream: DataFrame, delay: str = "1 hour", key: str = "canonical_url", ts: str = "ts") -> DataFrame:
    """Drop repeats of a key seen within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


CLAIMS = StructType([StructField("part", StringType()), StructField("kind", StringType()), StructField("key", StringType()), StructField("batch", LongType()), StructField("rank", StringType())])


def stream_dedupe_two_key(
    stream: DataFrame, store_path: str, key_a: str, key_b: str, order_by: Sequence[str], sink: Callable[[DataFrame, int], None],
    checkpoint_path: str, partition_by: Sequence[str] = (), buckets: int = 16,
):
    """Writer that marks repeats under two keys as rows arrive: ``sink`` gets each batch with ``drop_reason``.

    The result is that of ``dedupe_two_key`` over all rows in the order of their batches,
    and within a batch by ``order_by``: a row is kept iff neither of its keys belongs to a
    row kept before it. The keys of kept rows are claims in a bucketed table, each with
    the batch and rank of its row; a batch reads the buckets of its own keys and appends its
    new claims, committed with the batch's number. A batch that is run again finds its claims
    there and gives the same marks, so ``sink`` should replace what it wrote under that number.
    A row without a key shares that key with no other.
    """
    stream_id = hashlib.sha256(checkpoint_path.encode()).hexdigest()[:16]

    def mark(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable.create(batch.sparkSession, store_path, CLAIMS, ["part", "kind", "key"], buckets)
        rank = F.to_json(F.struct(*order_by))
        part = F.to_json(F.struct(*partition_by)) if partition_by else F.lit("")
        rows = checkpoint(batch.withColumns({"_claim_part": part, "_claim_rank": rank, "_a": F.col(key_a).cast("string"), "_b": F.col(key_b).cast("string")}))

        def claims(df: DataFrame) -> DataFrame:
            sides = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in (("a", "_a"), ("b", "_b"))])
            long = df.select(F.col("_claim_part").alias("part"), F.explode(sides).alias("k"), F.lit(batch_id).cast("long").alias("batch"), F.col("_claim_rank").alias("rank"))
            return long.select("part", "k.kind", "k.key", "batch", "rank").filter("key IS NOT NULL")

        def known() -> DataFrame:
            touched = [r[0] for r in claims(rows).select(table.bucket_of()).distinct().collect()]
            return table.read(touched)

        def with_claims(stored: DataFrame) -> DataFrame:
            out = rows
            for kind, c in (("a", "_a"), ("b", "_b")):
                own = stored.filter(F.col("kind") == kind).select(
                    F.col("part").alias("_claim_part"), F.col("key").alias(c), F.struct("batch", "rank").alias(f"_claim{c}")
                )
                out = out.join(own, ["_claim_part", c], "left")
            return out

        if table.marked(stream_id) < batch_id:
            fresh = with_claims(known()).filter("_claim_a IS NULL AND _claim_b IS NULL").drop("_claim_a", "_claim_b")
            kept = dedupe.dedupe_two_key(fresh, "_a", "_b", order_by, ["_claim_part"]).filter("drop_reason IS NULL")
            table.append(claims(kept), (stream_id, batch_id))
        here = F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("_claim_rank").alias("rank"))
        mine = [F.coalesce(F.col(f"_claim{c}") == here, F.col(c).isNull()) for c in ("_a", "_b")]
        told = with_claims(known()).withColumn("drop_reason", F.when(~(mine[0] & mine[1]), F.lit("duplicate")))
        sink(told.select(*batch.columns, "drop_reason"), batch_id)

    return stream.writeStream.foreachBatch(mark).option("checkpointLocation", checkpoint_path)


# --- counts -----------------------------------------------------------------------------


def stream_event_counts(
    stream: DataFrame, width: str = "1 minute", delay: str = "5 minutes", slide: str | None = None, key: str = "client"
) -> DataFrame:
    """Events per window and key; events later than the delay are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = stream.withWatermark("ts", delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), key, "events")


def stream_funnel(stream: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Funnel counters per window and search as tagged rows (ts, query_id, stage) arrive."""
    found = F.col("stage") != "contact"
    counters = [F.count_if(F.col("stage").isin(stages)).alias(name) for name, stages in FUNNEL_STAGES.items()]
    counted = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "query_id")
        .agg(F.count_if(found).alias("raw_found"), *counters, F.count_if(~found).alias("contacts_found"))
    )
    return counted.select(F.col("w.start").alias("window_start"), "query_id", "raw_found", *FUNNEL_STAGES, "contacts_found")


# --- application state ----------------------------------------------------------------

_REGISTERS = StructType(
    [
        StructField(name, kind)
        for name, kind in (
            ("status_seq", LongType()), ("status", StringType()), ("status_us", LongType()), ("applied_seq", LongType()), ("applied_us", LongType()),
            ("stated_seq", LongType()), ("stated", StringType()), ("reset", LongType()), ("mailed", LongType()), ("sent_seq", LongType()), ("sent_us", LongType()),
        )
    ]
)
STATE_OUTPUT = (
    "application_id bigint, status string, outreach_status string, date_applied_us bigint, outreach_sent_us bigint, "
    "last_change_us bigint"
)


class ApplicationFold(StatefulProcessor):
    """Keeps what decides each application's state; events may arrive in any order.

    The value state is a row of registers: the newest status, the first status that means an
    application went in, the newest stated outreach, the newest reset and mail, and the first
    thing sent since that reset. Each is a newest or an oldest of its kind, so a late event
    falls into its place and a batch costs its own events. What was sent is in a list, which is
    added to once a batch, read only when a reset arrives, and emptied up to it.
    With ``late_ms`` entries of the list expire: a reset may then be that much late.
    """

    def __init__(self, late_ms: int | None = None):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.registers = handle.getValueState("registers", _REGISTERS)
        self.sent = handle.getListState("sent", StructType([StructField("seq", LongType()), StructField("us", LongType())]), self.late_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _REGISTERS]
        r = dict(zip(names, self.registers.get() if self.registers.exists() else [None] * len(names), strict=True))
        before = r["reset"]

        def pick(found, seq: str, names: tuple[str, ...], newest: bool = True) -> None:
            best = (max if newest else min)(found, key=lambda e: e[0], default=None)
            if best is not None and (r[seq] is None or (best[0] > r[seq] if newest else best[0] < r[seq])):
                r[seq] = int(best[0])
                r.update(zip(names, best[1:], strict=False))

        def sent_after(entries, reset) -> list[tuple[int, int]]:
            return [(seq, us) for seq, us in entries if reset is None or seq > reset]

        # plain rows: a batch has few of one application, for which whole-column calls cost more than they save
        added: list[tuple[int, int]] = []
        for part in rows:
            columns = [part[c].tolist() for c in ("seq", "event_type", "new_status", "ts_us")]
            events = list(zip(*columns, strict=True))
            status = [(seq, new, us) for seq, kind, new, us in events if kind == "STATUS_CHANGED"]
            stated = [(seq, new, us) for seq, kind, new, us in events if kind != "STATUS_CHANGED"]
            pick(status, "status_seq", ("status", "status_us"))
            pick([(seq, us) for seq, new, us in status if new in fixed.APPLIED_STATUSES], "applied_seq", ("applied_us",), newest=False)
            pick(stated, "stated_seq", ("stated",))
            pick([(seq,) for seq, new, _ in stated if new == "NOT_STARTED"], "reset", ())
            mailed = [(seq, us) for seq, new, us in status if new == "OUTREACH_SENT"]
            pick(mailed, "mailed", ())
            sent = sent_after(mailed + [(seq, us) for seq, new, us in stated if new != "NOT_STARTED"], r["reset"])
            added += sent
            pick(sent, "sent_seq", ("sent_us",), newest=False)
        added = sent_after(added, r["reset"])
        if r["reset"] != before and r["reset"] is not None:
            held = list(self.sent.get()) if self.sent.exists() else []
            left = sent_after(held, r["reset"])
            if len(left) < len(held):
                self.sent.put(left) if left else self.sent.clear()
            r["sent_seq"], r["sent_us"] = min(left + added, default=(None, None))
        if added:
            self.sent.appendList(added)
        self.registers.update(tuple(r[n] for n in names))
        stated = r["stated"] or "NOT_STARTED"
        if stated == "NOT_STARTED" and r["mailed"] is not None and r["mailed"] > (-1 if r["reset"] is None else r["reset"]):
            stated = "EMAIL_SENT"
        yield pd.DataFrame(
            {
                "application_id": [int(key[0])], "status": [r["status"] or "SAVED"], "outreach_status": [stated],
                "date_applied_us": pd.array([r["applied_us"]], "Int64"), "outreach_sent_us": pd.array([r["sent_us"]], "Int64"),
                "last_change_us": pd.array([r["status_us"]], "Int64"),
            }
        )

    def close(self) -> None:
        pass


def stream_application_state(stream: DataFrame, late_ms: int | None = None) -> DataFrame:
    """Current state of every application touched, after each batch; late events count in their place.

    The stream has application_id, seq, ts, event_type, new_status. ``late_ms`` bounds what is
    kept for resets that arrive late; without it they may be late by any time.
    """
    _use_rocksdb(stream.sparkSession)
    events = stream.select(
        "application_id", "seq", "event_type", "new_status", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    )
    mode = "None" if late_ms is None else "ProcessingTime"
    return events.groupBy("application_id").transformWithStateInPandas(ApplicationFold(late_ms), STATE_OUTPUT, "Update", mode)
