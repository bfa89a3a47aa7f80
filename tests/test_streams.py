"""Streams against their batch twins, over restarts, replays, late rows and late resets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import tracker
from postmill.operators.buckets import BucketTable
from postmill.session import shared_folder
from postmill.streaming import streams


def fold(batches):
    """Rows in the order of their batches, then of their rank: kept unless a key was taken before."""
    a, b, kept = set(), set(), set()
    for batch in batches:
        for i, x, y, p in sorted(batch):
            if (p, x) not in a and (p, y) not in b:
                a |= {(p, x)} if x is not None else set()
                b |= {(p, y)} if y is not None else set()
                kept.add(i)
    return kept


@pytest.mark.parametrize("breaks", [False, True])
def test_two_key_dedupe_of_arriving_rows(spark, breaks):
    rng, root = random.Random(3), shared_folder(spark, "two-key")
    schema = "ord int, a string, b string, part string"
    rows = [(i, rng.choice([None, *(f"a{j}" for j in range(30))]), rng.choice([None, *(f"b{j}" for j in range(30))]), rng.choice("xy")) for i in range(160)]
    rng.shuffle(rows)  # late rows: order of arrival is not the order of rank
    batches = [rows[i : i + 40] for i in range(0, 160, 40)]
    written, failing = {}, {1, 3} if breaks else set()

    def sink(df, batch_id):
        told = {r.ord: r.drop_reason for r in df.collect()}
        if batch_id in failing:
            failing.remove(batch_id)
            raise RuntimeError("lost after the claims were committed")
        written[batch_id] = told

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        for _ in range(2):  # a new query on the same checkpoint takes up a broken batch
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            query = streams.stream_dedupe_two_key(source, f"{root}/claims", "a", "b", ["ord"], sink, f"{root}/cp", ["part"], 4)
            try:
                query.trigger(availableNow=True).start().awaitTermination()
            except Exception as e:  # noqa: BLE001
                assert "lost after" in str(e)
    assert not failing and len(written) == 4
    told = {i: r for batch in written.values() for i, r in batch.items()}
    assert {i for i, r in told.items() if r is None} == fold(batches) and len(told) == 160
    claims = BucketTable(spark, f"{root}/claims").read()
    assert claims.count() == claims.select("part", "kind", "key").distinct().count()


def plain_state(events):
    """The state of one application, by its events in order."""
    status, applied, stated, sent, mailed = "SAVED", None, "NOT_STARTED", None, False
    for _, us, kind, new in sorted(events):
        if kind == "STATUS_CHANGED":
            status = new
            applied = us if applied is None and new in ("APPLIED", "OUTREACH_SENT", "OFFER") else applied
            if new == "OUTREACH_SENT":
                mailed, sent = True, us if sent is None else sent
        else:
            stated = new
            if new == "NOT_STARTED":
                mailed, sent = False, None
            else:
                sent = us if sent is None else sent
    return status, "EMAIL_SENT" if stated == "NOT_STARTED" and mailed else stated, applied, sent


def test_application_state_with_late_events_and_resets(spark):
    rng, root = random.Random(8), shared_folder(spark, "state")
    schema = "application_id long, seq long, ts timestamp, event_type string, new_status string"
    events = []
    for seq in range(400):
        kind = rng.choice(["STATUS_CHANGED", "OUTREACH_CHANGED"])
        new = rng.choice(["SAVED", "APPLIED", "OUTREACH_SENT", "OFFER"] if kind[0] == "S" else ["NOT_STARTED", "EMAIL_SENT", "REPLIED"])
        events.append((seq % 7, seq, kind, new))
    rng.shuffle(events)  # resets come after what they undo and before
    for i in range(4):
        part = spark.createDataFrame([(a, s, k, n) for a, s, k, n in events[i * 100 : i * 100 + 100]], "application_id long, seq long, event_type string, new_status string")
        part.select("application_id", "seq", F.timestamp_micros(F.col("seq") * 1000).alias("ts"), "event_type", "new_status").coalesce(1).write.mode("append").parquet(f"{root}/in")
    got = {}

    def keep(df, batch_id):
        got.update({r.application_id: tuple(r)[1:5] for r in df.collect()})

    for _ in range(2):  # the second run finds nothing new and its state as it was
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        streams.stream_application_state(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    want = {a: plain_state([(s, s * 1000, k, n) for b, s, k, n in events if a == b]) for a in range(7)}
    assert got == want
    batch = tracker.application_state(spark.read.parquet(f"{root}/in").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert {r.application_id: (r.status, r.outreach_status) for r in batch.collect()} == {a: w[:2] for a, w in want.items()}


def test_what_a_batch_sent_is_kept_by_one_call():
    import pandas as pd

    class State:
        def __init__(self):
            self.calls, self.held = 0, None

        def exists(self):
            return self.held is not None

        def get(self):
            return iter(self.held) if isinstance(self.held, list) else self.held

        def update(self, value):
            self.held = value

        def put(self, rows):
            self.calls, self.held = self.calls + 1, list(rows)

        def appendList(self, rows):
            self.calls, self.held = self.calls + 1, [*(self.held or []), *rows]

        def clear(self):
            self.held = None

    class Handle:
        registers, sent = State(), State()

        def getValueState(self, *_):
            return self.registers

        def getListState(self, *_):
            return self.sent

    def batch(*events):
        columns = list(zip(*events, strict=True))
        return pd.DataFrame({"seq": columns[0], "event_type": columns[1], "new_status": columns[2], "ts_us": [s * 10 for s in columns[0]]})

    fold, handle = streams.ApplicationFold(), Handle()
    fold.init(handle)
    many = [(s, "OUTREACH_CHANGED", "REPLIED") for s in range(2, 52)]
    row = next(fold.handleInputRows((1,), iter([batch(*many), batch((60, "STATUS_CHANGED", "OUTREACH_SENT"))]), None)).iloc[0]
    assert handle.sent.calls == 1 and len(handle.sent.held) == 51 and (row.status, row.outreach_status, row.outreach_sent_us) == ("OUTREACH_SENT", "REPLIED", 20)
    row = next(fold.handleInputRows((1,), iter([batch((55, "OUTREACH_CHANGED", "NOT_STARTED"))]), None)).iloc[0]
    assert handle.sent.held == [(60, 600)] and (row.outreach_status, row.outreach_sent_us) == ("EMAIL_SENT", 600)
