"""Rows without a key, long chains, replays and restarts."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from postmill.operators import dedupe, store, tracker
from postmill.operators.buckets import BucketTable
from postmill.plans import skew
from postmill.session import checkpoint, shared_folder
from postmill.streaming import streams


def test_two_key_dedupe_ends_without_keys(spark):
    rows = [(1, None, "x"), (2, None, "y"), (3, None, None), (4, None, None), (5, "a", "x"), (6, "a", None), (7, "b", "z")]
    df = spark.createDataFrame(rows, "ord int, a string, b string")
    out = {r.ord: r.drop_reason for r in dedupe.dedupe_two_key(df, "a", "b", ["ord"]).collect()}
    assert out == {1: None, 2: None, 3: None, 4: None, 5: "duplicate", 6: None, 7: None}
    assert dedupe.dedupe_two_key(df, "a", "b", ["ord"]).columns == ["ord", "a", "b", "drop_reason"]


def test_marks_and_running_values_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("k", 3, 7)], "k string, i int, v int")
    assert {(r.k, r.i, r.first) for r in skew.mark_first(df, ["k"], ["i"], "first").collect()} == {(None, 1, True), (None, 2, False), ("k", 3, True)}
    told = skew.running(skew.ordered_chunks(df, ["k"], ["i"], 3), ["k"], ["i"], {"s": ("sum", F.col("v"))})
    assert {(r.k, r.i, r.s) for r in told.collect()} == {(None, 1, 5), (None, 2, 11), ("k", 3, 7)}


def test_upsert_again_adds_nothing(spark):
    new = spark.createDataFrame([(1, None, "t"), (1, "u", "t"), (None, "u", "t")], "user_id int, canonical_url string, title string")
    once = store.upsert(new.limit(0), new, ["user_id", "canonical_url"], {})
    assert store.upsert(once, new, ["user_id", "canonical_url"], {}).count() == once.count() == 3


def test_history_carries_implied_outreach(spark):
    events = [(1, 1, "STATUS_CHANGED", "OUTREACH_SENT"), (1, 2, "OUTREACH_CHANGED", "REPLIED"), (1, 3, "OUTREACH_CHANGED", "NOT_STARTED"), (1, 4, "OUTREACH_CHANGED", "LINKEDIN_SENT"), (1, 5, "STATUS_CHANGED", "OFFER")]
    df = spark.createDataFrame(events, "application_id int, seq int, event_type string, new_status string")
    told = [r.detail.split(" → ") for r in tracker.application_history(df).orderBy("seq").collect()]
    assert [a for a, _ in told] == ["Saved", "Email sent", told[1][1], "Not started", told[0][1]]


def test_deleting_an_application_clears_the_flag(spark):
    jobs = spark.createDataFrame([(1, 10, True), (1, 11, True), (2, 10, False)], "user_id int, job_id int, is_saved boolean")
    gone = spark.createDataFrame([(1, 10, 5)], "user_id int, job_id int, application_id int")
    assert {(r.user_id, r.job_id, r.is_saved) for r in store.unsave_deleted(jobs, gone).collect()} == {(1, 10, False), (1, 11, True), (2, 10, False)}


def library(spark, path):
    return {r.canonical_url: r.title for r in BucketTable(spark, path).read().collect()}


def test_stream_ingest_survives_restart_replay_and_a_seeded_library(spark):
    root = shared_folder(spark, "ingest")
    landing, jobs = f"{root}/in", f"{root}/jobs"
    schema = "user_id int, canonical_url string, title string, ord int, is_saved boolean"
    seed = spark.createDataFrame([(1, "seed", "s", False)], "user_id int, canonical_url string, title string, is_saved boolean")
    store.merge_jobs(BucketTable.create(spark, jobs, seed.schema, store.JOB_KEYS, 4), seed.withColumn("ord", F.lit(0)), F.lit(None).cast("timestamp"))
    now = F.lit(datetime.datetime(2024, 1, 1))

    def run(rows, cp):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        streams.stream_ingest_upsert(stream, jobs, now, cp).trigger(availableNow=True).start().awaitTermination()
        return library(spark, jobs)

    assert run([(1, "a", "1", 1, False), (1, "b", "1", 2, False)], f"{root}/cp1") == {"seed": "s", "a": "1", "b": "1"}
    assert run([(1, "c", "1", 3, False)], f"{root}/cp1") == {"seed": "s", "a": "1", "b": "1", "c": "1"}
    # a new checkpoint folder reads everything again and keeps what is there
    assert run([(1, "d", "1", 4, False)], f"{root}/cp2") == {"seed": "s", "a": "1", "b": "1", "c": "1", "d": "1"}


def greedy(rows):
    a, b, kept = set(), set(), set()
    for i, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            kept.add(i)
    return kept


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    # row i shares a key with row i - 1 and another with row i + 1
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(1000)]
    calls = []
    monkeypatch.setattr(dedupe, "checkpoint", lambda df: calls.append(1) or checkpoint(df))
    out = dedupe.dedupe_two_key(spark.createDataFrame(chain, "ord int, a string, b string"), "a", "b", ["ord"])
    assert {r.ord for r in out.filter("drop_reason IS NULL").collect()} == greedy(chain) == set(range(0, 1000, 2))
    assert len(calls) <= 4 + 12  # one round, and a doubling step for each power of two


def test_random_key_graphs_with_parts_equal_the_fold(spark):
    rng = random.Random(12)
    rows = [(i, f"a{rng.randrange(18)}", f"b{rng.randrange(18)}", rng.choice([None, "x", "y"])) for i in range(150)]
    rows += [(1000 + i, f"c{(i + 1) // 2}", f"d{i // 2}", "x") for i in range(60)]
    rng.shuffle(rows)
    out = dedupe.dedupe_two_key(spark.createDataFrame(rows, "ord int, a string, b string, part string"), "a", "b", ["ord"], ["part"])
    want = set().union(*(greedy([r[:3] for r in rows if r[3] == p]) for p in (None, "x", "y")))
    assert {r.ord for r in out.filter("drop_reason IS NULL").collect()} == want and out.count() == len(rows)


def test_keys_of_all_rows_are_not_formed_again_for_the_reasons(spark):
    rows = [(0, "a", "x"), (1, "a", "y"), (2, "b", "y"), (3, None, None)]
    out = dedupe.dedupe_two_key(spark.createDataFrame(rows, "ord int, a string, b string"), "a", "b", ["ord"]).select("ord", "drop_reason")
    assert {r.ord for r in out.collect() if r.drop_reason is None} == {0, 2, 3}
    assert "concat(" not in out._jdf.queryExecution().optimizedPlan().toString()
