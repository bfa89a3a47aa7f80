"""The bucketed table: what a merge rewrites, broken and repeated writes, two writers, vacuum."""

from __future__ import annotations

import datetime
import glob
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import buckets, store
from postmill.operators.buckets import BucketTable, Conflict
from postmill.session import shared_folder

SCHEMA = "k long, part string, v long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def put(stored, batch):
    return store.upsert(stored, batch, ["k", "part"], {})


def content(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def files(folder):
    return {f for f in glob.glob(f"{folder.removeprefix('file://')}/data/*/bucket=*/*.parquet")}


def new(spark, n=8):
    folder = shared_folder(spark, "buckets")
    return BucketTable.create(spark, folder, rows(spark, []).schema, ["k", "part"], n), folder


def test_one_key_rewrites_one_bucket(spark):
    table, folder = new(spark)
    assert table.read().count() == 0 and len(table.merge(rows(spark, [(i, "x", i) for i in range(200)]), put)) == 8
    before = files(folder)
    assert len(table.merge(rows(spark, [(7, "x", -7)]), put)) == 1
    added = files(folder) - before
    assert len(added) == 1 and len(table.folders) == 8
    assert content(table) == sorted([(i, "x", -7 if i == 7 else i) for i in range(200)], key=str)
    # the rewritten bucket alone was read for it
    bucket = table.merge(rows(spark, [(7, "x", 1)]), put)
    assert table.read(bucket).count() < 60
    assert BucketTable(spark, folder).version == 3


def test_random_merges_deletes_and_null_keys_equal_a_dictionary(spark):
    rng, (table, folder), want = random.Random(4), new(spark, 5), {}
    for _ in range(6):
        batch = {(rng.choice([None, *range(12)]), rng.choice([None, "a", "b"])): rng.randrange(99) for _ in range(9)}
        table.merge(rows(spark, [(*k, v) for k, v in batch.items()]), put)
        want |= batch
        gone = {k for k in want if rng.random() < 0.2}
        table.delete(rows(spark, [(*k, 0) for k in gone]))
        want = {k: v for k, v in want.items() if k not in gone}
        assert content(table) == sorted(((*k, v) for k, v in want.items()), key=str)
    table.rebucket(3)
    assert content(BucketTable(spark, folder)) == sorted(((*k, v) for k, v in want.items()), key=str) and set(table.folders) <= {0, 1, 2}
    table.merge(rows(spark, [(1, "z", 5)]), put)
    assert len(content(table)) == len(want) + 1


def test_a_broken_merge_changes_nothing_and_can_be_sent_again(spark, monkeypatch):
    table, folder = new(spark)
    table.merge(rows(spark, [(1, "a", 1), (2, "a", 2)]), put, ("feed", 0))
    monkeypatch.setattr(buckets.Files, "put_new", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.merge(rows(spark, [(1, "a", 9)]), put, ("feed", 1))
    monkeypatch.undo()
    table = BucketTable(spark, folder)
    assert content(table) == [(1, "a", 1), (2, "a", 2)] and table.marked("feed") == 0
    assert table.merge(rows(spark, [(1, "a", 9)]), put, ("feed", 1)) and table.marked("feed") == 1
    version = table.version
    assert table.merge(rows(spark, [(1, "a", 777)]), put, ("feed", 1)) == [] and table.version == version
    assert table.merge(rows(spark, [(1, "a", 778)]), put, ("feed", 0)) == [] and content(table)[0] == (1, "a", 9)
    assert table.merge(rows(spark, [(3, "a", 3)]), put, ("other", 0)) and content(table) == [(1, "a", 9), (2, "a", 2), (3, "a", 3)]
    # the broken write is only a folder that nothing names
    assert len(table.vacuum(older_than=0)) >= 1 and content(table) == [(1, "a", 9), (2, "a", 2), (3, "a", 3)]


def test_two_writers_lose_nothing(spark):
    one, folder = new(spark)
    two = BucketTable(spark, folder)
    one.merge(rows(spark, [(1, "a", 1)]), put)
    two.merge(rows(spark, [(1, "b", 2), (9, "c", 3)]), put)  # opened before one's version, done again on it
    assert content(one.refresh()) == [(1, "a", 1), (1, "b", 2), (9, "c", 3)]
    with pytest.raises(Conflict):
        one.version -= 1
        one._commit([], one.read([]), None)
    with pytest.raises(ValueError, match="keys"):
        two.merge(rows(spark, [(1, "a", 1)]), lambda old, batch: rows(spark, [(i, "q", 0) for i in range(40)]))
    assert len(content(two.refresh())) == 3


def test_vacuum_keeps_what_versions_name(spark):
    table, folder = new(spark)
    for i in range(4):
        table.merge(rows(spark, [(k, "x", i) for k in range(3)]), put)
    old = BucketTable(spark, folder)
    removed = table.vacuum(keep=2)
    assert len(removed) == 2 and content(table) == [(k, "x", 3) for k in range(3)]
    table.merge(rows(spark, [(50, "x", 9)]), put)
    assert content(old) == [(k, "x", 3) for k in range(3)]  # a reader keeps its version
    assert len({f.split("/data/")[1].split("/")[0] for f in files(folder)}) == 3


def test_library_merges_equal_whole_table_upserts(spark):
    now = F.lit(datetime.datetime(2024, 5, 1)).cast("timestamp_ntz")
    schema = "user_id long, canonical_url string, job_url string, title string, is_saved boolean, ord int"
    some = spark.createDataFrame([(i % 3, f"u{i % 7}", f"j{i}", f"t{i}", False, i) for i in range(40)] + [(None, None, "j", "t", False, 1)], schema)
    old = store.upsert_jobs(some.drop("ord").limit(0), some.filter("ord < 9"), now).withColumn("is_saved", F.lit(True))
    table = BucketTable.create(spark, shared_folder(spark, "jobs"), old.schema, store.JOB_KEYS, 4)
    table.merge(old, lambda _, b: b)
    store.merge_jobs(table, some, now)
    assert content(table) == sorted(map(tuple, store.upsert_jobs(old, some, now).collect()), key=str)

    firms = spark.createDataFrame([("Acme Inc.", None, "c1", 1), ("ACME", "a.example", None, 2), ("Nova", None, None, 3)], "name string, domain string, careers_url string, ord int")
    none = firms.select(F.lit("x").alias("normalized_name"), "name", "domain", "careers_url").limit(0)
    table = BucketTable.create(spark, shared_folder(spark, "firms"), none.schema, store.COMPANY_KEYS, 4)
    for _ in range(2):
        store.merge_companies(table, firms)
    assert content(table) == sorted(map(tuple, store.upsert_companies(none, firms).collect()), key=str)
    links = spark.createDataFrame([(1, 2, 3), (1, 2, 1), (4, 5, 9)], "job_id long, contact_id long, rank int")
    table = BucketTable.create(spark, shared_folder(spark, "links"), links.withColumn("relevance", F.lit(0.1)).schema, store.LINK_KEYS, 4)
    store.merge_links(table, links)
    store.merge_links(table, links.withColumn("rank", F.lit(0)))
    assert content(table) == [(1, 2, 0, 0.85), (4, 5, 0, 0.0)]


def test_appended_rows_cost_no_rewrite_and_are_compacted(spark):
    table, folder = new(spark, 3)
    for i in range(5):
        before = files(folder)
        table.append(rows(spark, [(10 * i + j, "x", i) for j in range(10)]), ("feed", i), most=9)
        assert before <= files(folder)
    assert table.append(rows(spark, [(0, "x", 0)]), ("feed", 4)) == []
    assert content(table) == sorted(((10 * i + j, "x", i) for i in range(5) for j in range(10)), key=str)
    assert max(map(len, table.folders.values())) == 5
    assert len(table.compact()) == 3 and max(map(len, table.folders.values())) == 1 and len(content(table)) == 50
    table.merge(rows(spark, [(3, "x", 99)]), put)
    assert (3, "x", 99) in content(table) and len(content(table)) == 50
    assert table.vacuum() and len(content(table)) == 50
