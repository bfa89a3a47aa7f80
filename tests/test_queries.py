"""Registered queries against DuckDB on the smallest tables.

A sample by default; set POSTMILL_ALL_QUERIES=1 to compare every one.
"""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from harness.check import canon
from harness.views import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = """
canonicalize_url duplicate_key html_to_text parse_datetime read_adzuna ip_cidr_join failure_streak_stop dedupe_two_key
topk_relevant validate_postings upsert_contacts application_state application_record dashboard stream_ingest_upsert link_job_contacts append_log run_record verify_contacts landed_unreadable stream_dedupe_two_key near_duplicates_minhash application_history follow_ups_due recent_jobs search_history is_person_name target_boards
""".split()
NAMES = sorted(entry.queries()) if os.environ.get("POSTMILL_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_check(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    else:
        assert len(got) > 0


def test_upserts_of_one_address_found_twice_match_their_check(spark, tmp_path):
    """Postings 10k and 10k + 1 have one address: here both are one user's and new to the library."""
    con = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM '{SF}/{name}.parquet'"
        if name == "orders":
            rows = f"SELECT * REPLACE (o_custkey - o_custkey % 50 AS o_custkey, '3-MEDIUM' AS o_orderpriority) FROM '{SF}/orders.parquet' WHERE o_orderkey % 10 < 2"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(entry.oracle_sql()["upsert_jobs"]).df()
    assert len(want) < con.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert canon(entry.queries()["upsert_jobs"](spark, str(tmp_path)).toPandas()) == canon(want)


def test_application_list_finds_most_of_what_is_due(spark, duck):
    """The words it searches for stand in most of the sample titles."""
    name = "application_list"
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0 and canon(got) == canon(duck.execute(entry.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle_and_scans_are_pruned(spark):
    text = plan(entry.queries()["topk_relevant"](spark, SF))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "c_name" not in text and "o_totalprice" not in text
