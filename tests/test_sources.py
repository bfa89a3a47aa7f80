"""Landed payloads of each source, in the shape the source sends them."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from harness.queries_sources import landed_root
from postmill.sources import intake, landed, payloads

GREENHOUSE = {
    "jobs": [
        {"id": 81, "title": "Pricing Analyst", "absolute_url": "http://h/jobs/81", "location": {"name": "Porto, Portugal"},
         "first_published": "2025-03-04T10:30:00Z", "content": "<p>Set our prices.</p>", "departments": [{"name": "Revenue"}]},
        {"id": 82, "title": "Open Call", "absolute_url": "http://h/jobs/82", "location": {"name": "Anywhere"}, "content": "<p>Say hello.</p>"},
        "junk",
    ]
}
LEVER = [{"id": "q7-b", "text": "Claims Handler", "hostedUrl": "http://h/lever/q7-b", "createdAt": 1741000000000,
          "categories": {"location": "Leeds", "team": "Claims", "commitment": "Full-time"}, "descriptionPlain": "Letters."}]
MUSE = {"results": [{"id": 310, "name": "Kitchen Planner", "contents": "<p>Draw rooms for our customers.</p>", "company": {"name": "Larch Interiors"},
                     "locations": [{"name": "Porto, Portugal"}], "levels": [{"name": "Entry Level"}], "refs": {"landing_page": "http://h/jobs/310"}}]}
USA = {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {
    "PositionID": "R-55", "PositionTitle": "Forest Warden", "PositionURI": "http://h/r-55", "ApplyURI": ["http://h/r-55/apply"], "OrganizationName": "Land Office",
    "PositionLocation": [{"LocationName": "Boise, ID"}], "PositionSchedule": [{"Name": "Full-Time"}], "UserArea": {"Details": {"JobSummary": "Walk the woods."}}}}]}}


@pytest.fixture
def land(spark, tmp_path):
    def write(name, body, **kwargs):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps(body), encoding="utf-8")
        return payloads.read_source(spark, name, str(folder), **kwargs).orderBy("item_ord").collect()

    return write


def test_greenhouse(land):
    rows = land("greenhouse", GREENHOUSE, company="Demo", token="demo")
    assert [(r.title, r.company_name, r.location, r.is_remote, r.department) for r in rows] == [
        ("Pricing Analyst", "Demo", "Porto, Portugal", False, "Revenue"), ("Open Call", "Demo", "Anywhere", True, None),
    ]
    assert rows[0].payload == {"board": "demo", "platform": "greenhouse"} and rows[1].posted_at is None
    assert rows[0].description == "Set our prices." and rows[0].external_id == "81"


def test_lever(land):
    row = land("lever", LEVER, company="Demo", token="demo")[0]
    assert (row.title, row.location, row.employment_type, row.department, row.posted_at.year) == ("Claims Handler", "Leeds", "Full-time", "Claims", 2025)


def test_muse(land):
    row = land("themuse", MUSE)[0]
    assert (row.company_name, row.location, row.source) == ("Larch Interiors", "Porto, Portugal", "THE_MUSE") and "rooms" in row.description


def test_usajobs(land):
    row = land("usajobs", USA)[0]
    assert (row.company_name, row.apply_url, row.employment_type, row.description) == ("Land Office", "http://h/r-55/apply", "Full-Time", "Walk the woods.")


def test_broken_bodies_give_no_rows(land):
    assert land("remotive", {"jobs": "none"}) == [] and land("arbeitnow", [1, 2]) == []


def test_folders_of_many_boards_in_one_call(spark, tmp_path):
    for token in ("firco", "oakhaus"):
        (tmp_path / "in" / token).mkdir(parents=True)
        (tmp_path / "in" / token / "a.json").write_text(json.dumps(GREENHOUSE), encoding="utf-8")
    (tmp_path / "in" / "firco" / "b.json").write_text("{not json", encoding="utf-8")
    (tmp_path / "in" / "firco" / "c.json").write_text('{"jobs": 5}', encoding="utf-8")
    boards = spark.createDataFrame([("firco", "Fir & Co"), ("other", "Other")], "token string, company string")
    rows = payloads.read_source(spark, "greenhouse", f"{tmp_path}/in/*", boards=boards).collect()
    assert sorted((r.company_name, r.payload["board"]) for r in rows) == [("Fir & Co", "firco")] * 2 + [("oakhaus", "oakhaus")] * 2
    bad = payloads.unreadable(payloads.read_payloads(spark, f"{tmp_path}/in/*", boards=boards), "$.jobs").collect()
    assert sorted((r.query_url[-12:-7], r.reason, r.n) for r in bad) == [("firco", "body", 1), ("firco", "item", 1), ("firco", "list", 1), ("khaus", "item", 1)]


def test_seed_boards_skip_bad_rows(spark, tmp_path):
    boards = {"boards": [{"company": "Fir & Co", "platform": "Greenhouse", "token": "firco"}, {"platform": "lever", "token": "oakhaus"}, {"platform": "x", "token": "y"},
                         {"platform": "ashby", "token": " "}, 7]}
    (tmp_path / "b.json").write_text(json.dumps(boards), encoding="utf-8")
    rows = intake.seed_boards(spark, str(tmp_path / "b.json")).orderBy("seed_ord").collect()
    assert [(r.platform, r.token, r.company) for r in rows] == [("greenhouse", "firco", "Fir & Co"), ("lever", "oakhaus", "oakhaus")]


def test_board_tokens(one):
    got = one(intake.candidate_tokens, ["Birchline Software Private Limited", "The Elm", "", None, "X"])
    assert got == [["birchline"], ["theelm", "the-elm", "the"], [], [], []]


def test_known_boards(spark):
    firms = spark.createDataFrame([("acme", "https://boards.greenhouse.io/acme/"), ("none", "https://acme.example/jobs")], "normalized_name string, careers_url string")
    assert [tuple(r) for r in intake.known_boards(firms).collect()] == [("acme", "greenhouse", "acme")]


def test_incomplete_rows_are_counted(spark):
    raw = spark.createDataFrame([("A", " T  x ", "C", "u "), ("A", "", "C", "u"), ("B", "T", None, "u")], "source string, title string, company_name string, url string")
    kept, dropped = intake.clean_raw_jobs(raw)
    assert [tuple(r) for r in kept.collect()] == [("A", "T x", "C", "u")]
    assert {r.source: r.dropped for r in dropped.collect()} == {"A": 1, "B": 1}
    assert kept.filter(F.col("title") == "T x").count() == 1


def test_landed_folders_as_a_stream_and_as_a_table(spark, tmp_path):
    root, seen = tmp_path / "in", []

    def land(source, token, name, body):
        folder = root / f"source={source}" / f"token={token}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(body)

    def sink(postings, bad, batch_id):
        seen.append((sorted((r.source, r.company_name, r.title) for r in postings.collect()), sorted((r.source, r.reason, r.n) for r in bad.collect())))

    def run():
        landed.stream_landed(spark, str(root), sink, str(tmp_path / "cp"), boards).trigger(availableNow=True).start().awaitTermination()

    boards = spark.createDataFrame([("acme", "Acme Works")], "token string, company string")
    land("greenhouse", "acme", "1.json", '{"jobs": [{"title": "Miller"}, {"title": "Baker"}, 5]}')
    land("lever", "007", "1.json", '[{"text": "Tiler"}]')
    land("nobody", "x", "1.json", "{}")
    run()
    land("greenhouse", "acme", "2.json", '{"jobs": [{"title": "Cooper"}]}')
    land("arbeitnow", "a", "1.json", "broken")
    run()
    run()
    first = [("GREENHOUSE", "Acme Works", "Baker"), ("GREENHOUSE", "Acme Works", "Miller"), ("LEVER", "007", "Tiler")]
    assert seen == [(first, [("greenhouse", "item", 1), ("nobody", "source", 1)]), ([("GREENHOUSE", "Acme Works", "Cooper")], [("arbeitnow", "body", 1)])]
    table = landed.landed_payloads(spark, str(root), boards)
    assert {r.title for r in landed.landed_postings(table).collect()} == {"Miller", "Baker", "Tiler", "Cooper"}
    # a source of one's own, and one that lacks its settings
    own = landed.SourceSpec("nobody", "$.rows", lambda p: payloads.READERS["lever"](p.withColumn("body", F.lit('[{"text": "Own"}]'))), needs=("key",))
    landed.register_source(own)
    try:
        assert "Own" in {r.title for r in landed.landed_postings(table).collect()}
        assert "Own" not in {r.title for r in landed.landed_postings(table, settings=[]).collect()} and own.missing(["key"]) == []
    finally:
        del landed.SPECS["nobody"]


def test_lines_of_a_landed_file_are_responses(spark, tmp_path):
    folder = tmp_path / "source=lever" / "token=acme"
    folder.mkdir(parents=True)
    (folder / "may.jsonl").write_text('[{"text": "Miller"}]\nnot json\n[{"text": "Baker"}, 7]\n')
    table = landed.landed_payloads(spark, str(tmp_path), lines=True)
    assert {(r.title, r.company_name) for r in landed.landed_postings(table).collect()} == {("Miller", "acme"), ("Baker", "acme")}
    assert sorted((r.reason, r.n) for r in landed.landed_unreadable(table).collect()) == [("body", 1), ("item", 1)]


def test_sample_responses_share_files(spark):
    root = Path(urlparse(landed_root(spark, "/root/testdata/sf0.01")).path)
    files = [f for f in root.rglob("*") if f.is_file() and f.name[0] not in "._"]
    responses = sum(len(f.read_text().splitlines()) for f in files)
    assert responses > 300 and len(files) < 130


def test_a_body_is_parsed_once_for_what_is_passed_over(spark):
    rows = [('[{"a": 1}, {}, 7, "{", [1], null]',), ("{}",), ("nope",), (None,), ("[]",), ('[{"a": [2]}]',)]
    told = payloads.unreadable(spark.createDataFrame(rows, "body string").withColumn("query_url", F.col("body")), "$")
    assert sorted((str(r.query_url), r.reason, r.n) for r in told.collect()) == [
        ("None", "body", 1), (rows[0][0], "item", 4), ("nope", "body", 1), ("{}", "list", 1),
    ]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and "schema_of_variant" not in plan.lower()
