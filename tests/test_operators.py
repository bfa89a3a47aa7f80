"""Operators against brute force and against facts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from postmill.operators import contacts as con
from postmill.operators import dedupe, frontier, relevance, store, tracker, validation
from postmill.operators.request_log import structure_request_log
from postmill.plans import search, skew
from postmill.session import checkpoint

def as_of():
    return F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")


# --- dedupe ------------------------------------------------------------------------------


def greedy(rows):
    seen_a, seen_b, kept = set(), set(), set()
    for i, a, b in sorted(rows):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            kept.add(i)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_two_key_dedupe_equals_the_sequential_result(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"a{rng.randrange(25)}", f"b{rng.randrange(25)}") for i in range(80)]
    # A third of the rows share one key, and many are exact copies.
    rows += [(100 + i, "hot", f"b{rng.randrange(6)}") for i in range(40)]
    out = dedupe.dedupe_two_key(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", ["i"])
    assert {r.i for r in out.filter("drop_reason IS NULL").collect()} == greedy(rows)
    assert out.count() == len(rows)


def test_two_key_dedupe_follows_a_chain(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(9)]
    out = dedupe.dedupe_two_key(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", ["i"])
    assert {r.i for r in out.filter("drop_reason IS NULL").collect()} == greedy(rows)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [rng.sample(words, rng.randint(3, 8)) for _ in range(40)]
    texts += [[*t[:-1], "other"] for t in texts[:10]] + texts[:5] * 3
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: frozenset(t) for i, t in enumerate(texts)}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(first[sets[i]], i) for i in sets if first[sets[i]] != i}
    reps = sorted(first.values())
    for x in reps:
        for y in reps:
            if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.6:
                want.add((x, y))
    out = dedupe.near_duplicate_pairs(spark.createDataFrame(rows, "i int, t string"), "i", "t", 0.6).collect()
    assert {(r.id_a, r.id_b) for r in out} == want


# --- balanced plans ------------------------------------------------------------------------


def test_running_aggregates_equal_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    chunks = skew.ordered_chunks(df, ["k"], ["i"], chunks=7)
    got = skew.running(
        chunks, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "p": ("previous", F.col("v"))}
    )
    w = Window.partitionBy("k").orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(up), "m": F.max("v").over(up), "p": F.lag("v").over(w)})
    columns = ["k", "i", "v", "s", "m", "p"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert chunks.filter("k = 'hot'").select(skew.CHUNK).distinct().count() > 1


# --- crawl planning ------------------------------------------------------------------------


def test_politeness_equals_the_sequential_schedule(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "b"]), rng.randrange(60)) for i in range(120)]
    want, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = max(t, last.get(k, -(10**9)) + 2)
        last[k] = want[i]
    df = spark.createDataFrame(rows, "i int, k string, t int").withColumn("ts", F.timestamp_seconds("t"))
    out = frontier.politeness_schedule(df, "k", "ts", 2.0, "i").collect()
    assert {r.i: r.start_us // 1_000_000 for r in out} == want


REJECTED = [
    "http://127.8.9.1/x",
    "http://[::1]:8080/",
    "http://10.20.30.40/",
    "http://172.20.0.9/panel",
    "http://192.168.77.3/",
    "http://100.100.1.1/",
    "http://169.254.7.7/role",
    "http://0.0.0.0/",
    "http://[fd12::1]/",
    "http://[2001:db8::7]/",
    "http://localhost/status",
    "http://build.internal/",
    "http://nas.local/",
    "http://metadata.google.internal/",
    "ftp://example.com/a",
    "file:///srv/a",
    "mailto:a@example.com",
    "http://me:pw@example.com/",
    "http://example.com:22/",
    "http://example.com:70000/",
    "http://evil.example/a",
    "http://nobody-knows.example/",
    "http://",
    "words only",
]


def test_url_guard(spark):
    bad = REJECTED + ["", "  ", "https://" + "a" * 2100]
    good = ["https://example.com/careers", "http://8.8.8.8:8080/x", "http://[2600:1f00::1]/"]
    dns = spark.createDataFrame(
        [("example.com", "93.184.216.34"), ("evil.example", "93.184.216.34"), ("evil.example", "169.254.169.254")], "host string, ip string"
    )
    urls = spark.createDataFrame([(u,) for u in bad + good], "url string")
    out = {r.url: r.reject_reason for r in frontier.url_guard(urls, dns, frontier.network_table(spark)).collect()}
    assert [u for u in bad if out[u] is None] == []
    assert [out[u] for u in good] == [None] * 3


# --- relevance -----------------------------------------------------------------------------


def stored(requests):
    """Requests are structured once and stored; searches read the stored rows."""
    return checkpoint(structure_request_log(requests))


def test_title_candidates_include_substrings(spark):
    requests = relevance.prepare_requests(
        stored(spark.createDataFrame([(1, "developer"), (2, "qc")], "query_id bigint, raw string"))
    )
    jobs = spark.createDataFrame([("Senior Developers",), ("Sqcale",), ("Welder",), ("Data Analyst",)], "title string")
    jobs = jobs.withColumn("title_norm", F.lower("title"))
    out = {(r.query_id, r.title_norm, r.title_match.score) for r in relevance.title_matches(requests, jobs).collect()}
    assert out == {(1, "senior developers", 0.9), (2, "sqcale", 0.9)}


# --- checking ------------------------------------------------------------------------------

LIVE = '<script type="application/ld+json">{"@type":"JobPosting","validThrough":"%s","hiringOrganization":{"name":"%s"}}</script><h1>Backend Engineer</h1>'


def test_validation_states(spark):
    rows = [
        ("live", 200, None, LIVE % ("2101-05-06T00:00:00Z", "Larch Interiors"), "THE_MUSE", "VALID"),
        ("closed", 200, None, "<p>Thank you all: we are no longer accepting applications.</p>", "THE_MUSE", "EXPIRED"),
        ("expired", 200, None, LIVE % ("2019-02-03T00:00:00Z", "Larch Interiors"), "THE_MUSE", "EXPIRED"),
        ("wrong", 200, None, LIVE % ("2101-05-06", "Quarry Stoneworks"), "THE_MUSE", "MISMATCH"),
        ("gone", 404, None, "", "THE_MUSE", "BROKEN"), ("odd", 302, None, "", "THE_MUSE", "UNVERIFIED"),
        ("robots", None, "robots_disallowed", None, "THE_MUSE", "UNVERIFIED"), ("refused", 403, None, "", "THE_MUSE", "UNVERIFIED"),
        ("own", 403, None, "", "GREENHOUSE", "LIKELY_VALID"),
        ("list", 200, None, "<h1>Backend Engineer</h1> Larch Interiors. Browse jobs", "THE_MUSE", "LIKELY_VALID"),
        ("bare", 200, None, "<p>Hello</p>", "LEVER", "VALID"),
    ]
    log = spark.createDataFrame(
        [(f"https://x.example/{u}", f"https://x.example/{u}", s, h, b, None) for u, s, b, h, _, _ in rows],
        "url string, final_url string, status int, html string, blocked_reason string, error string",
    )
    posts = spark.createDataFrame(
        [(f"https://x.example/{r[0]}", "Backend Engineer", "Larch Interiors", r[4], r[5]) for r in rows]
        + [("https://x.example/none", "Backend Engineer", "Larch Interiors", "LEVER", "UNVERIFIED")],
        "url string, title string, company_name string, source string, want string",
    )
    out = validation.validate_postings(posts, log, as_of()).collect()
    assert [(r.url, r.status) for r in out if r.status != r.want] == [] and len(out) == len(rows) + 1
    reasons = {r.url.rsplit("/", 1)[1]: r.reason for r in out}
    assert "no longer accepting applications" in reasons["closed"] and "Quarry Stoneworks" in reasons["wrong"]
    assert "own job board API" in reasons["own"] and "declined" in reasons["robots"] and "03 Feb 2019" in reasons["expired"]


# --- contacts ------------------------------------------------------------------------------

TEAM = """<html><head><script type="application/ld+json">{"@type":"Person","name":"Ines Alder","jobTitle":"Talent Acquisition Partner, Product",
 "email":"ines.alder@larch.example","url":"http://h/team/ines-alder"}</script></head><body><h2>Hiring team</h2>
 <div><p>Olaf Birk</p><p>Technical Recruiter</p><a href="mailto:olaf.birk@larch.example">Email Olaf Birk</a></div>
 <div><a href="mailto:careers@larch.example">careers@larch.example</a></div>
 <div><a href="mailto:someone@gmail.com">My own post</a></div></body></html>"""


def discovered(spark, domain, description=None):
    firm = spark.createDataFrame(
        [("larch interiors", "Larch Interiors", domain, "https://h.example/team", "recruiter")],
        "company_key string, company_name string, company_domain string, careers_url string, role_hint string",
    )
    pages = spark.createDataFrame([("https://h.example/team", None, 200, TEAM)], "url string, final_url string, status int, html string")
    posts = spark.createDataFrame([("larch interiors", "https://h.example/1", description)], "company_key string, posting_url string, description string")
    return sorted(con.discover_contacts(firm, posts, pages).collect(), key=lambda r: r.contact_rank)


def test_contacts_of_a_team_page(spark):
    found = discovered(spark, None)
    assert [(r.role, r.name, r.email) for r in found] == [
        ("FUNCTION_RECRUITER", "Olaf Birk", "olaf.birk@larch.example"),
        ("TALENT_ACQUISITION", "Ines Alder", "ines.alder@larch.example"),
        # Three capitalised words read as a name; the rule is the same for link texts.
        ("TALENT_ACQUISITION", "Email Olaf Birk", "olaf.birk@larch.example"),
        ("TALENT_ALIAS", None, "careers@larch.example"), ("SEARCH_LINK", None, None),
    ]
    assert found[0].email_status == found[1].email_status == "PUBLISHED_ATTRIBUTED"
    assert all(r.source_url for r in found[:4]) and found[4].search_url.startswith("https://www.linkedin.com/")


def test_foreign_addresses_are_not_taken(spark):
    found = discovered(spark, "somewhere-else.example", "Write to jobs@somewhere-else.example or x@gmail.com.")
    assert {r.email for r in found} == {None, "jobs@somewhere-else.example"}


# --- tracker and store -----------------------------------------------------------------------


def test_application_fold(spark):
    events = [
        (1, 1, "STATUS_CHANGED", "APPLIED"), (1, 2, "STATUS_CHANGED", "INTERVIEW"),
        (2, 3, "STATUS_CHANGED", "OUTREACH_SENT"), (3, 4, "OUTREACH_CHANGED", "EMAIL_SENT"), (3, 5, "OUTREACH_CHANGED", "NOT_STARTED"),
        (4, 6, "OUTREACH_CHANGED", "NOT_STARTED"), (4, 7, "STATUS_CHANGED", "OUTREACH_SENT"), (4, 8, "OUTREACH_CHANGED", "REPLIED"),
    ]
    df = spark.createDataFrame(events, "application_id bigint, seq bigint, event_type string, new_status string")
    df = df.withColumn("ts", F.timestamp_seconds("seq"))
    out = {r.application_id: r for r in tracker.application_state(df).collect()}
    seconds = lambda t: None if t is None else int(t.timestamp())
    assert (out[1].status, out[1].outreach_status, seconds(out[1].date_applied)) == ("INTERVIEW", "NOT_STARTED", 1)
    assert (out[2].outreach_status, seconds(out[2].outreach_sent_at)) == ("EMAIL_SENT", 3)
    assert (out[3].outreach_status, out[3].outreach_sent_at, out[3].status) == ("NOT_STARTED", None, "SAVED")
    assert (out[4].outreach_status, seconds(out[4].outreach_sent_at)) == ("REPLIED", 7)


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    assert store.latest_version(spark, folder) is None
    store.write_version(spark.range(3).toDF("x"), folder, 1)
    store.write_version(spark.range(5).toDF("x"), folder, 2)
    assert store.latest_version(spark, folder) == 2
    store.append_log(spark.createDataFrame([("x" * 400,)], "label string"), str(tmp_path / "log"), "request")
    assert len(spark.read.parquet(str(tmp_path / "log")).first().label) == 400


# --- the whole search ------------------------------------------------------------------------


def test_run_records_list_each_source_error_and_note_once(spark):
    log = [(1, "A", i % 3, f"e{i % 60}" if i % 2 else None, None, f"n{i}") for i in range(300)] + [(1, "B", 9, None, "no key", None), (2, "A", 0, None, None, None)]
    log = spark.createDataFrame(log, "query_id int, source string, ord int, error string, skip_reason string, note string")
    funnels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 0)], "query_id int, validated int, unverified int")
    users = spark.createDataFrame([(i, 7) for i in (1, 2, 3)], "query_id int, user_id int")
    runs = {r.query_id: r for r in tracker.run_rows(tracker.run_status(funnels, log), users, log, as_of()).collect()}
    assert (runs[1].run_status, runs[1].sources_queried, runs[1].sources_skipped) == ("FAILED", ["A"], ["B"])
    assert len(runs[1].errors) == len(set(runs[1].errors)) == 30 and len(runs[1].notes) == tracker.MOST_NOTES
    assert (runs[2].run_status, runs[3].run_status, runs[3].errors, runs[3].sources_queried) == ("SUCCESS", "SUCCESS", [], [])


def test_search_adds_up_and_repeats_cleanly(spark):
    posts = [
        (1, 0, 0, "Backend Engineer", "Larch Interiors", "https://h.example/1?utm_source=a", "GREENHOUSE", "Pune", "3-5 years"),
        (1, 1, 0, "Backend Engineer", "Larch Interiors", "https://h.example/1", "ADZUNA", "Pune, India", "3-5 years"),
        (1, 1, 1, "Welder", "Larch Interiors", "https://h.example/2", "ADZUNA", "Pune", ""),
        (1, 1, 2, "Backend Engineer II", "Other Corp", "https://h.example/3", "ADZUNA", "Chennai", "4 years"),
        (1, 1, 3, "", "Other Corp", "https://h.example/4", "ADZUNA", "Chennai", ""),
    ]
    raw = spark.createDataFrame(
        posts,
        "query_id bigint, provider_ord int, item_ord int, title string, company_name string, url string, source string, location string, description string",
    ).withColumns(
        {
            "is_remote": F.lit(False), "posted_at": as_of(), "source_query_url": F.lit("https://feed.example"),
            "payload": F.create_map(F.lit("board"), F.lit("demo"), F.lit("platform"), F.lit("greenhouse")),
        }
    )
    log = spark.createDataFrame(
        [("https://h.example/1?utm_source=a", "https://h.example/1", 200, LIVE % ("2101-05-06", "Larch Interiors")), ("https://h.example/3", "https://h.example/3", 404, "")],
        "url string, final_url string, status int, html string",
    ).withColumns({"blocked_reason": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    pages = spark.createDataFrame([("https://boards.greenhouse.io/demo", None, 200, TEAM)], "url string, final_url string, status int, html string")
    text = "Find Backend Engineer roles for 3-5 years of experience in Pune and Chennai."
    asked = stored(spark.createDataFrame([(1, text)], "query_id bigint, raw string")).withColumn("user_id", F.lit(5).cast("bigint"))
    first = search.run_search(asked, raw, log, pages, search.empty_stores(spark), as_of())
    assert {(r.source, r.rows, r.incomplete) for r in first["intake"].collect()} == {("GREENHOUSE", 1, 0), ("ADZUNA", 4, 1)}
    row = first["funnel"].first()
    assert row.incomplete_dropped == 1
    assert (row.raw_found, row.duplicates_dropped, row.irrelevant_dropped, row.validated, row.rejected) == (4, 1, 1, 1, 1)
    assert row.contacts_found == 2
    jobs = first["jobs"].collect()
    assert [(j.user_id, j.canonical_url, j.validation_status) for j in jobs] == [(5, "https://h.example/1", "VALID")]
    assert (jobs[0].board_token, jobs[0].source_query_url, jobs[0].payload["platform"], jobs[0].external_id) == ("demo", "https://feed.example", "greenhouse", None)
    assert first["companies"].first().careers_url == "https://boards.greenhouse.io/demo"
    assert first["job_contacts"].count() == first["contacts"].count() == 3

    again = search.run_search(asked, raw, log, pages, {k: first[k] for k in search.STORE_SCHEMAS}, as_of())
    for name in search.STORE_SCHEMAS:
        assert again[name].count() == first[name].count(), name


def test_page_text_is_read_only_where_it_is_asked_for(spark):
    record = '<script type="application/ld+json">{"@type":"JobPosting","hiringOrganization":{"name":"%s"}}</script>'
    pages = [("a", record % "Quarry Birk" + "Mason"), ("b", record % "" + "Mason"), ("c", "Mason wanted"), ("d", "Mason, no longer accepting applications")]
    log = spark.createDataFrame([(u, u, 200, h, None, None) for u, h in pages], "url string, final_url string, status int, html string, blocked_reason string, error string")
    facts = {r.url: (r.page_norm, r.page_words) for r in validation.page_facts(log).collect()}
    assert facts == {"a": (None, None), "b": ("mason", None), "c": ("mason wanted", ["mason", "wanted"]), "d": ("mason no longer accepting applications", None)}


def test_contacts_are_read_once_for_their_ranking(spark, monkeypatch):
    seen, ranked = [], con.rank_contacts
    monkeypatch.setattr(con, "rank_contacts", lambda df: seen.append(df) or ranked(df))
    firm = spark.createDataFrame([("c1", "Acme", "acme.example", None, None)], "company_key string, company_name string, company_domain string, careers_url string, role_hint string")
    posts = spark.createDataFrame([("c1", "u", "write to jobs@acme.example")], "company_key string, posting_url string, description string")
    pages = spark.createDataFrame([], "url string, final_url string, status int, html string")
    assert [r.role for r in con.discover_contacts(firm, posts, pages).orderBy("contact_rank").collect()] == ["TALENT_ALIAS", "SEARCH_LINK"]
    assert "regexp" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
