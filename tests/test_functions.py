"""Golden rows for the column functions."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from postmill.functions import dates, html, places, urls
from postmill.functions import experience as ex
from postmill.functions import text as tx


def folded(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def test_accent_folding_follows_the_unicode_rule(one):
    values = ["Société Générale", "São Paulo", "Müller ß", "ﬁn ½ ㎏ №", "Ǆ ĳ", "Ελλάδα", "Łódź", "ñ", "plain"]
    assert one(tx.strip_accents, values) == [folded(v) for v in values]


def test_basic_normalize(one):
    values = ["  Hello,  World! ", "C++ / C#", "", None, "a b\tc"]
    assert one(tx.basic_normalize, values) == ["hello world", "c c", "", "", "a b c"]


def test_company_names(one):
    values = ["Razorpay Software Pvt. Ltd.", "Acme Inc.", "India", "Acme Acme GmbH", None]
    assert one(tx.normalize_company_name, values) == ["razorpay", "acme", "india", "acme acme", ""]


def test_titles(one):
    values = ["Sr. Data Scientist [Contract]", "APM - Bangalore", "Product Owner Req #123", "Engineer (f/m/d)", "AI ML lead"]
    assert one(tx.normalize_title, values) == [
        "senior data scientist", "associate product manager", "product owner", "engineer", "ai lead",
    ]


def test_locations_and_places(one):
    assert one(tx.normalize_location, ["Remote - India", "Anywhere", "Bengaluru", None]) == ["remote india", "remote", "bangalore", ""]
    assert one(places.canonical_place, ["Bengaluru, Karnataka, India", "Springfield", None]) == ["bangalore", "springfield", ""]
    found = one(places.resolve_place, ["Bengaluru", "Bangalore, Karnataka", "Somewhere Nice", "UK"])
    assert [tuple(r) if r else None for r in found] == [("Bangalore", "in"), ("Bangalore", "in"), None, ("Uk", "gb")]


def test_countries(spark):
    rows = spark.createDataFrame([(["London", "Berlin", "Leeds", "Manchester"],)], "v array<string>")
    assert rows.select(places.countries_for(F.col("v"))).first()[0] == ["gb", "de"]


def test_duplicate_key(spark):
    rows = spark.createDataFrame(
        [
            ("Acme Inc.", "Senior Product Manager", "Bangalore, Karnataka, India"),
            ("Acme", "Product Manager, Senior", "Bengaluru"),
            ("Acme", "Product Manager", "Bengaluru"),
            ("Globex", "Product Manager, Senior", "Bengaluru"),
        ],
        "c string, t string, l string",
    ).coalesce(1)
    keys = [r[0] for r in rows.select(places.duplicate_key(F.col("c"), F.col("t"), F.col("l"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_canonical_url(one):
    values = [
        "https://WWW.Larch.example/open/55/?utm_medium=m&gh_src=y&id=3", "not a url", "https://Example.com/Jobs/9/",
        "http://a.b/x?q=a|b&empty=&refId=1&srcset=2&k=a+b%20c#f", " https://a.b ",
    ]
    assert one(urls.canonicalize_url, values) == [
        "https://larch.example/open/55?id=3", "not a url", "https://example.com/Jobs/9", "http://a.b/x?q=a%7Cb&k=a+b+c", "https://a.b/",
    ]


def test_hosts(one):
    values = [
        "https://www.larch.example/work/8", "https://boards.greenhouse.io/larch/jobs/8", "http://127.0.0.9/work",
        "http://192.168.7.7:8080/work", "http://[::1]/work", "http://localhost/work", None,
    ]
    assert one(urls.employer_domain, values) == ["larch.example", None, None, None, None, None, None]
    assert one(urls.extract_domain, ["https://www.Example.com/careers", "example.com", "HTTP://SUB.EXAMPLE.CO.UK/x"]) == [
        "example.com", "example.com", "sub.example.co.uk",
    ]


def test_dates(one):
    values = [
        "2026-08-07T09:00:00Z", "1785456000000", "1787000000", "2026-08-22 10:00:00", "7/8/2026", "12/25/2026", "Aug 7, 2026",
        "7 Aug 2026", "2026-08-07T09:00:00+05:30", "soon", "", None, "99999999999999999999", "2026-02-30",
    ]
    got = one(lambda c: F.date_format(dates.parse_datetime(c), "yyyy-MM-dd HH:mm"), values)
    assert got == [
        "2026-08-07 09:00", "2026-07-31 00:00", "2026-08-17 20:53", "2026-08-22 10:00", "2026-08-07 00:00", "2026-12-25 00:00",
        "2026-08-07 00:00", "2026-08-07 00:00", "2026-08-07 03:30", None, None, None, None, None,
    ]


def test_experience(one):
    cases = {
        "4-6 years in kitchens": (4.0, 6.0, None), "4–6 years": (4.0, 6.0, None), "2 to 5 yrs": (2.0, 5.0, None),
        "up to 7 years": (0.0, 7.0, None), "6+ years": (6.0, None, None), "at least 9 years": (9.0, None, None),
        "minimum of 3 years experience": (3.0, None, None), "8-6 years": (6.0, 8.0, None), "99 years": (40.0, None, None),
        "freshers are welcome": (None, None, "ENTRY"), "entry-level baker": (None, None, "ENTRY"),
        "Senior Baker": (None, None, "SENIOR"), "Winter internship": (None, None, "INTERNSHIP"),
        "Director of Bread": (None, None, "EXECUTIVE"), "Warm ovens and early hours.": (None, None, None),
    }
    got = one(ex.parse_experience, list(cases))
    assert [(r.min_years, r.max_years, r.level) for r in got] == list(cases.values())
    assert one(lambda c: ex.describe_experience(ex.parse_experience(c)), ["3+ years", "Director", "hm"]) == [
        "3+ years", "Executive", "Not stated",
    ]


def test_experience_overlap_is_unknown_when_a_side_is_silent(one):
    def meets(c):
        wanted = F.struct(F.lit(0.0).alias("low"), F.lit(2.0).alias("high"))
        return ex.overlaps(wanted, ex.experience_bounds(ex.parse_experience(c)))

    assert one(meets, ["nothing", "1-3 years", "8+ years"]) == [None, True, False]


def test_titles_expand(one):
    assert one(places.expand_title, ["apm", " Product Manager ", "Welder"]) == [
        ["apm", "associate product manager"], ["Product Manager", "associate product manager", "product owner"], ["Welder"],
    ]


def test_contact_titles_and_names(one):
    titles = ["Technical Recruiter", "Talent Acquisition Partner, Product", "Recruiter", "Hiring Manager", "Director of Product",
              "Warehouse Operative", None]
    assert one(html.classify_contact_title, titles) == [
        "FUNCTION_RECRUITER", "TALENT_ACQUISITION", "TALENT_ACQUISITION", "HIRING_MANAGER", "TEAM_LEAD", None, None,
    ]
    assert one(html.is_person_name, ["Priya Demo", "Ana Núñez-Ruiz", "priya demo", "One", "A B C D E"]) == [True, True, False, False, False]


def test_html_to_text(one):
    page = """<html><head><title>T</title><script>var x = "</p><b>no";</script><style>p{}</style></head>
      <body><!-- hidden <b>x</b> --><p>Tom &amp; Ann<p>next<br>line</body>"""
    assert one(lambda c: html.html_to_text(c, None), [page, None, ""]) == ["T Tom & Ann next line", "", ""]
    assert len(one(html.html_to_text, ["<p>" + "word " * 9000 + "</p>"])[0]) == 44_999


def test_structured_data_is_flattened(spark):
    page = (
        '<script type="application/ld+json">{"@graph":[{"@type":["JobPosting","X"],"hiringOrganization":{"name":"Demo"}},{"@type":"Person"}]}</script>'
        '<script type="application/ld+json">[{"a":1},[{"type":"jobposting","hiringOrganization":"Plain"}]]</script>'
        '<script type="application/ld+json">{broken</script>'
    )
    rows = html.extract_jsonld(spark.createDataFrame([(page,)], "html string"))
    got = rows.orderBy("pos").select(html.has_type(F.col("block"), "JobPosting"), html.hiring_organization(F.col("block"))).collect()
    assert [tuple(r) for r in got] == [(False, None), (True, "Demo"), (False, None), (False, None), (True, "Plain")]


def test_structured_data_is_followed_to_any_depth(spark):
    block = '{"@type":"JobPosting","hiringOrganization":"Deep"}'
    for _ in range(40):
        block = '{"@graph":[[' + block + "]]}"
    page = f'<script type="application/ld+json">{block}</script>'
    rows = html.extract_jsonld(spark.createDataFrame([(page,), (None,)], "html string"))
    assert rows.count() == 41
    assert [r[0] for r in html.job_posting_blocks(rows).select(html.hiring_organization(F.col("block"))).collect()] == ["Deep"]


def test_emails(one):
    text = "Write to Careers@x.example. or careers@x.example, ann@gmail.com"
    assert one(html.extract_emails, [text, None]) == [["careers@x.example", "ann@gmail.com"], []]
    assert one(html.email_kind, ["a@gmail.com", "jobs-eu@x.example", "info@x.example", "ann@x.example"]) == [
        "personal", "talent", "role", "individual",
    ]
    clean = one(lambda c: html.clean_email(c, F.lit("x.example")), ["MAILTO:A@x.example?subject=1", "a@mail.x.example", "a@y.example", "no", None])
    assert clean == ["a@x.example", "a@mail.x.example", None, None, None]


def test_truncation_and_excerpts(one):
    assert one(lambda c: tx.truncate_text(c, 10), ["short", "a  b\nc", "abcdefghi jkl", None]) == ["short", "a b c", "abcdefghi…", ""]
    long = "x" * 200 + " needle " + "y" * 200
    got = one(lambda c: tx.excerpt_around(c, F.lit("NEEDLE")), [long])[0]
    assert "needle" in got and len(got) <= 160


def test_labels(one):
    days = [None, 0.5, 1.5, 2.5, 13.2, 20.0, 59.0, 90.0]
    assert one(tx.humanize_days, days, "double") == [
        "date unknown", "today", "yesterday", "2 days ago", "13 days ago", "3 weeks ago", "8 weeks ago", "3 months ago",
    ]
    none = F.lit(None)
    assert one(lambda c: tx.experience_label(c, none.cast("double"), none.cast("string")), [2.0, 2.5, None], "double") == [
        "2+ years", "2.5+ years", "Not stated",
    ]


def test_people_search_link(one):
    link = one(lambda c: urls.people_search_url(c, F.lit("recruiter")), ["Demo Fintech", "A/B & C*"])
    assert link[0].endswith("keywords=Demo%20Fintech%20recruiter") and re.search("A/B%20%26%20C%2A", link[1])


def test_dates_keep_their_zone(one):
    got = one(dates.parse_datetime, ["2026-01-01T00:00:00-08:00"])[0]
    assert got == dt.datetime(2026, 1, 1, 8, 0)


def test_dates_are_stripped_and_matched_once(spark):
    from postmill.functions.dates import parse_datetime

    plan = spark.range(1).select(parse_datetime(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("3000") == 2


def test_white_space_of_every_kind(one):
    every = [chr(i) for i in range(0x3001) if chr(i).isspace() or 0x1C <= i <= 0x1F]
    values = [f"{s}a{s}{s}b c{s} d {s}" for s in every] + ["a b c", " ", "", None, "​a​"]
    assert one(tx.strip, values) == [v and v.strip() for v in values]
    assert one(tx.collapse, values) == [v and " ".join(v.split()) for v in values]


def test_common_dates_are_read_without_their_parts(one):
    values = [
        " 2026-08-07 ", "2026-08-07T09:08:07", "2026-08-07 09:08:07Z", "2026-02-30", "2026-08-07T24:00:00", "2026-08-07T09:08:07.5Z", "2026-8-7",
        "2026-08-07T09:08:07+01:00", "2026-08-07T09:08",
    ]
    assert one(lambda c: dates.parse_datetime(c), values) == one(lambda c: tx.let(tx.strip(c), dates._parsed), values)
    plain = one(lambda c: c.rlike(dates.PLAIN), [v.strip() for v in values])
    assert plain == [True, True, True, True, True, False, False, False, False]


def test_remote_words_are_looked_for_in_one_lowered_text(spark):
    rows = spark.createDataFrame([("Work From Home", None), ("x", "ANYWHERE"), (None, None), ("re", "mote")], "a string, b string")
    told = rows.select(tx.looks_remote(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in told.collect()] == [True, True, False, False]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "RLIKE" not in plan
