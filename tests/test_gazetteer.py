"""Places as a table: phrases against a plain scan, and a city that is only a row."""

from __future__ import annotations

import random

from postmill.operators import gazetteer, relevance


def plain_hits(words, aliases):
    """Leftmost-longest, using up words."""
    out, at = [], 0
    while at < len(words):
        n = next((n for n in (4, 3, 2, 1) if at + n <= len(words) and " ".join(words[at : at + n]) in aliases), 0)
        if n:
            out.append((at, n, " ".join(words[at : at + n])))
        at += n or 1
    return out


def test_phrases_equal_a_plain_scan(spark):
    rng = random.Random(4)
    vocabulary = ["san", "port", "old", "new", "x"]
    aliases = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))) for _ in range(25)})
    table = spark.createDataFrame([("city", a.title(), f"D {a}", "zz") for a in aliases] + [("country", aliases[0], "A land", "yy")], gazetteer.SCHEMA)
    texts = [(i, " ".join(rng.choice(vocabulary + ["Port,", "SAN"]) for _ in range(rng.randrange(0, 15)))) for i in range(150)] + [(900, None)]
    got = sorted((r.id, r.at, r.n, r.alias) for r in gazetteer.phrase_hits(spark.createDataFrame(texts, "id int, t string"), "id", "t", table).collect())
    want = sorted((i, *h) for i, t in texts for h in plain_hits([w.lower().strip(",") for w in (t or "").split()], set(aliases)))
    assert len(want) > 200 and got == want


def test_a_city_that_is_only_a_row(spark):
    table = gazetteer.default_places(spark).unionByName(
        spark.createDataFrame([("city", "old kirn", "Old Kirn", "kk"), ("city", "kirnstadt", "Old Kirn", "kk"), ("country", "kirnland", "Kirnland", "kk")], gazetteer.SCHEMA)
    )
    asked = spark.createDataFrame([(1, "Find tanner jobs in Old Kirn and Pune"), (2, "Find tanner jobs in Pune"), (3, "Find tanner jobs")], "query_id bigint, raw string")
    rows = {r.query_id: r for r in gazetteer.structure_requests(asked, table).collect()}
    assert rows[1].locations == ["Old Kirn", "Pune"] and rows[2].locations == ["Pune"] and rows[3].locations == []
    assert [t.lower() for t in rows[1].titles] == [t.lower() for t in rows[3].titles] == ["tanner"] and rows[1].raw == "Find tanner jobs in Old Kirn and Pune"
    assert not any("No location" in n for n in rows[1].parse_notes) and any("No location" in n for n in rows[3].parse_notes)

    jobs = [(1, "Tanner", "Kirnstadt"), (2, "Tanner", "Kirnland"), (3, "Tanner", "Lisbon"), (4, "Tanner", "Pune, India")]
    postings = spark.createDataFrame([(o, t, "Larch", p, "", False) for o, t, p in jobs], "ord int, title string, company_name string, location string, description string, is_remote boolean")
    queries = spark.createDataFrame(list(rows.values()), gazetteer.structure_requests(asked, table).schema)
    scores = {(r.query_id, r.ord): r.location_match.score for r in relevance.match_queries_to_postings(queries, postings, table).collect()}
    assert [scores[1, o] for o in (1, 2, 3, 4)] == [1.0, 0.55, 0.0, 1.0] and [scores[2, o] for o in (1, 2, 4)] == [0.0, 0.0, 1.0] and scores[3, 3] == 1.0
    best, _ = relevance.best_matches(queries, postings, places_table=table)
    assert {(r.query_id, r.ord) for r in best.collect()} == {(1, 1), (1, 2), (1, 4), (2, 4), *((3, o) for o in (1, 2, 3, 4))}
    # the table of the built-in list gives what the built-in list gives
    own = gazetteer.default_places(spark)
    a, b = (relevance.match_queries_to_postings(queries, postings, t).select("query_id", "ord", "score", "reasons") for t in (None, own))
    assert sorted(map(str, a.filter("query_id > 1").collect())) == sorted(map(str, b.filter("query_id > 1").collect()))
