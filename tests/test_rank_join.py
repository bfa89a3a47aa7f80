"""Scores against a plain scorer, and the bounded join against all pairs, over random requests and postings."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postmill.operators import relevance

TOWNS = ["ulmholm", "vessby", "old kirn", "tarn"]
NOUNS = ["brewer", "brewery", "smith", "silver", "night", "hand"]
FIRMS = ["larch", "quarry stone", "birk"]
TERMS = ["yeast", "hops", "forge", "night shift"]
REQUEST = (
    "query_id int, raw string, titles array<string>, locations array<string>, companies array<string>, industries array<string>, keywords array<string>, "
    "exclusions array<string>, min_years double, max_years double, experience_level string, experience_text string, remote_only boolean, limit int"
)
POSTING = "ord int, title string, company_name string, location string, description string, is_remote boolean"


def some(rng, values, most=2):
    return rng.sample(values, rng.randrange(most + 1))


def random_requests(rng, n):
    out = []
    for i in range(n):
        titles = [" ".join(rng.sample(NOUNS, rng.randrange(1, 3))) for _ in range(rng.randrange(1, 3))]
        low = rng.choice([None, None, 1.0, 4.0])
        out.append((i, "", titles, some(rng, TOWNS), some(rng, FIRMS, 1) if rng.random() < 0.3 else [], some(rng, TERMS[:2], 1), some(rng, TERMS), some(rng, TERMS, 1) if rng.random() < 0.3 else [], low, rng.choice([None, 6.0]) if low else None, None, None, rng.random() < 0.1, rng.choice([1, 3, 7, 500])))
    return out


def random_postings(rng, n):
    out = []
    for i in range(n):
        asked = rng.choice(["", "", "2 to 5 years.", "9+ years of experience."])
        out.append((i, " ".join(rng.sample(NOUNS, rng.randrange(1, 4))), rng.choice(FIRMS), rng.choice([None, "Remote", *TOWNS, "tarn, vessby"]), f"{asked} {' '.join(some(rng, TERMS, 3))}", rng.random() < 0.1))
    return out


def words(text):
    return set((text or "").split())


def plain_title(have, want):
    if have == want:
        return 1.0
    if want in have:
        return 0.9
    both = len(words(have) & words(want))
    return 0.75 * both / len(words(want)) + 0.25 * both / len(words(have) | words(want))


def plain_score(r, p):
    """One pair, as the rules say: 45 title, 20 place, 15 years, 10 keywords, 5 company, 5 industry."""
    _, _, titles, places, firms, industries, keywords, exclusions, low, high, _, _, remote_only, _ = r
    _, title, firm, place, text, remote = p
    blob = f"{title} {firm} {place or ''} {text}".lower()
    best = max(plain_title(title, t) for t in titles)
    if best < 0.2:
        return None
    norm, far = (place or "").lower().replace(",", ""), remote or "remote" in (place or "").lower()
    if remote_only:
        where = 1.0 if far else 0.0
    elif not places:
        where = 1.0
    elif not norm:
        where = 0.4
    else:
        where = 1.0 if any(f" {t} " in f" {norm} " for t in places) else 0.7 if far else 0.0
    years = (2.0, 5.0) if "2 to 5" in text else (9.0, 40.0) if "9+" in text else None
    fit = 1.0
    if low is not None or high is not None:
        fit = 0.6 if years is None else float(years[0] <= (40.0 if high is None else high) and (low or 0.0) <= years[1])
    hits = sum(k in blob for k in keywords) / len(keywords) if keywords else 1.0
    named = float(not firms or firm in firms)
    trade = float(not industries or any(t in blob for t in industries))
    if any(e in blob for e in exclusions):
        return 0.0
    total = round(0.0 + 45.0 * best + 20.0 * where + 15.0 * fit + 10.0 * hits + 5.0 * named + 5.0 * trade + 1e-9, 1)
    return min(15.0, total) if not where or not fit or (firms and not named) else total


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_and_best_matches(spark, seed):
    rng = random.Random(seed)
    requests, postings = random_requests(rng, 40), random_postings(rng, 160)
    asked, jobs = spark.createDataFrame(requests, REQUEST), spark.createDataFrame(postings, POSTING)
    got = {(r.query_id, r.ord): r.score for r in relevance.match_queries_to_postings(asked, jobs).select("query_id", "ord", "score").collect()}
    want = {(r[0], p[0]): s for r in requests for p in postings if (s := plain_score(r, p)) is not None}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 0.051  # halves may round either way

    ranked = defaultdict(list)
    for (q, o), s in got.items():
        if s >= 35:
            ranked[q].append((-s, o))
    best, overflow = relevance.best_matches(asked, jobs, cap=20)
    rows = best.select("query_id", "ord", "score", "match_rank", "reasons").collect()
    limits = {r[0]: min(20, r[-1]) for r in requests}
    assert sorted((r.query_id, r.match_rank, r.ord, r.score) for r in rows) == sorted((q, i + 1, o, -s) for q, found in ranked.items() for i, (s, o) in enumerate(sorted(found)[: limits[q]]))
    assert all(r.reasons[0].startswith("Title ") for r in rows)
    assert {(r.query_id, r.matching, r.left_over) for r in overflow.collect()} == {(q, len(f), max(0, len(f) - limits[q])) for q, f in ranked.items()}


def test_postings_of_one_request_each(spark):
    rng = random.Random(5)
    requests, postings = random_requests(rng, 12), random_postings(rng, 150)
    asked = spark.createDataFrame(requests, REQUEST)
    jobs = spark.createDataFrame([(*p, i % 12) for i, p in enumerate(postings)], POSTING + ", query_id int")
    every, _ = relevance.topk_relevant(relevance.match_queries_to_postings(asked, jobs))
    best, _ = relevance.best_matches(asked, jobs)
    kept = ["query_id", "ord", "score", "match_rank", "reasons", "mismatches"]
    assert sorted(map(str, best.select(*kept).collect())) == sorted(map(str, every.select(*kept).collect()))
    none = relevance.best_matches(asked, jobs.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_ride_with_winners_only(spark, monkeypatch):
    rng = random.Random(6)
    asked, jobs = spark.createDataFrame(random_requests(rng, 5), REQUEST), spark.createDataFrame(random_postings(rng, 30), POSTING)
    seen = []
    monkeypatch.setattr(relevance, "checkpoint", lambda df: (seen.append(df), df.sparkSession.createDataFrame(df.collect(), df.schema))[1])
    relevance.best_matches(asked, jobs)
    facts, pairs, scored = seen[1:]
    for df in (facts, pairs, scored):
        assert not {"description", "blob", "title", "location"} & set(df.columns)
    assert "BroadcastNestedLoopJoin" not in plan(scored) and "CartesianProduct" not in plan(pairs)
    with pytest.raises(ValueError):
        relevance.best_matches(asked, jobs, min_score=10.0)


def test_bounds_hold_for_every_pair(spark):
    rng = random.Random(7)
    requests, postings = random_requests(rng, 30), random_postings(rng, 80)
    asked, jobs = relevance.prepare_requests(spark.createDataFrame(requests, REQUEST)), spark.createDataFrame(postings, POSTING)
    facts = relevance.posting_profiles(jobs)
    pairs = relevance._bounded_pairs(asked, facts, 35.0).join(facts.select("profile", "ord"), "profile")
    bounds = {(r.query_id, r.ord): (r.least, r.most) for r in pairs.select("query_id", "ord", "least", "most").collect()}
    scores = relevance.match_queries_to_postings(spark.createDataFrame(requests, REQUEST), jobs).filter(F.col("score") >= 35).collect()
    assert len(scores) > 100
    for r in scores:
        least, most = bounds[r.query_id, r.ord]
        assert least <= r.score <= most


def test_postings_of_one_request_meet_no_other_titles(spark):
    rng = random.Random(7)
    asked = relevance.prepare_requests(spark.createDataFrame(random_requests(rng, 12), REQUEST))
    jobs = spark.createDataFrame([(*p, i % 12) for i, p in enumerate(random_postings(rng, 60))], POSTING + ", query_id int")
    facts = relevance.posting_profiles(jobs)
    met = relevance.title_matches(asked, facts)
    every = relevance.title_matches(asked, facts.drop("query_id")).join(facts.select("query_id", "title_norm").distinct(), ["query_id", "title_norm"])
    assert sorted(map(str, met.select(*every.columns).collect())) == sorted(map(str, every.collect()))


def test_requests_that_share_a_title_and_criteria_are_searched_once(spark):
    """Many requests for few titles: pairs are formed for each title once, and every request gets its own rows and count."""
    rng = random.Random(11)
    shared = [(i, "", ["night", ["brewer", "silver smith", "hand"][i % 3]], [], [], [], [["yeast"], []][i % 2], [], None, None, None, None, False, 1 + i % 9) for i in range(60)]
    asked, jobs = spark.createDataFrame(shared, REQUEST), spark.createDataFrame(random_postings(rng, 120), POSTING)
    units, members = relevance._search_units(relevance.prepare_requests(asked))
    assert units.count() == 8 and members.count() == 120
    every, left = relevance.topk_relevant(relevance.match_queries_to_postings(asked, jobs))
    best, overflow = relevance.best_matches(asked, jobs)
    kept = ["query_id", "ord", "score", "match_rank", "title_match", "reasons", "mismatches"]
    assert sorted(map(str, best.select(*kept).collect())) == sorted(map(str, every.select(*kept).collect()))
    counts = ["query_id", "left_over"]
    assert sorted(map(str, overflow.select(*counts).collect())) == sorted(map(str, left.select(*counts).collect()))


@pytest.mark.parametrize("bulk", [1, 25, 60])
def test_values_of_every_pair_by_groups(spark, monkeypatch, bulk):
    """The same pairs and scores whichever titles are met in bulk; like requests are one group and share its scores."""
    rng = random.Random(bulk)
    shared = [(i, "", ["night", ["brewer", "silver smith", "hand"][i % 3]], [], [], [], [["yeast"], []][i % 2], [], None, None, None, None, False, 5) for i in range(60)]
    requests = shared + [(100 + r[0], *r[1:]) for r in random_requests(rng, 40)]
    asked, jobs = spark.createDataFrame(requests, REQUEST), spark.createDataFrame(random_postings(rng, 120), POSTING)
    every = relevance.match_queries_to_postings(asked, jobs)
    monkeypatch.setattr(relevance, "BULK", bulk)
    monkeypatch.setattr(relevance, "MEMBERS", 7)
    monkeypatch.setattr(relevance, "LISTS", 2)
    names = ["score", "title", "location", "experience", "keyword_ratio", "company", "industry"]
    values = {n: F.col(n if n in every.columns else f"{n}_match.score") for n in names}
    got = relevance.pair_values(asked, jobs, values, key="ord").collect()
    want = every.select("query_id", "ord", *[v.alias(n) for n, v in values.items()]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 1000


def test_like_requests_are_one_group(spark, monkeypatch):
    alike = [(i, "", ["night", f"smith{i}"], [], [], [], ["yeast"], [], None, None, None, None, False, 5) for i in range(50)]
    asked, jobs = spark.createDataFrame(alike, REQUEST), spark.createDataFrame([(i, f"night hand{i}", "birk", None, "yeast", False) for i in range(40)], POSTING)
    seen, grouped = [], relevance._request_groups
    monkeypatch.setattr(relevance, "BULK", 30)
    monkeypatch.setattr(relevance, "_request_groups", lambda df: (seen.append(grouped(df)), seen[-1])[1])
    assert relevance.pair_values(asked, jobs, {"score": F.col("score")}, key="ord").count() == 2000
    assert [(r.bulk, r.asked, len(r.members)) for r in seen[0].collect()] == [(["night"], 50, 50)]


def test_requests_that_name_companies_meet_their_titles_only(spark):
    """Many requests for a frequent word, each at one company: pairs grow with the companies' postings, not with requests times postings."""
    rng = random.Random(13)
    named = [(i, "", ["night"], [], [f"firm {i}"], [], ["yeast"], [], None, None, None, None, False, 5) for i in range(20)]
    postings = [(i, f"night hand{i}", f"firm {i % 30}", None, rng.choice(["yeast", ""]), False) for i in range(120)]
    asked, jobs = spark.createDataFrame(named, REQUEST), spark.createDataFrame(postings, POSTING)
    units, _ = relevance._search_units(relevance.prepare_requests(asked))
    assert relevance._bounded_pairs(units, relevance.posting_profiles(jobs), 35.0).count() == 80
    every, _ = relevance.topk_relevant(relevance.match_queries_to_postings(asked, jobs))
    best, overflow = relevance.best_matches(asked, jobs)
    kept = ["query_id", "ord", "score", "match_rank", "reasons", "mismatches"]
    assert sorted(map(str, best.select(*kept).collect())) == sorted(map(str, every.select(*kept).collect()))
    assert {(r.query_id, r.matching) for r in overflow.collect()} == {(i, 4) for i in range(20)}
