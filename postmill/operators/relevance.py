"""Scoring a table of postings against a table of requests.

Requests and postings are prepared once each (normalised text, aliases, parsed
experience), then joined on title similarity and scored with column
expressions. A pair whose titles do not resemble each other can never reach
the display threshold, so the join only forms pairs that pass that gate.

``match_queries_to_postings`` gives all such pairs, ``pair_values`` chosen values of
each, scored by groups of like requests. ``best_matches`` is the join for the best of
each request: score bounds of groups of like postings decide which pairs are formed at
all, terms are looked up once per posting and term, and texts and explanations are
fetched for the winners only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import experience as ex
from postmill.functions import places
from postmill.functions import text as tx
from postmill.operators import gazetteer
from postmill.plans.skew import first_k
from postmill.session import checkpoint

GRAM = 3


def _spelled(values: Column) -> Column:
    return F.transform(
        values, lambda v: F.struct(v.alias("spelling"), tx.basic_normalize(v).alias("norm"))
    )


def prepare_requests(queries: DataFrame, places_table: DataFrame | None = None) -> DataFrame:
    """Add the derived columns a request is matched by (names start with ``w_``).

    Places are those of the built-in list, or of a table as in ``gazetteer``.
    """
    wanted = F.struct(
        F.col("min_years").alias("min_years"),
        F.col("max_years").alias("max_years"),
        F.col("experience_level").alias("level"),
    )
    out = queries.withColumns(
        {
            "w_titles": _spelled(places.search_titles(F.col("titles"))),
            "w_places": F.transform(
                "locations",
                lambda v: F.struct(v.alias("name"), places.location_aliases_of(v).alias("aliases")),
            ),
            "w_countries": F.flatten(
                F.transform(places.countries_for(F.col("locations")), places.country_aliases_of)
            ),
            "w_experience": ex.experience_bounds(wanted),
            "w_keywords": _spelled(F.col("keywords")),
            "w_exclusions": _spelled(F.col("exclusions")),
            "w_companies": F.transform("companies", tx.normalize_company_name),
            "w_terms": F.flatten(F.transform("industries", places.industry_keywords)),
        }
    )
    if places_table is None:
        return out
    return out.drop("w_places", "w_countries").join(gazetteer.request_places(queries, places_table), "query_id")


def prepare_postings(postings: DataFrame, window: int | None = None) -> DataFrame:
    """Add the derived columns a posting is matched by; ``window`` reads only so much of a description."""
    description = F.coalesce("description", F.lit(""))
    if window is not None:
        description = F.left(description, F.lit(window))
    blob = F.concat_ws(
        " ", "title", "company_name", F.coalesce("location", F.lit("")), description
    )
    return postings.withColumns(
        {
            "title_norm": tx.basic_normalize(F.col("title")),
            "location_norm": tx.basic_normalize(F.col("location")),
            "blob": tx.basic_normalize(blob),
            "experience": ex.parse_experience(F.concat(F.col("title"), F.lit(". "), description), window),
            "company_key": tx.normalize_company_name(F.col("company_name")),
        }
    )


# --- title -------------------------------------------------------------------------


def title_similarity(title_norm: Column, wanted_norm: Column) -> Column:
    """1 for the same title, 0.9 for a contained one, else mostly token overlap."""

    def mix(both: Column) -> Column:
        have, want = both["have"], both["want"]

        def weigh(shared: Column) -> Column:
            union = F.size(want) + F.size(have) - shared
            return F.lit(0.75) * shared / F.size(want) + F.lit(0.25) * shared / union

        return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(
            tx.let(F.size(F.array_intersect(want, have)), weigh)
        )

    words = F.struct(tx.token_set_of(title_norm).alias("have"), tx.token_set_of(wanted_norm).alias("want"))
    return (
        F.when((title_norm == "") | (wanted_norm == ""), F.lit(0.0))
        .when(title_norm == wanted_norm, F.lit(1.0))
        .when(F.contains(title_norm, wanted_norm), F.lit(0.9))
        .otherwise(tx.let(words, mix))
    )


def _title_match(title_norm: Column, titles: Column) -> Column:
    """Best wanted title as (score, exact, place, spelling); exact wins a tie, then the earlier one."""
    scored = F.transform(
        titles,
        lambda w, i: F.struct(
            title_similarity(title_norm, w["norm"]).alias("score"),
            (title_norm == w["norm"]).alias("exact"),
            (-i).alias("place"),
            w["spelling"].alias("spelling"),
        ),
    )
    return F.array_max(scored)


def title_score(pairs: DataFrame) -> DataFrame:
    """Add ``title_match`` for prepared pairs."""
    return pairs.withColumn("title_match", _title_match(F.col("title_norm"), F.col("w_titles")))


def _grams(text: Column, size: int) -> Column:
    """Distinct character runs of one length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _sharing_words(have: DataFrame, want: DataFrame) -> DataFrame:
    """title_norm, wanted of titles that share a word, once for each such word."""
    by_word = have.select("title_norm", F.explode(tx.token_set_of(F.col("title_norm"))).alias("k")).join(
        want.select("wanted", F.explode(tx.token_set_of(F.col("wanted"))).alias("k")), "k"
    )
    return by_word.select("title_norm", "wanted")


def _contained(have: DataFrame, want: DataFrame) -> DataFrame:
    """title_norm, wanted where the title contains the wanted one, looked for by its rarest character run."""
    runs = F.flatten(F.array(*[_grams(F.col("title_norm"), n) for n in range(1, GRAM + 1)]))
    titled = have.select("title_norm", F.explode(F.array_distinct(runs)).alias("k"))
    own = want.select("wanted", F.explode(_grams(F.col("wanted"), GRAM)).alias("k"))
    common = titled.join(own.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
    rarest = own.join(common, "k", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("run"))
    by_run = titled.join(rarest.filter("run.n > 0").select("wanted", F.col("run.k").alias("k")), "k")
    return by_run.filter(F.contains("title_norm", "wanted")).select("title_norm", "wanted")


def title_matches(requests: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, title_norm, title_match) for every pair that passes the title gate.

    Works on the two dictionaries of distinct titles, not on postings. A pair
    passes only if the titles share a word or one contains the other, so
    candidates come from two equality joins: on words, and on character runs,
    each wanted title by the one of its runs that the fewest posting titles have.
    Postings that carry a ``query_id`` meet the titles of that request only.
    """
    if "query_id" in postings.columns:
        own = postings.select("query_id", "title_norm").distinct().filter("title_norm <> ''")
        met = title_score(own.join(requests.select("query_id", "w_titles"), "query_id"))
        return met.filter(F.col("title_match.score") >= fixed.MIN_TITLE_SIMILARITY).select("query_id", "title_norm", "title_match")
    have = postings.select("title_norm").distinct().filter("title_norm <> ''")
    asked = requests.select("query_id", F.posexplode("w_titles").alias("place", "w")).select(
        "query_id", "place", "w.spelling", F.col("w.norm").alias("wanted")
    ).filter("wanted <> ''")
    want = asked.select("wanted").distinct()

    pairs = _sharing_words(have, want).unionByName(_contained(have, want)).distinct()
    scored = pairs.withColumn("score", title_similarity(F.col("title_norm"), F.col("wanted")))
    scored = scored.filter(F.col("score") >= fixed.MIN_TITLE_SIMILARITY)
    match = F.struct(
        "score", (F.col("title_norm") == F.col("wanted")).alias("exact"), (-F.col("place")).alias("place"), "spelling"
    )
    return scored.join(asked, "wanted").groupBy("query_id", "title_norm").agg(F.max(match).alias("title_match"))


# --- the other criteria -------------------------------------------------------------


def _verdict(score: Column, reason: Column) -> Column:
    return F.struct(score.alias("score"), reason.alias("reason"))


def _score(value: float, reason) -> Column:
    return _verdict(F.lit(value), reason if isinstance(reason, Column) else F.lit(reason))


def location_score(pairs: DataFrame) -> DataFrame:
    """Add ``location_match`` (score, reason)."""
    norm, raw = F.col("location_norm"), F.col("location")
    named = F.filter(
        "w_places", lambda p: F.exists(p["aliases"], lambda a: tx.padded_contains(norm, a))
    )
    in_country = F.exists("w_countries", lambda a: tx.padded_contains(norm, a))
    remote_text = F.contains(F.lower(F.coalesce(raw, F.lit(""))), F.lit("remote"))
    match = (
        F.when(
            F.col("remote_only"),
            F.when(F.col("is_remote") | remote_text, _score(1.0, "Remote, as requested")).otherwise(
                _score(0.0, "Not a remote role")
            ),
        )
        .when(F.size("locations") == 0, _score(1.0, "No location requested"))
        .when(norm == "", _score(0.4, "Location not stated on the posting"))
        .when(F.size(named) > 0, _score(1.0, F.concat(F.lit("Located in "), F.get(named, 0)["name"])))
        .when(
            in_country,
            _score(0.55, F.concat(F.lit("In the right country, but the posting says “"), raw, F.lit("”"))),
        )
        .when(
            F.col("is_remote") | F.contains(norm, F.lit("remote")),
            _score(0.7, "Remote — reachable from your locations"),
        )
        .otherwise(
            _score(0.0, F.concat(F.lit("Located in "), raw, F.lit(", not "), F.array_join("locations", ", ")))
        )
    )
    return pairs.withColumn("location_match", match)


def experience_score(pairs: DataFrame) -> DataFrame:
    """Add ``experience_match`` (score, reason); an unstated requirement is unknown, not wrong."""
    found = F.col("experience")
    bounds = ex.experience_bounds(found)
    described = F.coalesce(found["text"], F.lower(found["level"]))
    match = (
        F.when(F.col("w_experience.low").isNull(), _score(1.0, "No experience level requested"))
        .when(bounds["low"].isNull(), _score(0.6, "Posting does not state an experience requirement"))
        .when(
            ex.overlaps(F.col("w_experience"), bounds),
            _score(1.0, F.concat(F.lit("Experience requirement ("), described, F.lit(") fits"))),
        )
        .otherwise(_score(0.0, F.concat(F.lit("Wants "), described, F.lit(", outside the range you asked for"))))
    )
    return pairs.withColumn("experience_match", match)


def keyword_score(pairs: DataFrame) -> DataFrame:
    """Add ``keyword_hits`` and ``keyword_ratio``; a keyword may match inside a word."""
    hits = F.transform(
        F.filter("w_keywords", lambda k: (k["norm"] != "") & F.contains(F.col("blob"), k["norm"])),
        lambda k: k["spelling"],
    )
    ratio = F.when(F.size("keywords") == 0, F.lit(1.0)).otherwise(F.size("keyword_hits") / F.size("keywords"))
    return pairs.withColumn("keyword_hits", hits).withColumn("keyword_ratio", ratio)


def company_score(pairs: DataFrame) -> DataFrame:
    """Add ``company_match`` (score, reason)."""
    named = F.array_contains("w_companies", F.col("company_key"))
    none = F.lit(None).cast("string")
    match = (
        F.when(F.size("companies") == 0, _verdict(F.lit(1.0), none))
        .when(
            named,
            _score(1.0, F.concat(F.lit("At "), F.col("company_name"), F.lit(", one of the companies you named"))),
        )
        .otherwise(_verdict(F.lit(0.0), none))
    )
    return pairs.withColumn("company_match", match)


def industry_score(pairs: DataFrame) -> DataFrame:
    """Add ``industry_match`` (score, reason); terms may match inside a word."""
    hits = F.filter("w_terms", lambda t: (t != "") & F.contains(F.col("blob"), t))
    none = F.lit(None).cast("string")
    match = (
        F.when(F.size("industries") == 0, _verdict(F.lit(1.0), none))
        .when(F.size(hits) > 0, _score(1.0, F.concat(F.lit("Mentions "), F.get(hits, 0))))
        .otherwise(_verdict(F.lit(0.0), none))
    )
    return pairs.withColumn("industry_match", match)


# --- the whole score ----------------------------------------------------------------


def _ratios() -> dict[str, Column]:
    return {
        "title": F.coalesce(F.col("title_match.score"), F.lit(0.0)),
        "location": F.col("location_match.score"),
        "experience": F.col("experience_match.score"),
        "keywords": F.col("keyword_ratio"),
        "company": F.col("company_match.score"),
        "industry": F.col("industry_match.score"),
    }


def _total(ratios: dict[str, Column], weights: dict[str, float] = fixed.SCORE_WEIGHTS) -> Column:
    """Weighted ratios added up in one order and rounded: more of any ratio never gives less."""
    return F.round(sum((F.lit(w) * ratios[name] for name, w in weights.items()), F.lit(0.0)), 1)


def score_postings(pairs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``score`` and ``breakdown`` to prepared pairs that have a ``title_match``.

    Weighted ratios add up to 100. An excluded term zeroes the score; a stated
    constraint that is contradicted caps it below the display threshold.
    """
    return _weighed(_criteria(pairs), weights or fixed.SCORE_WEIGHTS)


def _criteria(pairs: DataFrame) -> DataFrame:
    """What ``score_postings`` adds up, but for the title."""
    for step in (location_score, experience_score, keyword_score, company_score, industry_score):
        pairs = step(pairs)
    excluded = F.exists("w_exclusions", lambda e: (e["norm"] != "") & F.contains(F.col("blob"), e["norm"]))
    return pairs.withColumn("excluded", excluded)


def _weighed(pairs: DataFrame, weights: dict[str, float] = fixed.SCORE_WEIGHTS) -> DataFrame:
    ratios = _ratios()
    total = _total(ratios, weights)
    gated = (
        (ratios["title"] < fixed.MIN_TITLE_SIMILARITY)
        | (ratios["location"] <= 0)
        | (ratios["experience"] <= 0)
        | ((F.size("companies") > 0) & (ratios["company"] <= 0))
    )
    score = total
    parts = []
    for name, weight in weights.items():
        parts += [
            F.lit(name),
            F.struct(
                F.round(ratios[name] * weight, 1).alias("score"),
                F.lit(weight).alias("max"),
                F.round(ratios[name], 3).alias("ratio"),
            ),
        ]
    return pairs.withColumns(
        {
            "score": F.when(F.col("excluded"), F.lit(0.0))
            .when(gated, F.least(score, F.lit(fixed.GATE_SCORE)))
            .otherwise(score),
            "breakdown": F.create_map(*parts),
        }
    )


def match_explanations(scored: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``mismatches`` in a fixed order."""
    ratios = _ratios()
    title = F.col("title_match")
    title_reason = F.when(
        title["score"] > 0,
        F.concat(
            F.when(title["exact"], F.lit("Title is exactly “")).otherwise(F.lit("Title matches “")),
            title["spelling"],
            F.lit("”"),
        ),
    )
    near = ratios["location"] >= 0.7
    fits = ratios["experience"] >= 1.0
    hits = F.col("keyword_hits")
    reasons = [
        title_reason,
        F.col("company_match.reason"),
        F.col("industry_match.reason"),
        F.when(near, F.col("location_match.reason")),
        F.when(fits, F.col("experience_match.reason")),
        F.when(F.size(hits) > 0, F.concat(F.lit("Mentions "), F.array_join(F.slice(hits, 1, 4), ", "))),
    ]
    banned = F.filter(
        "w_exclusions", lambda e: (e["norm"] != "") & F.contains(F.col("blob"), e["norm"])
    )
    open_gate = ~F.col("excluded")
    mismatches = [
        F.when(~near, F.col("location_match.reason")),
        F.when(~fits, F.col("experience_match.reason")),
        F.when(
            (F.size(hits) == 0) & (F.size("keywords") > 0), F.lit("None of your keywords appear in the posting")
        ),
        F.when(
            F.col("excluded"),
            F.concat(F.lit("Excluded by your search: mentions “"), F.get(banned, 0)["spelling"], F.lit("”")),
        ),
        F.when(
            open_gate & (ratios["title"] < fixed.MIN_TITLE_SIMILARITY),
            F.lit("Title does not resemble the role you asked for"),
        ),
        F.when(
            open_gate & (F.size("companies") > 0) & (ratios["company"] <= 0),
            F.concat(F.col("company_name"), F.lit(" is not one of the companies you named")),
        ),
    ]
    return scored.withColumns(
        {"reasons": F.array_compact(F.array(*reasons)), "mismatches": F.array_compact(F.array(*mismatches))}
    )


def match_queries_to_postings(queries: DataFrame, postings: DataFrame, places_table: DataFrame | None = None) -> DataFrame:
    """Every request and posting pair that passes the title gate, scored and explained.

    If the postings carry a ``query_id`` they belong to that request only,
    otherwise each posting meets every request.
    """
    requests, jobs = prepare_requests(queries, places_table), prepare_postings(postings)
    # requests meet their titles first, so that a posting's text is shuffled once and never with a pair
    wanted = title_matches(requests, jobs).join(requests, "query_id")
    keys = ["query_id", "title_norm"] if "query_id" in jobs.columns else ["title_norm"]
    return match_explanations(score_postings(jobs.join(wanted, keys)))


def relevance_filter(scored: DataFrame, min_score: float = fixed.MIN_RELEVANCE) -> DataFrame:
    """Add ``drop_reason``: 'irrelevant' below the display threshold."""
    return scored.withColumn("drop_reason", F.when(F.col("score") < min_score, F.lit("irrelevant")))


def topk_relevant(scored: DataFrame, cap: int = fixed.MAX_RESULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(best matches per request, count left over per request).

    A request keeps as many as its own ``limit``, which no request may set above
    ``cap``; equal scores keep arrival order.
    """
    matching = scored.filter(F.col("score") >= fixed.MIN_RELEVANCE)
    best = first_k(matching, ["query_id"], [F.col("score").desc(), F.col("ord")], cap, rank="match_rank")
    best = best.filter(F.col("match_rank") <= F.least(F.col("limit"), F.lit(cap)))
    overflow = (
        matching.groupBy("query_id")
        .agg(F.count("*").alias("matching"), F.first("limit").alias("limit"))
        .select("query_id", F.greatest(F.col("matching") - F.least("limit", F.lit(cap)), F.lit(0)).alias("left_over"))
    )
    return best, overflow


# --- the best matches, by bounds ------------------------------------------------------

PROFILE = ["title_norm", "location_norm", "says_remote", "is_remote", "low", "high"]


def _digest(*values) -> Column:
    """16 bytes that stand for the values; they ride with every pair, where 64 hexadecimal digits would be most of it."""
    return F.unhex(F.left(F.sha2(F.to_json(F.struct(*values)), 256), F.lit(32)))


def posting_profiles(postings: DataFrame) -> DataFrame:
    """ord, company_key, the columns of PROFILE and ``profile``, which names their values; no text.

    Postings that carry a ``query_id`` keep it, and it is part of the profile.
    """
    own = ["query_id"] if "query_id" in postings.columns else []
    need = ex.parse_experience(F.concat(F.col("title"), F.lit(". "), F.coalesce("description", F.lit(""))))
    bounds = ex.experience_bounds(need)
    facts = postings.select(
        *own, "ord", tx.normalize_company_name(F.col("company_name")).alias("company_key"),
        tx.basic_normalize(F.col("title")).alias("title_norm"), tx.basic_normalize(F.col("location")).alias("location_norm"),
        F.contains(F.lower(F.coalesce("location", F.lit(""))), F.lit("remote")).alias("says_remote"), "is_remote",
        bounds["low"].alias("low"), bounds["high"].alias("high"),
    )
    return facts.withColumn("profile", _digest(*own, *PROFILE))


def _bounded_pairs(requests: DataFrame, facts: DataFrame, min_score: float) -> DataFrame:
    """Requests with the profiles that may reach ``min_score``: ratios, rows, least and greatest possible score."""
    own = ["query_id"] if "query_id" in facts.columns else []
    profiles = facts.groupBy("profile", *own, *PROFILE).agg(F.count("*").alias("rows"))
    slim = requests.select(
        "query_id", "locations", "remote_only", "w_places", "w_countries", "w_experience",
        (F.size("keywords") > 0).alias("_kw"), (F.size("industries") > 0).alias("_ind"),
        (F.size("companies") > 0).alias("_comp"), (F.size("w_exclusions") > 0).alias("_excl"),
    )
    if own:
        matched = title_matches(requests, facts)
    else:
        # a request that names companies is gated elsewhere, so it meets the titles of theirs only
        names = requests.filter(F.size("companies") > 0)
        theirs = facts.join(names.select("query_id", F.explode(F.array_distinct("w_companies")).alias("company_key")), "company_key")
        matched = title_matches(requests.filter(F.size("companies") == 0), facts).unionByName(title_matches(names, theirs))
    wanted = matched.join(slim, "query_id")
    pairs = profiles.join(wanted, [*own, "title_norm"])
    # what the score functions read: a place that says "remote" or not, and bounds in place of the text they came from
    pairs = pairs.withColumns(
        {
            "location": F.when(F.col("says_remote"), F.lit("remote")),
            "experience": F.struct(
                F.col("low").alias("min_years"), F.col("high").alias("max_years"),
                F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("text"),
            ),
        }
    )
    pairs = experience_score(location_score(pairs)).select(
        "query_id", "profile", "rows", "title_match", F.col("title_match.score").alias("r_title"),
        F.col("location_match.score").alias("r_location"), F.col("experience_match.score").alias("r_experience"),
        "_kw", "_ind", "_comp", "_excl",
    )

    def bound(text: float) -> Column:
        open_ratio = {"_kw": "keywords", "_ind": "industry", "_comp": "company"}
        ratios = {n: F.col(f"r_{n}") for n in ("title", "location", "experience")}
        return _total(ratios | {name: F.when(F.col(flag), F.lit(text)).otherwise(F.lit(1.0)) for flag, name in open_ratio.items()})

    gated = (F.col("r_location") <= 0) | (F.col("r_experience") <= 0)
    least = F.when(F.col("_comp") | F.col("_excl"), F.lit(0.0)).otherwise(bound(0.0))
    return pairs.filter(~gated).withColumns({"least": least, "most": bound(1.0)}).filter(F.col("most") >= min_score)


def _resolved(pairs: DataFrame, requests: DataFrame, postings: DataFrame) -> DataFrame:
    """``score`` of pairs of a request and a posting (query_id, ord, company_key, ratios).

    Each (posting, term) that some pair asks for is looked up once, in the posting's
    text; what travels with pairs is terms and hits.
    """
    own = ["query_id"] if "query_id" in postings.columns else []
    blob = prepare_postings(postings).select(*own, "ord", "blob")

    def terms(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), v.alias("term")))

    norms = [("keyword", F.transform("w_keywords", lambda k: k["norm"])), ("industry", F.col("w_terms")), ("banned", F.transform("w_exclusions", lambda k: k["norm"]))]
    asked = requests.select("query_id", F.explode(F.concat(*[terms(k, v) for k, v in norms])).alias("t")).select("query_id", "t.*").filter("term <> ''")
    wanted = pairs.select("query_id", "ord").join(asked, "query_id")
    found = wanted.select(*own, "ord", "term").distinct().join(blob, [*own, "ord"]).filter(F.contains("blob", "term")).select(*own, "ord", "term")
    hits = wanted.join(found, [*own, "ord", "term"]).groupBy("query_id", "ord").agg(
        F.count_if(F.col("kind") == "keyword").alias("n_keyword"), F.count_if(F.col("kind") == "industry").alias("n_industry"),
        F.count_if(F.col("kind") == "banned").alias("n_banned"),
    )
    sizes = requests.select("query_id", F.size("keywords").alias("_keywords"), "w_companies")
    full = pairs.join(sizes, "query_id").join(hits, ["query_id", "ord"], "left").na.fill(0, ["n_keyword", "n_industry", "n_banned"])
    ratios = {n: F.col(f"r_{n}") for n in ("title", "location", "experience")}
    ratios["keywords"] = F.when(F.col("_keywords") == 0, F.lit(1.0)).otherwise(F.col("n_keyword") / F.col("_keywords"))
    ratios["company"] = F.when(~F.col("_comp") | F.array_contains("w_companies", F.col("company_key")), F.lit(1.0)).otherwise(F.lit(0.0))
    ratios["industry"] = F.when(~F.col("_ind") | (F.col("n_industry") > 0), F.lit(1.0)).otherwise(F.lit(0.0))
    score = _total(ratios)
    score = F.when(F.col("n_banned") > 0, F.lit(0.0)).when(F.col("_comp") & (ratios["company"] <= 0), F.least(score, F.lit(fixed.GATE_SCORE))).otherwise(score)
    return full.select("query_id", "ord", "title_match", "least", score.alias("score"))


def _search_units(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units in the shape of requests, members: query_id, unit).

    A unit is one wanted title with its variants under one set of all other criteria; requests
    that agree in these share it. Its name stands in ``query_id``.
    """
    criteria = ["locations", "companies", "industries", "keywords", "exclusions", "w_experience", "remote_only", "w_places", "w_countries"]
    pieces = requests.withColumn("w_titles", F.explode(F.transform("titles", lambda t: _spelled(places.search_titles(F.array(t))))))
    norms = F.array_sort(F.array_distinct(F.transform("w_titles", lambda w: w["norm"])))
    pieces = pieces.withColumn("unit", _digest(norms.alias("norms"), *criteria))
    units = pieces.drop("query_id").dropDuplicates(["unit"]).withColumnRenamed("unit", "query_id")
    return units, pieces.select("query_id", "unit").distinct()


def _united(members: DataFrame, counts: DataFrame, sure: DataFrame, late: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, matching: the postings that any unit of a request matches.

    ``counts`` is (unit, matching); what a unit matches is in ``sure`` (unit, profile) and
    ``late`` (unit, ord). A request's largest unit is counted as it is, the rows of its others
    are looked up there and only those it does not match are added.
    """
    counted = members.join(counts, "unit")
    largest = counted.groupBy("query_id").agg(F.max(F.struct("matching", "unit")).alias("_l")).select("query_id", "_l.matching", F.col("_l.unit").alias("base"))
    rest = counted.join(largest.select("query_id", "base"), "query_id").filter("unit <> base").select("query_id", "unit", "base")
    small, rows = rest.select("unit").distinct(), facts.select("profile", "ord")
    matched = sure.join(small, "unit", "left_semi").join(rows, "profile").unionByName(late.join(small, "unit", "left_semi").join(rows, "ord"))
    extra = rest.join(matched, "unit").select("query_id", "base", "profile", "ord").distinct()
    extra = extra.join(sure.withColumnRenamed("unit", "base"), ["base", "profile"], "left_anti").join(
        late.withColumnRenamed("unit", "base"), ["base", "ord"], "left_anti"
    )
    added = extra.groupBy("query_id").agg(F.count("*").alias("added"))
    return largest.join(added, "query_id", "left").select("query_id", (F.col("matching") + F.coalesce("added", F.lit(0))).alias("matching"))


def best_matches(
    queries: DataFrame, postings: DataFrame, cap: int = fixed.MAX_RESULT_LIMIT, min_score: float = fixed.MIN_RELEVANCE,
    places_table: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(best matches per request, scored and explained; matching and left_over per request).

    The same rows as ``topk_relevant`` over all pairs. Postings alike in title, place
    and experience are one profile. A profile's title, place and experience ratios are
    exact; keywords, industry, companies and exclusions leave a range between the least
    and the greatest score. A request visits profiles by descending bound until the
    least scores of those it has seen fill its limit; what cannot pass these is counted
    (all of it matches, or none) and not joined. Scores have one decimal, so a request's
    bounds are a histogram of at most a thousand values, not a sort of its candidates.

    Requests are searched as units of one wanted title and all other criteria, each once
    however many requests share it: a request's score is the best of its units', so its best
    rows are among theirs. Postings that carry a ``query_id`` are searched request by request.

    ``ord`` must be unique (per ``query_id`` where postings carry one), and ``min_score``
    above the cap of contradicted pairs.
    """
    if min_score <= fixed.GATE_SCORE:
        raise ValueError("gated pairs would match: use match_queries_to_postings")
    # both are read several times below; written once, they also keep the plans of the steps small
    requests = checkpoint(prepare_requests(queries, places_table))
    own = ["query_id"] if "query_id" in postings.columns else []
    facts = checkpoint(posting_profiles(postings))
    limits = queries.select("query_id", F.least("limit", F.lit(cap)).alias("_k"))
    if own:
        asked, most_wanted = requests, limits
    else:
        asked, members = _search_units(requests)
        most_wanted = members.join(limits, "query_id").groupBy(F.col("unit").alias("query_id")).agg(F.max("_k").alias("_k"))
    pairs = checkpoint(_bounded_pairs(asked, facts, min_score))

    sure = pairs.filter(F.col("least") >= min_score)
    down = Window.partitionBy("query_id").orderBy(F.desc("least"))
    filled = sure.groupBy("query_id", "least").agg(F.sum("rows").alias("rows")).withColumn("seen", F.sum("rows").over(down))
    filled = filled.join(most_wanted, "query_id").filter(F.col("seen") >= F.col("_k"))
    floors = filled.groupBy("query_id").agg(F.max("least").alias("_floor"))
    floor = F.coalesce("_floor", F.lit(min_score))
    unsure = F.col("least") < min_score
    visited = pairs.join(floors, "query_id", "left").filter((F.col("most") >= floor) | unsure).drop("rows", "_floor")
    rows = visited.join(facts.select(*own, "profile", "ord", "company_key"), [*own, "profile"])
    scored = checkpoint(_resolved(rows, asked, postings).filter(F.col("score") >= min_score))

    def leading(found: DataFrame, wanted: DataFrame) -> DataFrame:
        first = first_k(found.join(wanted, "query_id"), ["query_id"], [F.col("score").desc(), F.col("ord")], cap, rank="match_rank")
        return first.filter(F.col("match_rank") <= F.col("_k")).drop("_k")

    best = leading(scored.select("query_id", "ord", "score"), most_wanted)
    # what every visited pair with a doubtful bound came to, and all others by their profiles
    late = scored.filter(unsure)
    early_rows = sure.groupBy("query_id").agg(F.sum("rows").alias("early"))
    late_rows = late.groupBy("query_id").agg(F.count("*").alias("late"))
    matching = (F.coalesce("early", F.lit(0)) + F.coalesce("late", F.lit(0))).cast("long").alias("matching")
    counts = early_rows.join(late_rows, "query_id", "full").select("query_id", matching)
    if not own:
        named = {"query_id": "unit"}
        found = members.join(best.withColumnsRenamed(named), "unit").groupBy("query_id", "ord").agg(F.max("score").alias("score"))
        best = leading(found, limits)
        sure, late = (x.withColumnsRenamed(named) for x in (sure.select("query_id", "profile"), late.select("query_id", "ord")))
        counts = _united(members, counts.withColumnsRenamed(named), sure, late, facts)
    left_over = F.greatest(F.col("matching") - F.col("_k"), F.lit(0)).alias("left_over")
    overflow = counts.join(limits, "query_id").select("query_id", "matching", left_over)
    best = best.select("query_id", "ord", "match_rank")
    fetched = postings.join(best, [*own, "ord"]) if own else best.join(postings, "ord")
    fetched = title_score(prepare_postings(fetched).join(requests, "query_id"))
    return match_explanations(score_postings(fetched)), overflow


# --- values of every pair, by groups ---------------------------------------------------

BULK = 1000  # rows of postings from which a wanted title is met in bulk
MEMBERS = 1000  # requests in one list of a group
LISTS = 64  # lists that one row carries
CRITERIA = [
    "locations", "companies", "industries", "keywords", "exclusions", "remote_only", "w_places", "w_countries",
    "w_experience", "w_keywords", "w_exclusions", "w_companies", "w_terms",
]


def pair_values(
    queries: DataFrame, postings: DataFrame, values: dict[str, Column], key: str = "posting_id", places_table: DataFrame | None = None,
) -> DataFrame:
    """query_id, ``key`` and named values of every pair of ``match_queries_to_postings``.

    Values are expressions over the columns of ``score_postings``. Nothing else of a pair is
    formed: requests that share their criteria are one group where many postings resemble their
    titles. A posting's other ratios are found once per group, its title's once per set of
    wanted titles there, and only ids and values are spread over requests, in the task that
    scored. Other wanted titles are met pair by pair.

    A request may want titles of both kinds: pairs that one of the others forms are scored by
    all its titles there and taken out of its group. Words are dealt over tasks by the pairs
    they form. ``query_id`` is unique, and postings carry none.
    """
    requests, jobs = prepare_requests(queries, places_table), prepare_postings(postings)
    requests = checkpoint(requests.select("query_id", "w_titles", *CRITERIA))
    titles = checkpoint(jobs.groupBy("title_norm").agg(F.count("*").alias("rows")).filter("title_norm <> ''"))
    asked = requests.select("query_id", F.explode("w_titles.norm").alias("wanted")).filter("wanted <> ''").distinct()
    want = asked.select("wanted").distinct()

    # wanted titles of frequent words; those of the rest whose pairs turn out to be many
    words = want.select("wanted", F.explode(tx.token_set_of(F.col("wanted"))).alias("k"))
    frequent = titles.select("rows", F.explode(tx.token_set_of(F.col("title_norm"))).alias("k")).groupBy("k").agg(F.sum("rows").alias("rows"))
    worded = checkpoint(words.join(frequent, "k"))
    by_words = worded.groupBy("wanted").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= BULK).select("wanted")
    pairs = _contained(titles, want).unionByName(_sharing_words(titles, want.join(by_words, "wanted", "left_anti"))).distinct()
    pairs = checkpoint(pairs.join(titles, "title_norm"))
    many = pairs.groupBy("wanted").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= BULK)
    bulk = checkpoint(by_words.unionByName(many.select("wanted")).distinct())
    in_bulk = asked.join(bulk, "wanted", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("wanted")).alias("bulk"))
    requests = checkpoint(requests.join(in_bulk, "query_id", "left"))

    # other titles, pair by pair
    single = asked.join(bulk, "wanted", "left_anti").join(pairs, "wanted").filter(
        title_similarity(F.col("title_norm"), F.col("wanted")) >= fixed.MIN_TITLE_SIMILARITY
    )
    found = checkpoint(single.select("query_id", "title_norm").distinct())
    plain = score_postings(title_score(jobs.join(found.join(requests, "query_id"), "title_norm")))
    named = [v.alias(name) for name, v in values.items()]
    plain = plain.select("query_id", key, *named)

    # keys by which a group finds titles: words, and the pairs at hand
    by_word = worded.join(by_words, "wanted", "left_semi").select("wanted", F.concat(F.lit("w"), "k").alias("k"), "rows")
    at_hand = pairs.join(bulk, "wanted", "left_semi").select("title_norm", F.concat(F.lit("p"), "wanted").alias("k"), "wanted", "rows")
    keys = by_word.unionByName(at_hand.groupBy("wanted", "k").agg(F.sum("rows").alias("rows")).select("wanted", "k", "rows"))
    groups = checkpoint(_request_groups(requests.filter("bulk IS NOT NULL")))
    led = groups.select("unit", "bulk", "asked").distinct().select("unit", "asked", F.explode("bulk").alias("wanted")).join(keys, "wanted")
    # the most frequent key comes first; a pair is formed at the first key that it has
    led = led.groupBy("unit", "asked").agg(F.sort_array(F.collect_set(F.struct("rows", "k")), asc=False).alias("_keys"))
    led = led.select("unit", "asked", "_keys", F.posexplode("_keys").alias("_i", "_key")).select(
        "unit", "asked", "_key.k", "_key.rows", F.slice("_keys.k", F.lit(1), F.col("_i")).alias("earlier")
    )
    led = checkpoint(led)
    tasks = 8 * queries.sparkSession.sparkContext.defaultParallelism
    work = led.groupBy("k").agg((F.max("rows") * F.sum("asked")).cast("double").alias("work"))
    slices = checkpoint(
        work.crossJoin(work.agg(F.sum("work").alias("_all"))).select("k", F.ceil(F.col("work") / F.col("_all") * (8 * tasks)).cast("int").alias("slices"))
    )

    held = titles.select("title_norm", F.explode(F.transform(tx.token_set_of(F.col("title_norm")), lambda w: F.concat(F.lit("w"), w))).alias("k"))
    held = held.unionByName(at_hand.select("title_norm", "k")).join(slices, "k")
    held = held.groupBy("title_norm").agg(F.collect_set(F.struct("k", "slices")).alias("_keys"))
    apart = found.join(requests.filter("bulk IS NOT NULL").select("query_id"), "query_id", "left_semi")
    held = held.join(apart.groupBy("title_norm").agg(F.collect_set("query_id").alias("apart")), "title_norm", "left")
    left = jobs.join(held, "title_norm").withColumn("have", tx.token_set_of(F.col("title_norm")))
    left = left.select("*", F.explode("_keys").alias("_key")).withColumns(
        {"k": F.col("_key.k"), "slice": F.pmod(F.xxhash64(key), F.col("_key.slices")).cast("int"), "_keys": F.col("_keys.k")}
    ).drop("_key")
    lists = led.select("unit", "k", "earlier").join(groups.drop("asked"), "unit")
    counted = lists.groupBy("k", "group").agg(F.ceil(F.count("*") / LISTS).alias("_rows"))
    right = lists.join(counted, ["k", "group"]).withColumn("part", F.pmod(F.xxhash64("unit", "part"), "_rows")).groupBy("k", "group", "part").agg(
        F.first(F.struct(*CRITERIA)).alias("_g"), F.collect_list(F.struct("wants", "earlier", "members")).alias("lists")
    ).select("k", "_g.*", "lists").join(slices, "k")
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    at = ["k", "slice"]
    met = _criteria(left.repartition(tasks, *at).join(right.repartition(tasks, *at), at))
    met = met.select("*", F.explode("lists").alias("_list")).drop("lists").select("*", "_list.*").drop("_list")
    met = met.filter((F.size("earlier") == 0) | ~F.arrays_overlap("_keys", "earlier"))
    met = met.withColumn("title_match", F.struct(_group_title_score().alias("score")))
    met = _weighed(met.filter(F.col("title_match.score") >= fixed.MIN_TITLE_SIMILARITY))
    rest = F.when(F.col("apart").isNull() | ~F.arrays_overlap("apart", "members"), F.col("members")).otherwise(
        F.filter("members", lambda q: ~F.array_contains("apart", q))
    )
    met = met.select(key, *named, rest.alias("members"))
    return plain.unionByName(met.select(F.explode("members").alias("query_id"), key, *values))


def _request_groups(requests: DataFrame) -> DataFrame:
    """Lists of some MEMBERS requests alike in criteria and bulk titles: group (the criteria), unit (with the titles), part, asked (of the unit), wants, members."""
    alike = requests.withColumn("group", F.sha2(F.to_json(F.struct(*CRITERIA)), 256))
    alike = alike.withColumn("unit", F.sha2(F.to_json(F.struct("group", "bulk")), 256))
    sizes = alike.groupBy("unit").agg(F.count("*").alias("asked"))
    dealt = alike.join(sizes, "unit").withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asked") / MEMBERS)))
    grouped = dealt.groupBy("group", "unit", "part").agg(
        F.first(F.struct("asked", "bulk", *CRITERIA)).alias("_g"), F.collect_list("query_id").alias("members")
    )
    wants = F.transform("bulk", lambda w: F.struct(w.alias("norm"), tx.token_set_of(w).alias("want")))
    return grouped.select("group", "unit", "part", "_g.*", "members").withColumn("wants", wants)


def _group_title_score() -> Column:
    """``title_similarity`` of ``title_norm`` (words in ``have``) and the best of ``wants``."""

    def one(w: Column) -> Column:
        shared = F.size(F.array_intersect("have", w["want"]))
        union = F.size(w["want"]) + F.size("have") - shared
        mixed = F.lit(0.75) * shared / F.size(w["want"]) + F.lit(0.25) * shared / union
        return F.when(F.col("title_norm") == w["norm"], F.lit(1.0)).when(F.contains("title_norm", w["norm"]), F.lit(0.9)).when(
            F.size(w["want"]) == 0, F.lit(0.0)
        ).otherwise(mixed)

    return F.when(F.size("wants") == 1, one(F.get("wants", 0))).otherwise(F.array_max(F.transform("wants", one)))


# --- joins on one criterion ----------------------------------------------------------


def alias_containment_join(left: DataFrame, aliases: DataFrame, text_col: str) -> DataFrame:
    """Rows of ``left`` with each place (display) whose alias stands in the text as whole words.

    Phrases of one to three words of the text are joined on equality, so no row
    is compared with every alias.
    """
    words = tx.tokens(tx.basic_normalize(F.col(text_col)))

    def phrases(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))

    split = left.withColumn("_w", words)
    rows = split.select("*", F.explode(F.array_distinct(F.concat(phrases(1), phrases(2), phrases(3)))).alias("alias"))
    hits = rows.filter("alias <> ''").join(aliases, "alias")
    return hits.drop("_w", "alias").distinct()


def experience_overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of different closed year ranges that meet: low, high, low_b, high_b, left_rows, right_rows.

    Both sides have (id, low, high), NULL bounds for unknown, which never
    match. Rows of equal bounds are one range with its number of rows, so no
    pairs of rows are formed; a row belongs to the range of its own bounds.
    """

    def ranges(side: DataFrame, low: str, high: str, rows: str) -> DataFrame:
        known = side.filter("low IS NOT NULL AND high IS NOT NULL")
        counted = known.groupBy(F.col("low").alias(low), F.col("high").alias(high)).agg(F.count("*").alias(rows))
        years = F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))
        return counted.select("*", F.explode(years).alias("year"))

    a, b = ranges(left, "low", "high", "left_rows"), ranges(right, "low_b", "high_b", "right_rows")
    return a.join(b, "year").filter("low <= high_b AND low_b <= high").drop("year").distinct()


def company_equi_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Join two tables on the normalised company name, kept as ``company_key``."""
    a = left.withColumn("company_key", tx.normalize_company_name(F.col(left_name)))
    b = right.withColumn("company_key", tx.normalize_company_name(F.col(right_name)))
    return a.join(b, "company_key")
