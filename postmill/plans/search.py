"""The whole search as one plan over tables of requests and landed postings.

    clean -> two-key dedupe -> title block and score -> top k -> check against
    fetched pages -> final-address dedupe -> library, contacts, counters

Checking comes after scoring and the result limit, so the fetched pages are
joined with a few rows per request only. Rows are tagged with why they were
dropped and counted; nothing disappears silently. The few stage boundaries
that are reused are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx
from postmill.functions import urls
from postmill.operators import contacts as con
from postmill.operators import dedupe, frontier, library, relevance, store, tracker, validation
from postmill.plans.skew import first_per_key
from postmill.session import checkpoint
from postmill.sources import intake

STORE_SCHEMAS = {
    "jobs": (
        "user_id bigint, canonical_url string, job_id bigint, query_id bigint, fingerprint string, job_url string, "
        "title string, normalized_title string, company_name string, company_key string, location string, "
        "normalized_location string, is_remote boolean, description string, summary string, source string, "
        "posted_at timestamp_ntz, experience_text string, min_years double, max_years double, "
        "discovered_at timestamp_ntz, last_seen_at timestamp_ntz, validated_at timestamp_ntz, http_status int, "
        "final_url string, is_saved boolean, is_dismissed boolean, validation_status string, validation_reason string, "
        "relevance_score double, match_reasons array<string>, validation_checks map<string,string>, relevance_breakdown map<string,struct<score:double,max:double,ratio:double>>, "
        "board_token string, employment_type string, department string, salary_text string, apply_url string, "
        "source_query_url string, external_id string, payload map<string,string>"
    ),
    "companies": (
        "normalized_name string, name string, domain string, careers_url string, contacts_checked_at timestamp_ntz"
    ),
    "contacts": (
        "company_key string, dedupe_key string, contact_id bigint, company_name string, role string, name string, "
        "title string, email string, email_status string, profile_url string, search_url string, source string, "
        "source_url string, source_excerpt string, confidence double, is_archived boolean, "
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    ),
    "job_contacts": "job_id bigint, contact_id bigint, rank int, relevance double, rationale string",
}


def empty_stores(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STORE_SCHEMAS.items()}


#: What a source says about a posting that the library keeps beside what it is matched by.
CARRIED = ["external_id", "apply_url", "employment_type", "department", "salary_text", "source_query_url", "payload"]


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like``, by name, in its order and types."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def collect_postings(raw_jobs: DataFrame) -> DataFrame:
    """Cleaned postings with their keys and place in the order of arrival.

    ``ord`` is a total order: employer boards first, then source, then place in
    the response. Columns of the posting shape that a source lacks are NULL.
    """
    kinds = {c: "map<string,string>" if c == "payload" else "string" for c in CARRIED}
    raw_jobs = raw_jobs.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in raw_jobs.columns})
    keyed = dedupe.posting_keys(intake.tag_incomplete(raw_jobs))
    keyed = keyed.withColumn("company_key", tx.normalize_company_name(F.col("company_name")))
    return keyed.withColumn("ord", F.struct("source_rank", "provider_ord", "item_ord", "url"))


def attach_contacts(
    jobs: DataFrame, companies: DataFrame, contacts: DataFrame, links: DataFrame, pages: DataFrame, hints: DataFrame,
    as_of: Column, budget: int = 10,
) -> dict[str, DataFrame]:
    """Find contacts once per company and link the best six to each of its jobs.

    A company checked within the cache time is served from the store, one past
    the search's budget keeps what it has. ``hints`` is (query_id, role_hint).
    Returns the new contacts, companies and links and, per search, the number
    of people found.
    """
    cached = con.contact_cache_split(
        companies.withColumnRenamed("normalized_name", "company_key"), contacts, as_of
    ).select("company_key", "cached")
    seen = jobs.join(cached, "company_key", "left").select(
        F.col("query_id").alias("search_id"), F.col("company_key").alias("company"), "ord",
        F.coalesce("cached", F.lit(False)).alias("cached"),
    )
    plan = frontier.crawl_company_budget(seen, budget)
    crawl = plan.filter("decision = 'crawl'").groupBy("company").agg(F.min("search_id").alias("query_id"))
    sample = first_per_key(
        jobs.join(crawl.select(F.col("company").alias("company_key"), "query_id"), ["company_key", "query_id"]).select(
            "company_key", "ord", F.coalesce(F.nullif("final_url", F.lit("")), F.col("job_url")).alias("posting_url"),
            "description",
        ),
        ["company_key"], [F.col("ord")],
    )
    known = (
        crawl.join(hints, "query_id", "left")
        .join(companies, F.col("company") == F.col("normalized_name"))
        .select(
            F.col("company").alias("company_key"), F.col("name").alias("company_name"),
            F.col("domain").alias("company_domain"), "careers_url", "role_hint",
        )
    )
    found = con.discover_contacts(known, sample, pages)
    found = found.withColumn("contact_id", F.xxhash64("company_key", "dedupe_key"))
    new_contacts = checkpoint(_conform(store.upsert_contacts(contacts, found, as_of), contacts))

    live = new_contacts.filter(~F.col("is_archived"))
    used = jobs.select("company_key").distinct()
    best = con.top_contacts_per_job(jobs.select("job_id", "company_key").distinct(), live.join(used, "company_key", "left_semi"))
    ranked = best.join(con.contact_rationale(live).select("contact_id", "rationale"), "contact_id").drop("relevance")
    new_links = _conform(store.link_job_contacts(links, ranked), links)

    checked = crawl.select(F.col("company").alias("normalized_name"), F.lit(True).alias("_checked"))
    new_companies = companies.join(checked, "normalized_name", "left").withColumn(
        "contacts_checked_at", F.when(F.col("_checked"), as_of).otherwise(F.col("contacts_checked_at"))
    ).drop("_checked")

    people = live.filter(~F.col("role").isin(fixed.IMPERSONAL_ROLES) & F.col("name").isNotNull())
    people = people.groupBy("company_key").agg(F.count("*").alias("people"))
    per_search = plan.select(F.col("search_id").alias("query_id"), F.col("company").alias("company_key")).distinct()
    counts = per_search.join(people, "company_key").groupBy("query_id").agg(F.sum("people").alias("contacts_found"))
    return {"contacts": new_contacts, "companies": new_companies, "job_contacts": new_links, "contact_counts": counts}


def run_search(
    queries: DataFrame, raw_jobs: DataFrame, fetch_log: DataFrame, pages: DataFrame, stores: dict[str, DataFrame],
    as_of: Column, find_contacts: bool = True, source_log: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run a table of requests end to end.

    ``queries`` is in the request schema with ``user_id``. ``raw_jobs`` holds
    what each source returned for each request (query_id, provider_ord,
    item_ord and the posting columns). Returns the next version of every store,
    ``funnel``, one row of counters and status per request, ``runs``, the record of
    each request's run with its sources, errors and notes, and ``intake``, what
    every source brought and how much of it was incomplete, counted while the
    postings were first read. Running the same input again changes nothing but
    the times.
    """
    collected, counts = intake.observe_intake(collect_postings(raw_jobs))
    complete = collected.filter("drop_reason IS NULL").drop("drop_reason")
    marked = checkpoint(
        dedupe.dedupe_two_key(
            complete, "canonical_url", "fingerprint", ["source_rank", "provider_ord", "item_ord", "url"], ["query_id"]
        )
    )
    unique = marked.filter("drop_reason IS NULL").drop("drop_reason", "company_key")

    best, overflow = relevance.best_matches(queries, unique)
    best = checkpoint(
        best.select(
            "query_id", "user_id", "ord", "url", "canonical_url", "fingerprint", "title", "company_name", "company_key",
            "location", "is_remote", "description", "source", "posted_at", "experience",
            "score", "reasons", "breakdown", "match_rank", *CARRIED,
        )
    )
    kept = best.drop("match_rank").withColumnRenamed("reasons", "match_reasons").withColumn(
        "board_token", F.element_at("payload", "board")
    )
    checked = validation.validate_postings(kept, fetch_log, as_of)
    settled = checkpoint(dedupe.dedupe_final_url(checked))
    shown = settled.filter("drop_reason IS NULL")

    # --- library -----------------------------------------------------------------
    first_party = F.col("source").isin(fixed.FIRST_PARTY_SOURCES) & ~tx.is_blank(F.col("source_query_url"))
    platform = F.struct(F.element_at("payload", "platform").alias("platform"), F.col("board_token").alias("token"))
    companies = shown.select(
        F.col("company_name").alias("name"),
        urls.employer_domain(F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))).alias("domain"),
        platform["platform"].alias("platform"), platform["token"].alias("token"), first_party.alias("_own"),
        F.struct("query_id", "ord").alias("ord"),
    )
    companies = intake.board_url_build(companies).withColumn(
        "careers_url", F.when(F.col("_own"), F.col("public_url"))
    )
    new_companies = checkpoint(store.upsert_companies(stores["companies"], companies.select("name", "domain", "careers_url", "ord")))
    rows = store.job_rows(shown.withColumnRenamed("match_reasons", "reasons"), as_of)
    rows = rows.withColumn("job_id", F.xxhash64("user_id", "canonical_url"))
    rows = rows.withColumn("ord", F.struct("query_id", "ord"))
    new_jobs = checkpoint(_conform(store.upsert_jobs(stores["jobs"], rows, as_of), stores["jobs"]))
    out = {"jobs": new_jobs, "companies": new_companies, "contacts": stores["contacts"], "job_contacts": stores["job_contacts"]}

    # --- contacts ----------------------------------------------------------------
    people = queries.select("query_id").withColumn("contacts_found", F.lit(0).cast("bigint"))
    if find_contacts:
        found_jobs = shown.select(
            "query_id", "ord", "company_key", "description", "final_url", F.col("url").alias("job_url"),
            F.xxhash64("user_id", "canonical_url").alias("job_id"),
        )
        hints = queries.select("query_id", con.role_hint(F.col("titles")).alias("role_hint"))
        attached = attach_contacts(
            found_jobs, new_companies, stores["contacts"], stores["job_contacts"], pages, hints, as_of
        )
        people = attached.pop("contact_counts")
        out |= attached

    # --- counters ----------------------------------------------------------------
    found = marked.groupBy("query_id").agg(
        F.count("*").alias("raw_found"), F.count("drop_reason").alias("_repeats")
    )
    lacking = collected.filter("drop_reason IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("incomplete_dropped"))
    relevant = overflow.withColumnRenamed("matching", "_matching")
    ends = settled.groupBy("query_id").agg(
        F.count_if(F.col("drop_reason") == "duplicate").alias("_late_repeats"),
        F.count_if(F.col("drop_reason") == "rejected").alias("rejected"),
        F.count_if(F.col("drop_reason").isNull() & (F.col("status") == "UNVERIFIED")).alias("unverified"),
        F.count_if(F.col("drop_reason").isNull() & (F.col("status") != "UNVERIFIED")).alias("validated"),
    )
    joined = queries.select("query_id")
    for part in (found, lacking, relevant, ends, people):
        joined = joined.join(part, "query_id", "left")
    joined = joined.na.fill(0)
    funnel = joined.select(
        "query_id", "raw_found", (F.col("_repeats") + F.col("_late_repeats")).alias("duplicates_dropped"),
        (F.col("raw_found") - F.col("_repeats") - F.col("_matching")).alias("irrelevant_dropped"),
        "validated", "unverified", "rejected", "contacts_found", "left_over", "incomplete_dropped",
    )
    if source_log is not None:
        funnel = tracker.run_status(funnel, source_log)
        out["runs"] = tracker.run_rows(funnel, queries.select("query_id", "user_id"), source_log, as_of)
    rows = [(s, counts.get[f"{s}_rows"], counts.get[f"{s}_incomplete"]) for s in intake.OBSERVED]
    seen = queries.sparkSession.createDataFrame(rows, "source string, rows bigint, incomplete bigint").filter("rows > 0")
    return out | {"funnel": funnel, "intake": seen}


def dashboard(stores: dict[str, DataFrame], as_of: Column, limit: int = 8) -> dict[str, DataFrame]:
    """Everything the dashboard shows: counts, pipeline, recent jobs, due follow-ups, last search."""
    jobs, apps = stores["jobs"], stores["applications"]
    return {
        "counts": tracker.dashboard_counts(jobs, apps, as_of),
        "pipeline": tracker.pipeline_breakdown(apps),
        "recent_jobs": library.recent_jobs(jobs, limit),
        "due_follow_ups": tracker.follow_ups_due(apps, as_of, limit),
        "last_search": tracker.last_search_summary(tracker.latest_run(stores["searches"], stores["runs"])),
    }
