"""Deciding from fetched pages whether a posting may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import dates, html, urls
from postmill.functions import text as tx

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"


def page_facts(fetch_log: DataFrame) -> DataFrame:
    """What a fetched page says, read once per page.

    Input: url, final_url, status, html, blocked_reason, error. Adds what it says of a
    role that is closed, whether it lists many, the employers and end dates its posting
    records name, how many records there are, and the normalised page text and its words;
    these two are NULL where the page's records or phrases decide without them.
    Postings of one address share all this; none reads the page again.
    """
    blocks = F.filter(html.jsonld_blocks(F.coalesce("html", F.lit(""))), lambda b: html.has_type(b, "JobPosting"))
    read = fetch_log.withColumn("_blocks", blocks)
    employers = F.filter(F.transform("_blocks", html.hiring_organization), lambda v: v.isNotNull())
    ends = F.filter(
        F.transform("_blocks", lambda b: dates.parse_datetime(html.text_of(b, "validThrough"))),
        lambda v: v.isNotNull(),
    )
    read = read.withColumns(
        {
            "employers": F.transform(employers, lambda v: F.struct(v.alias("name"), tx.company_tokens(v).alias("tokens"))),
            "ends": ends, "records": F.size("_blocks"), "_text": html.html_to_text(F.col("html")),
        }
    )
    lowered = F.lower("_text")
    phrase = F.lit(None).cast("string")
    for closed in reversed(fixed.CLOSED_PHRASES):
        phrase = F.when(F.contains(lowered, F.lit(closed)), F.lit(closed)).otherwise(phrase)
    read = read.withColumns({"closed_phrase": phrase, "is_listing": lowered.rlike("|".join(fixed.LISTING_HINTS))})
    # the text is asked for the company if no employer is recognisable, for the title if nothing says open or closed
    unnamed = ~F.exists("employers", lambda e: F.size(e["tokens"]) > 0)
    undecided = F.col("closed_phrase").isNull() & (F.col("records") == 0)
    read = read.withColumns({"_undecided": undecided, "page_norm": F.when(unnamed | undecided, tx.basic_normalize(F.col("_text")))})
    return read.select(
        "url", "final_url", "status", "blocked_reason", "error", "page_norm",
        F.when(F.col("_undecided"), tx.token_set_of(F.col("page_norm"))).alias("page_words"),
        "closed_phrase", "is_listing", "records", "employers", "ends",
    )


def _check(outcome: str, reason, extra: Column) -> Column:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(outcome).alias("outcome"), text.alias("reason"), extra.alias("found"))


def company_check(joined: DataFrame) -> DataFrame:
    """Add ``company_result`` (outcome, reason, found): does the page belong to the company?"""
    own = tx.company_tokens(F.col("company_name"))
    final, name = F.lower(F.coalesce("final_url", F.lit(""))), F.col("company_name")
    none = F.lit(None).cast("string")
    joined = joined.withColumns(
        {
            "_own": own,
            # The first record that names a recognisable employer decides.
            "_named": F.get(F.filter("employers", lambda e: F.size(e["tokens"]) > 0), 0),
        }
    )
    own, named = F.col("_own"), F.col("_named")
    recognisable = F.size(own) > 0
    board = ~tx.is_blank(F.col("board_token")) & urls.board_host_matches(final, F.col("board_token"))
    result = (
        F.when(
            F.coalesce(board, F.lit(False)),
            _check(PASS, F.concat(F.lit("Served from "), name, F.lit("'s own applicant-tracking board")), name),
        )
        .when(
            recognisable & named.isNotNull() & F.arrays_overlap(own, named["tokens"]),
            _check(
                PASS,
                F.concat(F.lit("Page's structured data names the employer as “"), named["name"], F.lit("”")),
                named["name"],
            ),
        )
        .when(
            recognisable & named.isNotNull(),
            _check(
                FAIL,
                F.concat(
                    F.lit("Page's structured data names “"), named["name"], F.lit("”, not “"), name, F.lit("”")
                ),
                named["name"],
            ),
        )
        .when(
            F.exists(own, lambda t: F.contains(final, t)),
            _check(PASS, "Company name appears in the posting URL", none),
        )
        .when(
            F.exists(own, lambda t: F.contains(F.col("page_norm"), t)),
            _check(PASS, "Company name appears on the posting page", none),
        )
        .otherwise(_check(UNKNOWN, "Could not find the company named on the page", none))
    )
    return joined.withColumn("company_result", result).drop("_own", "_named")


def active_check(joined: DataFrame, as_of: Column) -> DataFrame:
    """Add ``active_result`` (outcome, reason, found): is the role still open?"""
    now, none = as_of.cast("timestamp"), F.lit(None).cast("timestamp")
    title_words = F.filter(tx.token_set(F.col("title")), lambda t: F.length(t) > 3)
    joined = joined.withColumns(
        {
            "_past": F.get(F.filter("ends", lambda e: e < now), 0),
            "_last": F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1),
            "_hit": F.size(F.array_intersect(title_words, F.col("page_words"))) / F.nullif(F.size(title_words), F.lit(0)),
        }
    )
    closed, past = F.col("closed_phrase"), F.col("_past")
    result = (
        F.when(closed.isNotNull(), _check(FAIL, F.concat(F.lit("The page says: “"), closed, F.lit("”")), none))
        .when(
            past.isNotNull(),
            _check(
                FAIL,
                F.concat(
                    F.lit("The posting's own validThrough date passed on "), F.date_format(past, "dd MMM yyyy")
                ),
                past,
            ),
        )
        .when(
            F.col("records") > 0,
            _check(PASS, "Page still publishes a live JobPosting record", F.col("_last")),
        )
        .when(
            (F.col("_hit") >= 0.6) & F.col("is_listing"),
            _check(UNKNOWN, "The link resolved to a general listings page rather than this role", none),
        )
        .when(F.col("_hit") >= 0.6, _check(PASS, "The role's title still appears on the page", none))
        .otherwise(_check(UNKNOWN, "The page did not confirm the role is still open", none))
    )
    return joined.withColumn("active_result", result).drop("_past", "_last", "_hit")


def validate_postings(postings: DataFrame, fetch_log: DataFrame, as_of: Column) -> DataFrame:
    """Add status, reason, checks, http_status, final_url, posting_company, valid_through.

    ``postings`` has url, title, company_name, source and optionally
    board_token; ``fetch_log`` has one row per address. An address without a
    row counts as a network error.
    """
    if "board_token" not in postings.columns:
        postings = postings.withColumn("board_token", F.lit(None).cast("string"))
    # Only pages of these postings are read; the log may hold far more of them.
    wanted = fetch_log.join(postings.select("url").distinct(), "url", "left_semi")
    joined = postings.join(page_facts(wanted).withColumn("_fetched", F.lit(True)), "url", "left")
    joined = joined.withColumn("error", F.when(F.col("_fetched").isNull(), F.lit("NotFetched")).otherwise(F.col("error")))
    joined = active_check(company_check(joined), as_of)

    first_party = F.col("source").isin(fixed.FIRST_PARTY_SOURCES)
    blocked, error, code = F.col("blocked_reason"), F.col("error"), F.col("status")
    site = F.when(code.isin(fixed.BLOCKING_STATUSES), F.concat(F.lit("http_"), code.cast("string")))
    blocked = F.coalesce(blocked, F.when(error.isNull(), site))
    company, active, name = F.col("company_result"), F.col("active_result"), F.col("company_name")
    http = F.concat(F.lit("HTTP "), code.cast("string"), F.lit("."))

    def checks(reachable, company_outcome, active_outcome) -> Column:
        def lit(v):
            return v if isinstance(v, Column) else F.lit(v)

        return F.create_map(
            F.lit("URL_REACHABLE"), lit(reachable), F.lit("COMPANY_MATCHES"), lit(company_outcome),
            F.lit("STILL_ACTIVE"), lit(active_outcome),
        )

    def decide(status: str, reason: Column, results: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"), results.alias("checks"))

    seen = checks(PASS, company["outcome"], active["outcome"])
    unknown = checks(UNKNOWN, UNKNOWN, UNKNOWN)
    gone = code.isin(fixed.GONE_STATUSES)
    fine = code.between(200, 299)
    outcome = (
        F.when(
            blocked.isNotNull() & first_party,
            decide(
                "LIKELY_VALID",
                F.concat(
                    name,
                    F.lit("'s own job board API returned this role as open; the posting page itself could not be fetched ("),
                    blocked, F.lit(")."),
                ),
                checks(UNKNOWN, PASS, PASS),
            ),
        )
        .when(
            blocked.isNotNull(),
            decide(
                "UNVERIFIED",
                F.concat(F.lit("Could not confirm this posting — the site declined the request ("), blocked, F.lit(").")),
                unknown,
            ),
        )
        .when(
            error.isNotNull(),
            decide(
                "UNVERIFIED",
                F.concat(F.lit("Could not reach the posting ("), error, F.lit("). Try the link yourself.")),
                unknown,
            ),
        )
        .when(gone, decide("BROKEN", F.concat(F.lit("The posting URL returns "), http), checks(FAIL, UNKNOWN, UNKNOWN)))
        .when(~fine, decide("UNVERIFIED", F.concat(F.lit("The posting URL returned "), http), unknown))
        .when(company["outcome"] == FAIL, decide("MISMATCH", company["reason"], seen))
        .when(active["outcome"] == FAIL, decide("EXPIRED", active["reason"], seen))
        .when(
            (company["outcome"] == PASS) & (active["outcome"] == PASS),
            decide("VALID", F.concat(active["reason"], F.lit(". "), company["reason"], F.lit(".")), seen),
        )
        .when(
            first_party,
            decide(
                "VALID",
                F.concat(
                    F.lit("Listed as open by "), name,
                    F.lit("'s own job board API, and the posting page loads. "), active["reason"], F.lit("."),
                ),
                seen,
            ),
        )
        .otherwise(
            decide(
                "LIKELY_VALID",
                F.concat(F.lit("The posting page loads. "), active["reason"], F.lit(". "), company["reason"], F.lit(".")),
                seen,
            )
        )
    )
    answered = blocked.isNull() & error.isNull()
    read = answered & fine
    kept = [c for c in postings.columns if c not in ("final_url", "status", "reason")]
    return joined.withColumn("_outcome", outcome).select(
        *kept,
        "_outcome.status", "_outcome.reason", "_outcome.checks",
        F.when(answered, code).alias("http_status"),
        F.when(answered, F.col("final_url")).alias("final_url"),
        F.when(read, company["found"]).alias("posting_company"),
        F.when(read, active["found"]).alias("valid_through"),
    )


def revalidate(jobs: DataFrame, ids: DataFrame, fetch_log: DataFrame, as_of: Column) -> DataFrame:
    """Check chosen stored jobs again and return the whole library.

    Chosen jobs get a new status, reason, checks, http status and check time;
    an old final address stays when the new check has none.
    """
    chosen = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    fresh = validate_postings(
        chosen.select("job_id", F.col("job_url").alias("url"), "title", "company_name", "source", "board_token"),
        fetch_log, as_of,
    ).select(
        "job_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"), F.col("checks").alias("_checks"),
        F.col("http_status").alias("_http"), F.col("final_url").alias("_final"),
    )
    done = F.col("_status").isNotNull()

    def newer(new: str | Column, old: str) -> Column:
        return F.when(done, new if isinstance(new, Column) else F.col(new)).otherwise(F.col(old))

    return jobs.join(fresh, "job_id", "left").withColumns(
        {
            "validation_status": newer("_status", "validation_status"),
            "validation_reason": newer("_reason", "validation_reason"),
            "validation_checks": newer("_checks", "validation_checks"),
            "http_status": newer("_http", "http_status"),
            "final_url": F.coalesce("_final", "final_url"),
            "validated_at": newer(as_of, "validated_at"),
        }
    ).drop("_status", "_reason", "_checks", "_http", "_final")
