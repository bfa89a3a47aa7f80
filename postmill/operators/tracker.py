"""The application tracker: folding events, counting, what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx
from postmill.plans.skew import first_k, ordered_chunks, running


def status_label(c: Column) -> Column:
    """'OUTREACH_SENT' -> 'Outreach Sent'."""
    return F.initcap(F.lower(F.replace(c, F.lit("_"), F.lit(" "))))


def is_open(status: Column) -> Column:
    return ~status.isin(fixed.CLOSED_APPLICATION_STATUSES)


def follow_up_due(date: Column, status: Column, as_of: Column) -> Column:
    """Whether a follow-up date has come on an open application."""
    return F.coalesce(is_open(status) & (date <= as_of.cast("date")), F.lit(False))


def application_state(events: DataFrame) -> DataFrame:
    """Current state per application, folded from its events.

    Events are (application_id, seq, ts, event_type, new_status) with types
    STATUS_CHANGED and OUTREACH_CHANGED. The application date is stamped by the
    first status that means one went in and never moves. Outreach is stamped
    once, and cleared by going back to NOT_STARTED.

    The fold is written as aggregates: only the last reset of the outreach and
    what comes after it matter, so no application's events are ever gathered.
    """
    status = F.col("event_type") == "STATUS_CHANGED"
    outreach = F.col("event_type") == "OUTREACH_CHANGED"
    new, seq, ts = F.col("new_status"), F.col("seq"), F.col("ts")

    def at(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    reset = events.groupBy("application_id").agg(
        F.max(at(outreach & (new == "NOT_STARTED"), seq)).alias("_reset"),
        F.max(at(outreach, seq)).alias("_explicit"),
    )
    after = seq > F.coalesce(F.col("_reset"), F.lit(-1))
    applied = status & new.isin(fixed.APPLIED_STATUSES)
    sent = after & ((outreach & (new != "NOT_STARTED")) | (status & (new == "OUTREACH_SENT")))
    folded = (
        events.join(reset, "application_id")
        .groupBy("application_id")
        .agg(
            F.max_by(at(status, new), at(status, seq)).alias("_status"),
            F.max_by(at(status, ts), at(status, seq)).alias("last_status_change_at"),
            F.min_by(at(applied, ts), at(applied, seq)).alias("date_applied"),
            F.min_by(at(sent, ts), at(sent, seq)).alias("outreach_sent_at"),
            F.max_by(at(outreach & (seq == F.col("_explicit")), new), at(outreach, seq)).alias("_stated"),
            F.bool_or(after & status & (new == "OUTREACH_SENT")).alias("_mailed"),
        )
    )
    stated = F.col("_stated")
    value = (
        F.when(stated.isNotNull() & (stated != "NOT_STARTED"), stated)
        .when(F.coalesce(F.col("_mailed"), F.lit(False)), F.lit("EMAIL_SENT"))
        .otherwise(F.lit("NOT_STARTED"))
    )
    return folded.select(
        "application_id", F.coalesce("_status", F.lit("SAVED")).alias("status"), value.alias("outreach_status"),
        "date_applied", "outreach_sent_at", "last_status_change_at",
    )


def application_history(events: DataFrame) -> DataFrame:
    """Events with a ``detail`` text, 'Applied → Interview', in order per application.

    What an outreach event starts from is the folded outreach: the last stated
    one, or, where that is none, an e-mail if a status has said since that
    outreach was sent.
    """
    outreach = F.col("event_type") == "OUTREACH_CHANGED"
    new, seq = F.col("new_status"), F.col("seq")
    label = F.when(outreach, tx.lookup(fixed.OUTREACH_LABELS, new)).otherwise(status_label(new))
    keys, order = ["application_id"], ["seq"]
    stamped = F.struct(seq.alias("seq"), new.alias("new"))
    ready = ordered_chunks(events.withColumn("_label", label), keys, order)
    folded = running(
        ready, keys, order,
        {
            "_stated": ("max", F.when(outreach, stamped)),
            "_status": ("max", F.when(~outreach, stamped)),
            "_mailed": ("max", F.when(~outreach & (new == "OUTREACH_SENT"), seq)),
        },
    )
    told = running(folded, keys, order, {f"{c}_before": ("previous", F.col(c)) for c in ("_stated", "_status", "_mailed")})
    stated = F.col("_stated_before")
    contact = (
        F.when(F.coalesce(stated["new"], F.lit("NOT_STARTED")) != "NOT_STARTED", stated["new"])
        .when(F.col("_mailed_before") > F.coalesce(stated["seq"], F.lit(-1)), F.lit("EMAIL_SENT"))
        .otherwise(F.lit("NOT_STARTED"))
    )
    status = F.coalesce(F.col("_status_before")["new"], F.lit("SAVED"))
    before = F.when(outreach, tx.lookup(fixed.OUTREACH_LABELS, contact)).otherwise(status_label(status))
    return told.select(*events.columns, F.concat(before, F.lit(" → "), F.col("_label")).alias("detail"))


# --- counts ------------------------------------------------------------------------


def dashboard_counts(jobs: DataFrame, apps: DataFrame, as_of: Column) -> DataFrame:
    """Nine headline counts per user, from one scan of jobs and one of applications."""
    shown = ~F.col("is_dismissed")
    per_job = jobs.groupBy("user_id").agg(
        F.count_if(shown & F.col("validation_status").isin(fixed.DISPLAYABLE_STATUSES)).alias("jobs_found"),
        F.count_if(shown & F.col("validation_status").isin(fixed.CONFIRMED_STATUSES)).alias("valid_jobs"),
        F.count_if(shown & F.col("is_saved")).alias("saved_jobs"),
    )
    status = F.col("status")
    per_app = apps.groupBy("user_id").agg(
        F.count_if(status.isin(fixed.APPLIED_STATUSES)).alias("applications_submitted"),
        F.count_if(F.col("outreach_status") != "NOT_STARTED").alias("outreach_sent"),
        F.count_if(status == "INTERVIEW").alias("interviews"),
        F.count_if(status == "OFFER").alias("offers"),
        F.count_if(follow_up_due(F.col("follow_up_date"), status, as_of)).alias("follow_ups_due"),
        F.count_if(is_open(status)).alias("in_pipeline"),
    )
    return per_job.join(per_app, "user_id", "full_outer").na.fill(0)


def status_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, i) for i, s in enumerate(fixed.APPLICATION_STATUSES)], "status string, status_ord int"
    )


def pipeline_breakdown(apps: DataFrame) -> DataFrame:
    """Applications per user and status, with zeros for the statuses a user has none of."""
    counted = apps.groupBy("user_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in fixed.APPLICATION_STATUSES]
    )
    return counted.unpivot("user_id", fixed.APPLICATION_STATUSES, "status", "applications")


def job_counts(jobs: DataFrame) -> DataFrame:
    """Displayable and confirmed jobs per user."""
    shown = ~F.col("is_dismissed")
    return jobs.groupBy("user_id").agg(
        F.count_if(shown & F.col("validation_status").isin(fixed.DISPLAYABLE_STATUSES)).alias("total"),
        F.count_if(shown & F.col("validation_status").isin(fixed.CONFIRMED_STATUSES)).alias("confirmed"),
    )


def follow_ups_due(apps: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """Each user's applications whose follow-up is due, the oldest ``limit`` dates."""
    due = apps.filter(follow_up_due(F.col("follow_up_date"), F.col("status"), as_of))
    return first_k(due, ["user_id"], [F.col("follow_up_date"), F.col("application_id")], limit)


def tracker_tiles(apps: DataFrame, as_of: Column) -> DataFrame:
    """Tracked, applied, contacted and due applications per user."""
    return apps.groupBy("user_id").agg(
        F.count("*").alias("tracked"),
        F.count("date_applied").alias("applied"),
        F.count("outreach_sent_at").alias("outreach_sent"),
        F.count_if(follow_up_due(F.col("follow_up_date"), F.col("status"), as_of)).alias("due"),
    )


# --- runs --------------------------------------------------------------------------

FUNNEL_STAGES = {
    "duplicates_dropped": ["duplicate"],
    "irrelevant_dropped": ["irrelevant"],
    "validated": ["validated"],
    "unverified": ["unverified"],
    "rejected": ["rejected"],
}


def funnel(tagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counters per search from rows tagged with how they ended (``stage``).

    Rows cut by the result limit ('truncated') count as found and nowhere else.
    """
    found = F.col("stage") != "contact"
    return tagged.groupBy(*(keys or ["query_id"])).agg(
        F.count_if(found).alias("raw_found"),
        *[F.count_if(F.col("stage").isin(stages)).alias(name) for name, stages in FUNNEL_STAGES.items()],
        F.count_if(~found).alias("contacts_found"),
    )


def run_status(funnels: DataFrame, source_log: DataFrame) -> DataFrame:
    """Add ``run_status`` from what was kept and how the sources fared.

    ``source_log`` is (query_id, source, error, skip_reason).
    """
    log = source_log.groupBy("query_id").agg(
        F.count("error").alias("_errors"), F.count("skip_reason").alias("_skipped")
    )
    kept = F.col("validated") + F.col("unverified")
    errors, skipped = F.coalesce("_errors", F.lit(0)), F.coalesce("_skipped", F.lit(0))
    status = (
        F.when((errors > 0) & (kept == 0), F.lit("FAILED"))
        .when((errors > 0) | (skipped > 0), F.lit("PARTIAL"))
        .otherwise(F.lit("SUCCESS"))
    )
    return funnels.join(log, "query_id", "left").withColumn("run_status", status).drop("_errors", "_skipped")


MOST_ERRORS, MOST_NOTES = 50, 80


def run_rows(funnels: DataFrame, queries: DataFrame, source_log: DataFrame, as_of: Column) -> DataFrame:
    """The record of each run: counters and status with the sources asked and skipped, errors and notes.

    ``source_log`` is (query_id, source, ord, error, skip_reason) and optionally note: one
    row or more per request and source. A record lists each source once, the first
    MOST_ERRORS distinct errors and the first MOST_NOTES notes and reasons for skipping, in
    the order in which they came; the log itself has them all.
    """
    log = source_log if "note" in source_log.columns else source_log.withColumn("note", F.lit(None).cast("string"))
    skipped = F.col("skip_reason").isNotNull()

    def listed(values: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """(query_id, text, ord) as one list per request, each text once at its first place."""
        once = values.filter("text IS NOT NULL").groupBy("query_id", "text").agg(F.min("ord").alias("ord"))
        if most is not None:
            once = first_k(once, ["query_id"], [F.col("ord"), F.col("text")], most)
        return once.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("l")).select("query_id", F.col("l.text").alias(name))

    noted = log.select("query_id", "ord", F.explode(F.array("note", F.when(skipped, F.concat("source", F.lit(": "), "skip_reason")))).alias("text"))
    parts = [
        listed(log.filter(~skipped).select("query_id", F.col("source").alias("text"), "ord"), "sources_queried"),
        listed(log.filter(skipped).select("query_id", F.col("source").alias("text"), "ord"), "sources_skipped"),
        listed(log.select("query_id", F.col("error").alias("text"), "ord"), "errors", MOST_ERRORS),
        listed(noted, "notes", MOST_NOTES),
    ]
    out = funnels.join(queries, "query_id")
    for part in parts:
        out = out.join(part, "query_id", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("sources_queried", "sources_skipped", "errors", "notes")}
    return out.withColumns(lists).withColumn("finished_at", as_of)


def distinct_errors(log: DataFrame) -> DataFrame:
    """Distinct errors per search with the place of their first appearance."""
    return log.filter("error IS NOT NULL").groupBy("query_id", "error").agg(F.min("ord").alias("first_ord"))


def by_company(jobs: DataFrame) -> DataFrame:
    """Companies of each search: when first seen, how many jobs."""
    return jobs.groupBy("query_id", "company_key").agg(
        F.min("ord").alias("first_ord"), F.count("*").alias("jobs")
    )


def latest_run(searches: DataFrame, runs: DataFrame) -> DataFrame:
    """Per user: the search run last, with its newest run."""
    last = (
        searches.filter("last_run_at IS NOT NULL")
        .groupBy("user_id")
        .agg(
            F.max_by(
                F.struct("search_id", "raw_query", "label", "last_run_at"), F.struct("last_run_at", "search_id")
            ).alias("s")
        )
        .select("user_id", "s.*")
    )
    counters = ["raw_found", "duplicates_dropped", "irrelevant_dropped", "validated", "unverified", "rejected"]
    newest = runs.groupBy("search_id").agg(
        F.max_by(F.struct("run_id", "status", *counters), F.struct("started_at", "run_id")).alias("r")
    ).select("search_id", "r.*")
    return last.join(newest, "search_id", "left")


def last_search_summary(latest: DataFrame) -> DataFrame:
    """What the dashboard says about the last search."""

    def count(c: str) -> Column:
        return F.coalesce(c, F.lit(0)).alias(c)

    return latest.select(
        "user_id", "search_id", F.col("raw_query").alias("query"), "label", "last_run_at", "status", count("raw_found"),
        F.coalesce(F.col("validated") + F.col("unverified"), F.lit(0)).alias("kept"),
        count("duplicates_dropped"), count("irrelevant_dropped"), count("rejected"),
    )
