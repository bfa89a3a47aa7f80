"""Reading the library: filtered lists and the shapes they are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import dates
from postmill.functions import text as tx
from postmill.operators import store, tracker
from postmill.plans.skew import first_k


def _like(col: str, text: str) -> Column:
    """Case-insensitive containment; % and _ in the text are wildcards."""
    return F.ilike(F.col(col), F.lit(f"%{text.strip()}%"))


def job_library(
    jobs: DataFrame, q: str | None = None, saved_only: bool = False, confirmed_only: bool = False,
    include_dismissed: bool = False, company: str | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Each user's displayable jobs, best match first; ``limit`` and ``offset`` cut every user's list."""
    out = jobs.filter(F.col("validation_status").isin(fixed.DISPLAYABLE_STATUSES))
    if not include_dismissed:
        out = out.filter(~F.col("is_dismissed"))
    if saved_only:
        out = out.filter("is_saved")
    if confirmed_only:
        out = out.filter(F.col("validation_status").isin(fixed.CONFIRMED_STATUSES))
    if company:
        out = out.filter(_like("company_name", company))
    if q:
        out = out.filter(_like("title", q) | _like("company_name", q) | _like("location", q))
    order = [F.col("relevance_score").desc(), F.col("discovered_at").desc(), F.col("job_id")]
    if limit is not None:
        out = first_k(out, ["user_id"], order, offset + limit, rank="_place").filter(F.col("_place") > offset).drop("_place")
    elif offset:
        raise ValueError("an offset without a limit would number whole lists")
    return out.orderBy("user_id", *order)


def application_list(
    apps: DataFrame, as_of: Column, status: str | None = None, outreach: str | None = None, open_only: bool = False,
    due_only: bool = False, q: str | None = None,
) -> DataFrame:
    """Tracked applications, last changed first."""
    out = apps
    if status:
        out = out.filter(F.col("status") == status)
    if outreach:
        out = out.filter(F.col("outreach_status") == outreach)
    if open_only:
        out = out.filter(tracker.is_open(F.col("status")))
    if q:
        out = out.filter(_like("job_title", q) | _like("company_name", q))
    if due_only:
        out = out.filter(tracker.follow_up_due(F.col("follow_up_date"), F.col("status"), as_of))
    return out.orderBy(F.col("updated_at").desc(), "application_id")


def contacts_owned(contacts: DataFrame, links: DataFrame, jobs: DataFrame, user_id: Column | None = None) -> DataFrame:
    """Contacts reachable from a job of the user (of any user when none is given)."""
    own = jobs if user_id is None else jobs.filter(F.col("user_id") == user_id)
    reachable = links.join(own.select("job_id"), "job_id", "left_semi").select("contact_id")
    return contacts.join(reachable, "contact_id", "left_semi")


def contact_list(
    contacts: DataFrame, links: DataFrame, jobs: DataFrame, user_id: Column | None = None, company: str | None = None,
    with_email_only: bool = False, people_only: bool = False, limit: int | None = None,
) -> DataFrame:
    """Contacts behind the jobs of each user (or of one) that are not archived, with ``user_id``, each once per user.

    ``limit`` keeps the first so many of every user's, by contact_id.
    """
    out = contacts.filter(~F.col("is_archived"))
    if company:
        out = out.filter(_like("company_name", company))
    if with_email_only:
        out = out.filter("email IS NOT NULL")
    if people_only:
        out = out.filter("name IS NOT NULL")
    own = jobs if user_id is None else jobs.filter(F.col("user_id") == user_id)
    owned = links.select("job_id", "contact_id").join(own.select("job_id", "user_id"), "job_id").select("user_id", "contact_id").distinct()
    out = owned.join(out, "contact_id")
    return out if limit is None else first_k(out, ["user_id"], [F.col("contact_id")], limit)


def search_results(jobs: DataFrame, search_id: int | None = None) -> DataFrame:
    """Jobs a search found, best match first; without an id, those of every search."""
    found = jobs.filter(~F.col("is_dismissed"))
    if search_id is None:
        return found.orderBy("search_id", F.col("relevance_score").desc(), "job_id")
    return found.filter(F.col("search_id") == search_id).orderBy(F.col("relevance_score").desc(), "job_id")


def search_history(searches: DataFrame, limit: int = 20) -> DataFrame:
    """Each user's newest searches."""
    return first_k(searches, ["user_id"], [F.col("created_at").desc(), F.col("search_id")], limit)


def recent_jobs(jobs: DataFrame, n: int = 8) -> DataFrame:
    """Each user's newest jobs that may be shown."""
    shown = jobs.filter(~F.col("is_dismissed") & F.col("validation_status").isin(fixed.DISPLAYABLE_STATUSES))
    return first_k(shown, ["user_id"], [F.col("discovered_at").desc(), F.col("relevance_score").desc(), F.col("job_id")], n)


def job_contacts(links: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts of each job by rank, archived ones left out."""
    return links.join(contacts.filter(~F.col("is_archived")), "contact_id")


def jobs_with_application(jobs: DataFrame, apps: DataFrame) -> DataFrame:
    """Jobs with the user's application to each, if there is one."""
    own = apps.select(
        "user_id", "job_id", "application_id", F.col("status").alias("application_status")
    )
    return jobs.join(own, ["user_id", "job_id"], "left")


# --- shapes ------------------------------------------------------------------------


def validation_label(status: Column) -> Column:
    return tx.lookup(fixed.VALIDATION_LABELS, status)


def source_label(source: Column) -> Column:
    """Readable source; an unknown value is shown as words."""
    known = tx.lookup(fixed.SOURCE_LABELS, source)
    return F.when(~tx.is_blank(source), F.coalesce(known, tracker.status_label(source)))


def validation_view(jobs: DataFrame) -> DataFrame:
    """Add the struct ``validation`` (status, label, reason, confirmed, checks, checked_at, http_status)."""
    status = F.col("validation_status")
    return jobs.withColumn(
        "validation",
        F.struct(
            status.alias("status"), validation_label(status).alias("label"), F.col("validation_reason").alias("reason"),
            status.isin(fixed.CONFIRMED_STATUSES).alias("confirmed"), F.col("validation_checks").alias("checks"),
            F.col("validated_at").alias("checked_at"), F.col("http_status").alias("http_status"),
        ),
    )


def contact_view(contacts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Contacts with labels and display name, with rank and rationale when links are given."""
    role = F.col("role")
    out = contacts.withColumns(
        {
            "display_name": store.display_name(contacts),
            "role_label": tx.lookup(fixed.CONTACT_ROLE_LABELS, role),
            "is_person": ~role.isin(fixed.IMPERSONAL_ROLES) & ~tx.is_blank(F.col("name")),
            "email_status_label": tx.lookup(fixed.EMAIL_STATUS_LABELS, F.col("email_status")),
            "source_label": tx.lookup(fixed.SOURCE_LABELS, F.col("source")),
        }
    )
    return out if links is None else out.join(links.select("job_id", "contact_id", "rank", "rationale"), "contact_id")


def application_view(apps: DataFrame, as_of: Column) -> DataFrame:
    """Applications with labels and whether a follow-up is due."""
    return apps.withColumns(
        {
            "source_label": source_label(F.col("source")),
            "status_label": tracker.status_label(F.col("status")),
            "outreach_status_label": tx.lookup(fixed.OUTREACH_LABELS, F.col("outreach_status")),
            "follow_up_due": tracker.follow_up_due(F.col("follow_up_date"), F.col("status"), as_of),
        }
    )


def job_view(
    jobs: DataFrame, links: DataFrame, contacts: DataFrame, apps: DataFrame, as_of: Column, detail: bool = False
) -> DataFrame:
    """Jobs as they are shown: labels, checks, ranked contacts and the application, in one plan."""
    listed = contact_view(contacts.filter(~F.col("is_archived")), links)
    per_job = listed.groupBy("job_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "contact_id", "display_name", "role_label", "email", "rationale"))
        ).alias("contacts")
    )
    out = validation_view(jobs_with_application(jobs, apps)).join(per_job, "job_id", "left")
    out = out.withColumns(
        {
            "experience_label": tx.experience_label(F.col("min_years"), F.col("max_years"), F.col("experience_text")),
            "job_url": F.coalesce(F.nullif("final_url", F.lit("")), F.col("job_url")),
            "source_label": source_label(F.col("source")),
            "age_days": dates.age_days(F.col("posted_at"), F.col("discovered_at"), as_of),
            "contacts": F.coalesce(F.col("contacts"), F.array()),
        }
    )
    return out if detail else out.drop("description", "relevance_breakdown")


def enum_table(spark: SparkSession, enum: str) -> DataFrame:
    """Dimension table of an enumeration: value, ordinal, label and its flags."""
    f = fixed
    if enum == "source":
        rows = [(v, i, lab, v in f.FIRST_PARTY_SOURCES) for i, (v, lab) in enumerate(f.SOURCE_LABELS.items())]
        return spark.createDataFrame(rows, "value string, ordinal int, label string, is_first_party boolean")
    if enum == "validation":
        rows = [
            (v, i, lab, v in f.DISPLAYABLE_STATUSES, v in f.CONFIRMED_STATUSES)
            for i, (v, lab) in enumerate(f.VALIDATION_LABELS.items())
        ]
        return spark.createDataFrame(
            rows, "value string, ordinal int, label string, is_displayable boolean, is_confirmed boolean"
        )
    if enum == "contact_role":
        rows = [(v, i, lab, v not in f.IMPERSONAL_ROLES) for i, (v, lab) in enumerate(f.CONTACT_ROLE_LABELS.items())]
        return spark.createDataFrame(rows, "value string, ordinal int, label string, is_person boolean")
    if enum == "application":
        rows = [
            (v, i, v.replace("_", " ").title(), v not in f.CLOSED_APPLICATION_STATUSES, v in f.APPLIED_STATUSES)
            for i, v in enumerate(f.APPLICATION_STATUSES)
        ]
        return spark.createDataFrame(
            rows, "value string, ordinal int, label string, is_open boolean, counts_as_applied boolean"
        )
    if enum == "outreach":
        rows = [(v, i, lab, v != "NOT_STARTED") for i, (v, lab) in enumerate(f.OUTREACH_LABELS.items())]
        return spark.createDataFrame(rows, "value string, ordinal int, label string, is_sent boolean")
    if enum == "email_status":
        rows = [(v, i, lab) for i, (v, lab) in enumerate(f.EMAIL_STATUS_LABELS.items())]
        return spark.createDataFrame(rows, "value string, ordinal int, label string")
    if enum == "experience_level":
        rows = [(v, i, v.title(), *years) for i, (v, years) in enumerate(f.LEVEL_YEARS.items())]
        return spark.createDataFrame(
            rows, "value string, ordinal int, label string, low_years double, high_years double"
        )
    raise ValueError(f"unknown enumeration: {enum}")


def enum_flags(df: DataFrame, col: str, enum: str) -> DataFrame:
    """Join an enumeration's label and flags to a column; the table has a handful of rows."""
    table = F.broadcast(enum_table(df.sparkSession, enum).withColumnRenamed("value", col))
    return df.join(table, col, "left")
