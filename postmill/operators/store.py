"""The library: idempotent upserts, links, snapshots, deletes and logs.

Parquet has no MERGE, so an upsert is a function from the stored and the
incoming table to the next version of the stored one. The ``merge_`` functions
apply these to tables in hash buckets of their keys, where a batch reads and
rewrites the buckets of its own keys only. ``write_version`` puts a whole
version into a folder of its own; a path being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx
from postmill.operators.buckets import BucketTable
from postmill.operators.contacts import contact_dedupe_key
from postmill.plans.skew import first_per_key, last_per_key

# Set when a job is first stored and never changed by a later search.
JOB_KEPT = ["job_url", "source", "discovered_at", "is_saved", "is_dismissed"]


def job_rows(validated: DataFrame, as_of: Column, summary_length: int | None = None) -> DataFrame:
    """Validated matches in the shape of the job library; ``summary_length`` cuts the summary."""
    summary = tx.collapse(F.col("description")) if summary_length is None else tx.truncate_text(F.col("description"), summary_length)
    found = validated.withColumns(
        {
            "job_url": F.col("url"),
            "normalized_title": tx.normalize_title(F.col("title")),
            "normalized_location": F.nullif(tx.normalize_location(F.col("location")), F.lit("")),
            "summary": F.when(~tx.is_blank(F.col("description")), summary),
            "experience_text": F.col("experience.text"),
            "posting_min_years": F.col("experience.min_years"),
            "posting_max_years": F.col("experience.max_years"),
            "discovered_at": as_of, "last_seen_at": as_of, "validated_at": as_of,
            "is_saved": F.lit(False), "is_dismissed": F.lit(False),
        }
    )
    renamed = {
        "status": "validation_status", "reason": "validation_reason", "checks": "validation_checks",
        "score": "relevance_score", "breakdown": "relevance_breakdown", "reasons": "match_reasons",
    }
    plain = [
        "user_id", "query_id", "canonical_url", "fingerprint", "job_url", "title", "normalized_title", "company_name",
        "company_key", "location", "normalized_location", "is_remote", "description", "summary", "source", "posted_at",
        "experience_text", "discovered_at", "last_seen_at", "validated_at", "http_status", "final_url", "is_saved",
        "is_dismissed", "ord",
    ]
    # what the source said beside, where the matches still have it
    said = ["board_token", "employment_type", "department", "salary_text", "apply_url", "source_query_url", "external_id", "payload"]
    return found.select(
        *plain, *[c for c in said if c in found.columns], F.col("posting_min_years").alias("min_years"), F.col("posting_max_years").alias("max_years"),
        *[F.col(old).alias(new) for old, new in renamed.items()],
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: list[str], merged: dict[str, Column]
) -> DataFrame:
    """Full outer join on ``keys``; ``merged`` gives a column from its ``e.`` and ``i.`` side.

    Columns not named take the incoming value for rows that came in.
    Both sides must be unique in ``keys``; a NULL key meets a NULL key, so that
    a batch that is sent again adds nothing.
    """
    e = existing.withColumn("_there", F.lit(True)).alias("e")
    i = incoming.withColumn("_came", F.lit(True)).alias("i")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    both = e.join(i, on, "full_outer")
    came = F.col("i._came").isNotNull()
    out = []
    for name in existing.columns:
        if name in keys:
            value = F.coalesce(f"e.{name}", f"i.{name}")
        elif name in merged:
            value = merged[name]
        elif name in incoming.columns:
            value = F.when(came, F.col(f"i.{name}")).otherwise(F.col(f"e.{name}"))
        else:
            value = F.col(f"e.{name}")
        out.append(value.alias(name))
    return both.select(*out)


def upsert_jobs(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Merge found jobs into the library by (user_id, canonical_url).

    Content, checks and relevance follow the newest find; the address and
    source it was first stored with, the discovery time and the user's flags
    stay. Of several finds of one job in a batch the last counts.
    """
    keys = ["user_id", "canonical_url"]
    last = last_per_key(incoming, keys, [F.col("ord")])
    there = F.col("e._there").isNotNull()
    merged = {c: F.when(there, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}")) for c in JOB_KEPT if c in existing.columns}
    if "last_seen_at" in existing.columns:
        merged["last_seen_at"] = F.when(F.col("i._came").isNotNull(), as_of).otherwise(F.col("e.last_seen_at"))
    return upsert(existing, last, keys, merged)


def upsert_companies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get-or-create companies by normalised name.

    ``incoming`` is (name, domain, careers_url, ord). The first spelling names
    a new company; a domain or careers address only fills a gap.
    """
    keyed = incoming.withColumn("normalized_name", tx.normalize_company_name(F.col("name")))

    def first_known(col: str) -> Column:
        return F.min_by(F.when(~tx.is_blank(F.col(col)), F.col(col)), F.when(~tx.is_blank(F.col(col)), F.col("ord")))

    batch = keyed.groupBy("normalized_name").agg(
        tx.strip(F.min_by("name", "ord")).alias("name"),
        first_known("domain").alias("domain"),
        first_known("careers_url").alias("careers_url"),
    )
    fill = {c: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.col(f"i.{c}")) for c in ("domain", "careers_url")}
    return upsert(existing, batch, ["normalized_name"], fill | {"name": F.coalesce("e.name", "i.name")})


def upsert_contacts(existing: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """Merge found contacts by (company_key, dedupe_key).

    What is stored stays; an address (with its status), a profile or a title
    is added where there was none, and the contact is marked as seen.
    """
    keys = ["company_key", "dedupe_key"]
    keyed = candidates if "dedupe_key" in candidates.columns else contact_dedupe_key(candidates)
    order = [F.col("source_ord"), F.col("page_ord"), F.col("item_ord")] if "item_ord" in keyed.columns else [F.col("ord")]
    batch = first_per_key(keyed, keys, order)
    there, came = F.col("e._there").isNotNull(), F.col("i._came").isNotNull()
    adopts = tx.is_blank(F.col("e.email")) & ~tx.is_blank(F.col("i.email"))
    merged = {
        "email": F.when(adopts, F.col("i.email")).otherwise(F.col("e.email")),
        "email_status": F.when(adopts | ~there, F.col("i.email_status")).otherwise(F.col("e.email_status")),
        "last_seen_at": F.when(came, as_of).otherwise(F.col("e.last_seen_at")),
        "first_seen_at": F.coalesce(F.col("e.first_seen_at"), as_of),
        "is_archived": F.coalesce(F.col("e.is_archived"), F.lit(False)),
    }
    for c in ("profile_url", "title"):
        merged[c] = F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.col(f"i.{c}"))
    for c in existing.columns:
        if c not in merged and c not in keys and c in batch.columns:
            merged[c] = F.when(there, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}"))
    merged = {c: v for c, v in merged.items() if c in existing.columns}
    return upsert(existing, batch, keys, merged)


def link_job_contacts(links: DataFrame, ranked: DataFrame) -> DataFrame:
    """Merge links by (job_id, contact_id): a known link only moves in rank."""
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("i.rank") * F.lit(0.15))
    there = F.col("e._there").isNotNull()
    merged = {"relevance": F.when(there, F.col("e.relevance")).otherwise(fresh)}
    if "rationale" in links.columns and "rationale" in ranked.columns:
        merged["rationale"] = F.when(there, F.col("e.rationale")).otherwise(F.col("i.rationale"))
    batch = ranked.groupBy("job_id", "contact_id").agg(
        F.min("rank").alias("rank"), *([F.min_by("rationale", "rank").alias("rationale")] if "rationale" in ranked.columns else [])
    )
    return upsert(links, batch, ["job_id", "contact_id"], merged)


# --- the same upserts on bucketed tables ----------------------------------------------

JOB_KEYS = ["user_id", "canonical_url"]
COMPANY_KEYS = ["normalized_name"]
CONTACT_KEYS = ["company_key", "dedupe_key"]
LINK_KEYS = ["job_id", "contact_id"]


def merge_jobs(table: BucketTable, incoming: DataFrame, as_of: Column, mark: tuple[str, int] | None = None) -> list[int]:
    """``upsert_jobs`` on a table in buckets of JOB_KEYS; the buckets that were rewritten."""
    return table.merge(incoming, lambda stored, batch: upsert_jobs(stored, batch, as_of), mark)


def merge_companies(table: BucketTable, incoming: DataFrame, mark: tuple[str, int] | None = None) -> list[int]:
    """``upsert_companies`` on a table in buckets of COMPANY_KEYS."""
    keyed = incoming.withColumn("normalized_name", tx.normalize_company_name(F.col("name")))
    return table.merge(keyed, upsert_companies, mark)


def merge_contacts(table: BucketTable, candidates: DataFrame, as_of: Column, mark: tuple[str, int] | None = None) -> list[int]:
    """``upsert_contacts`` on a table in buckets of CONTACT_KEYS."""
    keyed = candidates if "dedupe_key" in candidates.columns else contact_dedupe_key(candidates)
    return table.merge(keyed, lambda stored, batch: upsert_contacts(stored, batch, as_of), mark)


def merge_links(table: BucketTable, ranked: DataFrame, mark: tuple[str, int] | None = None) -> list[int]:
    """``link_job_contacts`` on a table in buckets of LINK_KEYS."""
    return table.merge(ranked, link_job_contacts, mark)


# --- logs --------------------------------------------------------------------------


LOG_KINDS = ("run", "event", "request")


def append_log(df: DataFrame, path: str, kind: str, batch: str | None = None) -> None:
    """Append to a log table; nothing in it is ever changed.

    With ``batch`` the rows go to a folder of that name, so a batch that is
    sent again replaces its own rows and adds none.
    """
    if kind not in LOG_KINDS:
        raise ValueError(f"unknown log: {kind}")
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_version(df: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write one version of a table into its own folder and return its path."""
    path = f"{folder}/v={version:010d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """Number of the newest complete version in a folder, NULL when there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    done = [
        int(s.getPath().getName()[2:])
        for s in fs.listStatus(root)
        if s.getPath().getName().startswith("v=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


# --- deletes and snapshots ------------------------------------------------------------


def delete_propagation(table: DataFrame, deleted: DataFrame, key: str, mode: str) -> DataFrame:
    """What is left of a table when rows it refers to go.

    'cascade' removes the referring rows, 'set_null' keeps them without the reference.
    """
    gone = deleted.select(key).distinct()
    if mode == "cascade":
        return table.join(gone, key, "left_anti")
    if mode == "set_null":
        marked = table.join(gone.withColumn("_gone", F.lit(True)), key, "left")
        return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*table.columns)
    raise ValueError(f"unknown mode: {mode}")


def unsave_deleted(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Jobs with ``is_saved`` cleared where the user's application (user_id, job_id) was deleted."""
    keys = ["user_id", "job_id"]
    gone = deleted.select(*keys).distinct().withColumn("_gone", F.lit(True))
    marked = jobs.join(gone, keys, "left")
    return marked.withColumn("is_saved", F.col("is_saved") & F.col("_gone").isNull()).select(*jobs.columns)


def display_name(df: DataFrame) -> Column:
    name, company = F.col("name"), F.col("company_name")
    return (
        F.when(~tx.is_blank(name), name)
        .when(F.col("role") == "TALENT_ALIAS", F.concat(company, F.lit(" talent inbox")))
        .otherwise(F.concat(F.lit("Find recruiters at "), company))
    )


def application_snapshot(
    jobs: DataFrame, contacts: DataFrame, requests: DataFrame, existing: DataFrame, as_of: Column
) -> DataFrame:
    """Applications after a batch of save requests (user_id, job_id, contact_id, status, notes, ord).

    A new application freezes the job and the contact as they are now. For one
    that exists, only a different contact is taken over.
    """
    keys = ["user_id", "job_id"]
    first = first_per_key(requests, keys, [F.col("ord")])
    people = contacts.select(
        "contact_id", display_name(contacts).alias("contact_name"), F.col("title").alias("contact_title"),
        F.col("email").alias("contact_email"),
        F.coalesce(F.nullif("profile_url", F.lit("")), F.col("search_url")).alias("contact_profile_url"),
    )
    posting = jobs.select(
        "user_id", "job_id", F.col("title").alias("job_title"), "company_name", "location",
        F.coalesce(F.nullif("final_url", F.lit("")), F.col("job_url")).alias("job_url"), "source",
        F.col("discovered_at").alias("date_found"),
    )
    batch = (
        first.join(posting, keys).join(people, "contact_id", "left")
        .withColumns(
            {
                "outreach_status": F.lit("NOT_STARTED"),
                "date_saved": as_of,
                "date_applied": F.when(F.col("status").isin(fixed.APPLIED_STATUSES), as_of),
            }
        )
    )
    there = F.col("e._there").isNotNull()
    switches = F.col("i.contact_id").isNotNull() & ~F.col("e.contact_id").eqNullSafe(F.col("i.contact_id"))
    contact_columns = ["contact_id", "contact_name", "contact_title", "contact_email", "contact_profile_url"]
    merged = {}
    for c in existing.columns:
        if c in keys or c not in batch.columns:
            continue
        stays = there & ~F.coalesce(switches, F.lit(False)) if c in contact_columns else there
        merged[c] = F.when(stays, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}"))
    return upsert(existing, batch, keys, merged)
