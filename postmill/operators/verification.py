"""Checking contacts' addresses: strategies by name, and an as-of table of verdicts.

A strategy is a function from a table of distinct addresses (email) to (email, status,
confidence, reason), with a status of valid, risky, invalid, unknown or not_checked. Verdicts are
rows (email, status, confidence, reason, checked_at) that are only ever added; what holds at a
time is the newest of each address up to then. Only addresses without a fresh verdict are
checked, each once, however many contacts share it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.operators import contacts as con

Verifier = Callable[[DataFrame], DataFrame]
VERIFIERS: dict[str, Verifier] = {}
VERDICT = ["email", "status", "confidence", "reason"]
FRESH_DAYS = 30


def register_verifier(name: str, verifier: Verifier) -> None:
    """Add a strategy, or put another in its place."""
    VERIFIERS[name] = verifier


def unchecked(emails: DataFrame) -> DataFrame:
    """The strategy that looks at nothing."""
    return emails.select("email", F.lit("not_checked").alias("status"), F.lit(0.0).alias("confidence"), F.lit("checking is off").alias("reason"))


def dns_verifier(mx: DataFrame) -> Verifier:
    """By syntax and the domains' mail records; ``mx`` is (domain, resolves, has_mx)."""

    def verify(emails: DataFrame) -> DataFrame:
        told = con.email_deliverability(emails.select("email"), mx)
        reason = tx.lookup({"valid": "the domain takes mail", "risky": "a shared address", "invalid": "malformed, or the domain takes no mail", "unknown": "the domain could not be checked"}, F.col("verification"))
        return told.select("email", F.col("verification").alias("status"), F.col("verification_confidence").alias("confidence"), reason.alias("reason"))

    return verify


def vendor_verifier(answers: DataFrame) -> Verifier:
    """By a vendor's answers (email, body); an address without one is unknown."""

    def verify(emails: DataFrame) -> DataFrame:
        newest = answers.groupBy("email").agg(F.max("body").alias("body"))
        told = emails.select("email").join(newest, "email", "left").withColumn("v", con.verification_payload(F.col("body")))
        return told.select(
            "email", F.coalesce("v.status", F.lit("unknown")).alias("status"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"),
            F.when(F.col("body").isNull(), "no answer").otherwise(F.col("v.reason")).alias("reason"),
        )

    return verify


register_verifier("none", unchecked)


def address(c: Column) -> Column:
    """An address as verdicts name it; NULL where there is none."""
    return F.nullif(F.lower(tx.strip(c)), F.lit(""))


def current_verdicts(verdicts: DataFrame, as_of: Column) -> DataFrame:
    """The newest verdict of each address that was there at a time."""
    known = verdicts.filter(F.col("checked_at") <= as_of)
    order = F.struct("checked_at", "status")
    return known.groupBy("email").agg(F.max_by(F.struct("status", "confidence", "reason", "checked_at"), order).alias("v")).select("email", "v.*")


def verify_contacts(
    contacts: DataFrame, verdicts: DataFrame, verifier: str | Verifier, as_of: Column, fresh_days: int = FRESH_DAYS, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(contacts with email_verification and email_verified_at, verdicts to add).

    ``ids`` (contact_id) limits what is checked anew; all contacts get what is known. Addresses
    whose newest verdict is older than ``fresh_days`` or was not_checked are asked again, and
    theirs is the old verdict until a new one is there. Contacts without an address are not_checked.
    """
    check = VERIFIERS[verifier] if isinstance(verifier, str) else verifier
    keyed = contacts.withColumn("_address", address(F.col("email")))
    now = current_verdicts(verdicts, as_of)
    since = as_of - F.make_dt_interval(F.lit(fresh_days))
    fresh = now.filter((F.col("checked_at") >= since) & (F.col("status") != "not_checked"))
    asked = keyed if ids is None else keyed.join(ids.select("contact_id").distinct(), "contact_id", "left_semi")
    stale = asked.filter("_address IS NOT NULL").select(F.col("_address").alias("email")).distinct().join(fresh, "email", "left_anti")
    added = check(stale).select(*VERDICT).withColumn("checked_at", as_of.cast(verdicts.schema["checked_at"].dataType))
    told = current_verdicts(verdicts.select(*VERDICT, "checked_at").unionByName(added), as_of)
    told = told.select(F.col("email").alias("_address"), F.col("status").alias("_status"), F.col("checked_at").alias("_at"))
    out = keyed.join(told, "_address", "left")
    status = F.coalesce("_status", F.lit("not_checked"))
    return out.select(*contacts.columns, status.alias("email_verification"), F.when(status != "not_checked", F.col("_at")).alias("email_verified_at")), added
