"""The tracker's whole log: created, moved, contacted, updated; and the record folded from it.

Commands are rows (application_id, seq, ts, event_type, new_status) with types CREATED,
STATUS_CHANGED, OUTREACH_CHANGED, CONTACT_SET and UPDATED, and what they set: note, notes,
follow_up_date, clear_follow_up, contact_name, contact_title, contact_email,
contact_profile_url, date_applied. Columns that a table lacks are NULL: nothing is set.

Fields are last-writer registers (application_id, field, seq, value): of all that set a field
the newest counts, in whatever order they come. Registers of parts merge into those of the
whole, so the same rule serves a batch, a union of batches and a stream.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx
from postmill.operators import tracker
from postmill.operators.buckets import BucketTable
from postmill.plans.skew import ordered_chunks, running

GIVEN = {
    "new_status": "string", "note": "string", "notes": "string", "follow_up_date": "date", "clear_follow_up": "boolean", "contact_name": "string",
    "contact_title": "string", "contact_email": "string", "contact_profile_url": "string", "date_applied": "timestamp_ntz",
}
CONTACT_FIELDS = ["contact_name", "contact_title", "contact_email", "contact_profile_url"]
FIELDS = ["notes", "follow_up_date", "date_applied", *CONTACT_FIELDS]
REGISTER_KEYS = ["application_id", "field"]


def whole(commands: DataFrame) -> DataFrame:
    """Commands with every column of GIVEN."""
    return commands.withColumns({c: (F.col(c) if c in commands.columns else F.lit(None)).cast(k) for c, k in GIVEN.items()})


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _set_notes() -> Column:
    return (_is("UPDATED") | _is("CREATED")) & F.col("notes").isNotNull()


def _set_follow_up() -> Column:
    return _is("UPDATED") & (F.coalesce("clear_follow_up", F.lit(False)) | F.col("follow_up_date").isNotNull())


def _follow_up() -> Column:
    return F.when(~F.coalesce("clear_follow_up", F.lit(False)), F.col("follow_up_date"))


def application_log(commands: DataFrame) -> DataFrame:
    """Commands with ``detail``, as the log words them; updates that change nothing are left out.

    Notes and follow-up dates count as changed where they differ from what the commands
    before have set; an address or a date of application always does.
    """
    rows = whole(commands)
    keys, order, seq = ["application_id"], ["seq"], F.col("seq")
    status, outreach = _is("STATUS_CHANGED") | _is("CREATED"), _is("OUTREACH_CHANGED")

    def at(value: Column) -> Column:
        return F.struct(seq.alias("seq"), value.alias("new"))

    kept = {
        "_stated": F.when(outreach, at(F.col("new_status"))), "_status": F.when(status, at(F.col("new_status"))),
        "_mailed": F.when(_is("STATUS_CHANGED") & (F.col("new_status") == "OUTREACH_SENT"), seq),
        "_notes": F.when(_set_notes(), at(F.nullif("notes", F.lit("")))), "_follow": F.when(_set_follow_up(), at(_follow_up())),
    }
    ready = ordered_chunks(rows, keys, order)
    told = running(running(ready, keys, order, {n: ("max", v) for n, v in kept.items()}), keys, order, {f"{n}_before": ("previous", F.col(n)) for n in kept})

    stated = F.col("_stated_before")
    contact = (
        F.when(F.coalesce(stated["new"], F.lit("NOT_STARTED")) != "NOT_STARTED", stated["new"])
        .when(F.col("_mailed_before") > F.coalesce(stated["seq"], F.lit(-1)), F.lit("EMAIL_SENT"))
        .otherwise(F.lit("NOT_STARTED"))
    )
    new, arrow = F.col("new_status"), F.lit(" → ")
    moved = F.concat(tracker.status_label(F.coalesce(F.col("_status_before")["new"], F.lit("SAVED"))), arrow, tracker.status_label(new))
    cleared = F.coalesce("clear_follow_up", F.lit(False))
    changed = F.array_compact(
        F.array(
            F.when(F.col("notes").isNotNull() & ~F.col("notes").eqNullSafe(F.col("_notes_before")["new"]), F.lit("notes")),
            F.when(cleared, F.lit("follow-up cleared")).when(
                F.col("follow_up_date").isNotNull() & ~F.col("follow_up_date").eqNullSafe(F.col("_follow_before")["new"]),
                F.concat(F.lit("follow-up "), F.date_format("follow_up_date", "dd MMM yyyy")),
            ),
            F.when(F.col("contact_email").isNotNull(), F.lit("contact email")),
            F.when(F.col("date_applied").isNotNull(), F.lit("date applied")),
        )
    )
    detail = (
        F.when(_is("CREATED"), F.concat(F.lit("Saved with status "), tracker.status_label(F.coalesce(new, F.lit("SAVED"))), F.lit(".")))
        .when(_is("CONTACT_SET"), F.concat(F.lit("Contact set to "), F.col("contact_name"), F.lit(".")))
        .when(_is("UPDATED"), F.nullif(F.array_join(changed, ", "), F.lit("")))
        .when(outreach, F.concat(tx.lookup(fixed.OUTREACH_LABELS, contact), arrow, tx.lookup(fixed.OUTREACH_LABELS, new)))
        .when(tx.is_blank(F.col("note")), moved)
        .otherwise(F.concat(moved, F.lit(". "), F.col("note")))
    )
    out = told.withColumn("detail", detail).filter(~_is("UPDATED") | F.col("detail").isNotNull())
    return out.select(*commands.columns, "detail")


def field_registers(commands: DataFrame) -> DataFrame:
    """(application_id, field, seq, value): who last set each field of FIELDS, and to what (NULL: cleared)."""
    rows = whole(commands)
    email = F.when(_is("UPDATED"), F.nullif(F.lower(F.trim("contact_email")), F.lit(""))).otherwise(F.col("contact_email"))
    changes = {
        "notes": (_set_notes(), F.nullif("notes", F.lit(""))), "follow_up_date": (_set_follow_up(), _follow_up().cast("string")),
        "date_applied": (_is("UPDATED") & F.col("date_applied").isNotNull(), F.col("date_applied").cast("string")),
        "contact_email": (_is("CONTACT_SET") | (_is("UPDATED") & F.col("contact_email").isNotNull()), email),
    }
    changes |= {c: (_is("CONTACT_SET"), F.col(c)) for c in CONTACT_FIELDS if c not in changes}
    told = [F.when(is_set, F.struct(F.lit(name).alias("field"), value.alias("value"))) for name, (is_set, value) in changes.items()]
    long = rows.select("application_id", "seq", F.explode(F.array_compact(F.array(*told))).alias("c"))
    return merge_registers(long.select("application_id", "c.field", F.col("seq").cast("long").alias("seq"), "c.value"))


def merge_registers(registers: DataFrame) -> DataFrame:
    """Registers of several parts as those of the whole: the newest of each field."""
    newest = registers.groupBy(*REGISTER_KEYS).agg(F.max(F.struct("seq", "value")).alias("r"))
    return newest.select(*REGISTER_KEYS, "r.seq", "r.value")


def register_columns(registers: DataFrame) -> DataFrame:
    """One row per application with a column for each of FIELDS."""
    kinds = GIVEN | {"seq": "long"}
    return registers.groupBy("application_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).cast(kinds[f]).alias(f) for f in FIELDS],
        F.bool_or(F.col("field") == "date_applied").alias("_dated"),
    )


def application_record(commands: DataFrame) -> DataFrame:
    """Each application as it is now: status, outreach, dates, notes, follow-up and contact, all from the log."""
    rows = whole(commands)
    state = tracker.application_state(rows.filter("event_type IN ('STATUS_CHANGED', 'OUTREACH_CHANGED')"))
    first = rows.groupBy("application_id").agg(F.min_by(F.when(_is("CREATED"), F.struct("new_status", "ts")), F.when(_is("CREATED"), F.col("seq"))).alias("_first"))
    fields = register_columns(field_registers(commands)).withColumnRenamed("date_applied", "_date")
    out = first.join(state, "application_id", "left").join(fields, "application_id", "left")
    began = F.col("_first.new_status")
    status = F.when(F.col("last_status_change_at").isNotNull(), F.col("status")).otherwise(F.coalesce(began, F.lit("SAVED")))
    # a date that an update gave stands; else that of the first status that means an application went in
    applied = F.coalesce(F.when(began.isin(fixed.APPLIED_STATUSES), F.col("_first.ts")), F.col("date_applied")).cast("timestamp_ntz")
    dated = F.when(F.coalesce("_dated", F.lit(False)), F.col("_date")).otherwise(applied)
    return out.select(
        "application_id", status.alias("status"), F.coalesce("outreach_status", F.lit("NOT_STARTED")).alias("outreach_status"),
        dated.alias("date_applied"), "outreach_sent_at", "last_status_change_at", "notes", "follow_up_date", *CONTACT_FIELDS,
    )


def stream_field_registers(stream: DataFrame, store_path: str, checkpoint_path: str, buckets: int = 16):
    """Writer that keeps the registers of arriving commands in a bucketed table; late ones lose to newer ones."""
    stream_id = hashlib.sha256(checkpoint_path.encode()).hexdigest()[:16]

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = field_registers(batch)
        table = BucketTable.create(batch.sparkSession, store_path, fresh.schema, REGISTER_KEYS, buckets)
        table.merge(fresh, lambda stored, new: merge_registers(stored.unionByName(new)), (stream_id, batch_id))
        table.vacuum(2)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_path)
