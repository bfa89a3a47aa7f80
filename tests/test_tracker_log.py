"""Registers of fields: any order, any split, late rows; and what the log says."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from postmill.operators import tracker_log
from postmill.operators.buckets import BucketTable
from postmill.session import shared_folder

SCHEMA = "application_id long, seq long, ts timestamp_ntz, event_type string, new_status string, notes string, follow_up_date date, clear_follow_up boolean, contact_name string, contact_email string"
T = datetime.datetime(2024, 3, 1)


def row(seq, kind, new=None, notes=None, follow=None, clear=None, name=None, email=None, app=1):
    return app, seq, T + datetime.timedelta(days=seq), kind, new, notes, follow, clear, name, email


def test_details_and_record(spark):
    day = datetime.date(2024, 5, 7)
    rows = [
        row(0, "CREATED", "OUTREACH_SENT"), row(1, "UPDATED", notes="call"), row(2, "UPDATED", notes="call"), row(3, "UPDATED", notes="", follow=day),
        row(4, "UPDATED", follow=day, email="  A@B.example "), row(5, "CONTACT_SET", name="Ines Alder", email="I@b.example"), row(6, "UPDATED", clear=True, follow=day),
        row(7, "STATUS_CHANGED", "OFFER"), row(8, "UPDATED", notes=""), row(0, "CREATED", None, app=2),
    ]
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    told = {(r.application_id, r.seq): r.detail for r in tracker_log.application_log(df).collect()}
    assert told == {
        (1, 0): "Saved with status Outreach Sent.", (1, 1): "notes", (1, 3): "notes, follow-up 07 May 2024", (1, 4): "contact email",
        (1, 5): "Contact set to Ines Alder.", (1, 6): "follow-up cleared", (1, 7): "Outreach Sent → Offer", (1, 8): "notes", (2, 0): "Saved with status Saved.",
    }
    one, two = sorted(tracker_log.application_record(df).collect())
    assert (one.status, one.outreach_status, one.date_applied, one.notes, one.follow_up_date) == ("OFFER", "NOT_STARTED", T, None, None)
    assert (one.contact_name, one.contact_email) == ("Ines Alder", "I@b.example") and (two.status, two.date_applied, two.notes) == ("SAVED", None, None)
    assert tracker_log.application_record(df.limit(0)).count() == 0
    few = df.select("application_id", "seq", "ts", "event_type", "new_status")  # a table without the columns of updates
    assert tracker_log.application_record(few).filter("notes IS NULL AND contact_name IS NULL").count() == 2


def test_registers_merge_in_any_order_and_on_a_stream(spark):
    rng, root = random.Random(2), shared_folder(spark, "registers")
    rows = [row(i, rng.choice(["UPDATED", "CONTACT_SET"]), notes=rng.choice([None, "", "x", "y"]), clear=rng.random() < 0.2, name=f"n{i}", email=rng.choice([None, f"e{i}"]), app=i % 5) for i in range(120)]
    rng.shuffle(rows)
    want = sorted(map(tuple, tracker_log.field_registers(spark.createDataFrame(rows, SCHEMA)).collect()))
    parts = [tracker_log.field_registers(spark.createDataFrame(rows[i::4], SCHEMA)) for i in range(4)]
    both = tracker_log.merge_registers(parts[2].unionByName(parts[0]))
    assert sorted(map(tuple, tracker_log.merge_registers(both.unionByName(parts[3]).unionByName(parts[1])).collect())) == want

    def run(cp):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        tracker_log.stream_field_registers(source, f"{root}/table", f"{root}/{cp}", 4).trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        run("cp")
    run("other")  # everything once more, as another stream: older rows lose
    table = BucketTable(spark, f"{root}/table").read()
    assert sorted(map(tuple, table.collect())) == want
    assert tracker_log.register_columns(table).filter(F.col("contact_name").isNull()).count() == 0
