"""Lenient date parsing over the many shapes job sources send."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import text as tx

ISO = (
    r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    r"(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
)
PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}Z?)?$"  # the common form of ISO
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
MONTH_FIRST = r"(?i)^([a-z]{3})\s+(\d{1,2}),\s+(\d{4})$"
DAY_FIRST = r"(?i)^(\d{1,2})\s+([a-z]{3})\s+(\d{4})$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MAX_EPOCH = 253402300799.0


def _utc(text: Column) -> Column:
    return text.try_cast("timestamp")


def _day(year: Column, month: Column, day: Column) -> Column:
    return _utc(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T00:00:00Z")))


def parse_datetime(c: Column) -> Column:
    """TIMESTAMP in UTC from ISO 8601, epoch seconds or milliseconds, or a common date text.

    A date without a zone counts as UTC. ``d/m/Y`` is tried before ``m/d/Y``.
    """
    # each text is stripped once; the common form is read in place, the parts of any other by one match
    return tx.let(tx.strip(c), lambda text: F.when(text.rlike(PLAIN), _plain(text)).otherwise(_parsed(text)))


def _plain(text: Column) -> Column:
    time = F.when(F.length(text) > 10, F.substring(text, 12, 8)).otherwise(F.lit("00:00:00"))
    return _utc(F.concat(F.left(text, F.lit(10)), F.lit("T"), time, F.lit("Z")))


def _iso(part: Column) -> Column:
    """The instant that the groups of ``ISO`` name."""

    def group(i: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.get(part, i - 1), F.lit("")), F.lit(default))

    zone = F.regexp_replace(group(8, "Z"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    return _utc(
        F.concat(
            F.get(part, 0), F.lit("-"), F.lpad(F.get(part, 1), 2, "0"), F.lit("-"), F.lpad(F.get(part, 2), 2, "0"), F.lit("T"),
            group(4, "00"), F.lit(":"), group(5, "00"), F.lit(":"), group(6, "00"), F.lit("."), group(7, "0"), zone,
        )
    )


def _parsed(text: Column) -> Column:
    groups = F.split(F.regexp_replace(text, ISO, "|".join(f"${i}" for i in range(1, 9))), r"\|")
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    epoch = F.when(seconds <= MAX_EPOCH, F.timestamp_micros((seconds * 1e6).try_cast("bigint")))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    months = tx.lit_map({m: f"{i + 1:02d}" for i, m in enumerate(MONTHS)})

    def month(name: Column) -> Column:
        return F.element_at(months, F.lower(name))

    return (
        F.when(tx.is_blank(text), F.lit(None).cast("timestamp"))
        .when(text.rlike(r"^\d+$"), epoch)
        .when(text.rlike(ISO), tx.let(groups, _iso))
        .when(
            text.rlike(SLASHED),
            F.coalesce(
                _day(part(SLASHED, 3), part(SLASHED, 2), part(SLASHED, 1)),
                _day(part(SLASHED, 3), part(SLASHED, 1), part(SLASHED, 2)),
            ),
        )
        .when(text.rlike(MONTH_FIRST), _day(part(MONTH_FIRST, 3), month(part(MONTH_FIRST, 1)), part(MONTH_FIRST, 2)))
        .when(text.rlike(DAY_FIRST), _day(part(DAY_FIRST, 3), month(part(DAY_FIRST, 2)), part(DAY_FIRST, 1)))
    )


def age_days(posted: Column, found: Column, as_of: Column) -> Column:
    """Days between the posting (else its discovery) and ``as_of``."""

    def micros(ts: Column) -> Column:
        return F.unix_micros(ts.cast("timestamp"))

    return (micros(as_of) - micros(F.coalesce(posted, found))) / 86_400_000_000.0
