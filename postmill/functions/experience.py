"""Experience requirements read from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx


def experience_level(text: Column) -> Column:
    """First level whose wording appears in the text."""
    level = F.lit(None).cast("string")
    for pattern, name in reversed(fixed.EXPERIENCE_LEVELS):
        level = F.when(text.rlike(pattern), F.lit(name)).otherwise(level)
    return level


def _years(value: Column) -> Column:
    number = F.try_to_number(F.nullif(value, F.lit("")), F.lit("99")).cast("double")
    return F.least(number, F.lit(fixed.MAX_YEARS))


def parse_experience(c: Column, window: int | None = None) -> Column:
    """Struct (min_years, max_years, level, text).

    A stated range wins over "up to", which wins over "N+", which wins over a
    bare number of years. The whole text is read unless ``window`` limits it.
    """
    text = F.coalesce(c, F.lit(""))
    if window is not None:
        text = F.left(text, F.lit(window))

    def hit(name: str, pattern: str, source: Column, group: int = 0) -> Column:
        return F.regexp_extract(source, pattern, group).alias(name)

    def phrases(source: Column) -> Column:
        return F.struct(
            hit("r", fixed.EXPERIENCE_RANGE, source),
            hit("m", fixed.EXPERIENCE_MAXIMUM, source),
            hit("p", fixed.EXPERIENCE_PLUS, source),
            hit("b", fixed.EXPERIENCE_MINIMUM, source),
            experience_level(source).alias("level"),
        )

    def numbers(found: Column) -> Column:
        """Years are read from the short matched phrase, not from the whole text again."""
        first = _years(hit("n", r"([0-9]{1,2})[^0-9]+([0-9]{1,2})", found["r"], 1))
        second = _years(hit("n", r"([0-9]{1,2})[^0-9]+([0-9]{1,2})", found["r"], 2))

        def single(name: str) -> Column:
            return _years(hit("n", r"([0-9]{1,2})", found[name], 1))

        low = (
            F.when(found["r"] != "", F.least(first, second))
            .when(found["m"] != "", F.lit(0.0))
            .when(found["p"] != "", single("p"))
            .when(found["b"] != "", single("b"))
        )
        high = F.when(found["r"] != "", F.greatest(first, second)).when(found["m"] != "", single("m"))
        phrase = (
            F.when(found["r"] != "", found["r"])
            .when(found["m"] != "", found["m"])
            .when(found["p"] != "", found["p"])
            .when(found["b"] != "", found["b"])
        )
        return F.struct(
            low.alias("min_years"),
            high.alias("max_years"),
            found["level"].alias("level"),
            F.trim(phrase).alias("text"),
        )

    return tx.let(text, lambda source: tx.let(phrases(source), numbers))


def experience_bounds(c: Column) -> Column:
    """Struct (low, high): the stated bounds, else the band of the level, else NULL."""
    stated = c["min_years"].isNotNull() | c["max_years"].isNotNull()
    low = F.when(stated, F.coalesce(c["min_years"], F.lit(0.0))).otherwise(
        tx.lookup({k: v[0] for k, v in fixed.LEVEL_YEARS.items()}, c["level"], "double")
    )
    high = F.when(stated, F.coalesce(c["max_years"], F.lit(fixed.MAX_YEARS))).otherwise(
        tx.lookup({k: v[1] for k, v in fixed.LEVEL_YEARS.items()}, c["level"], "double")
    )
    return F.struct(low.alias("low"), high.alias("high"))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two bounds meet; NULL when either is unknown."""
    return (a["low"] <= b["high"]) & (b["low"] <= a["high"])


def describe_experience(c: Column) -> Column:
    """Phrase for a parsed requirement."""
    unstated = c["min_years"].isNull() & c["max_years"].isNull()
    named = F.when(tx.is_blank(c["text"]) & unstated & c["level"].isNotNull(), F.initcap(F.lower(c["level"])))
    return F.coalesce(named, tx.experience_label(c["min_years"], c["max_years"], c["text"]))
