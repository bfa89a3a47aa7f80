"""Search requests as rows: checking, correcting, filling and restating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import experience as ex
from postmill.functions import places
from postmill.functions import text as tx

LIST_FIELDS = ["titles", "locations", "companies", "industries", "keywords", "exclusions"]
REQUEST_SCHEMA = (
    "query_id bigint, raw string, titles array<string>, locations array<string>, companies array<string>, "
    "industries array<string>, keywords array<string>, exclusions array<string>, min_years double, "
    "max_years double, experience_level string, experience_text string, remote_only boolean, "
    "max_age_days int, limit int, parse_method string, parse_notes array<string>"
)


def clean_list_fields(df: DataFrame, cols: list[str], max_items: int = 12, max_len: int | None = 120) -> DataFrame:
    return df.withColumns({c: tx.clean_list(F.col(c), max_items, max_len) for c in cols})


def request_errors(df: DataFrame) -> Column:
    """ARRAY<STRING> of what is wrong with a submitted request."""
    columns = set(df.columns)

    def rule(name: str, bad: Column, message: str) -> Column:
        return F.when(bad, F.lit(f"{name}: {message}"))

    rules = [rule("query", F.col("query").isNull() | ~F.length("query").between(2, 500), "must have 2 to 500 characters")]
    for years in ("min_years", "max_years"):
        if years in columns:
            rules.append(rule(years, ~F.col(years).between(0, 40), "must be 0 to 40"))
    if "max_age_days" in columns:
        rules.append(rule("max_age_days", ~F.col("max_age_days").between(1, 365), "must be 1 to 365"))
    if "limit" in columns:
        rules.append(rule("limit", ~F.col("limit").between(1, fixed.MAX_RESULT_LIMIT), f"must be 1 to {fixed.MAX_RESULT_LIMIT}"))
    if "contact_email" in columns:
        email = F.lower(tx.strip(F.col("contact_email")))
        bad = (email != "") & (~F.contains(email, F.lit("@")) | F.contains(email, F.lit(" ")))
        rules.append(rule("contact_email", bad, "not a valid email address"))
    if {"titles", "keywords", "companies"} <= columns:
        empty = (F.size("titles") <= 0) & (F.size("keywords") <= 0) & (F.size("companies") <= 0)
        rules.append(rule("criteria", empty, "no role to search for"))
    return F.array_compact(F.array(*rules))


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acceptable requests, rejected ones with an ``errors`` column)."""
    tagged = requests.withColumn("errors", request_errors(requests))
    return tagged.filter(F.size("errors") == 0).drop("errors"), tagged.filter(F.size("errors") > 0)


def apply_overrides(queries: DataFrame, overrides: DataFrame, default_limit: int = fixed.RESULT_LIMIT) -> DataFrame:
    """Values the user gave replace parsed ones, field by field; an empty list is a value."""
    fields = [*LIST_FIELDS, "min_years", "max_years", "remote_only", "max_age_days"]
    given = overrides.select(
        "query_id", *[F.col(f).alias(f"_o_{f}") for f in fields], F.col("limit").alias("_o_limit")
    )
    out = queries.join(given, "query_id", "left").withColumns(
        {f: F.coalesce(f"_o_{f}", f) for f in fields}
        | {"limit": F.coalesce(F.nullif("_o_limit", F.lit(0)), F.lit(default_limit))}
    )
    return out.drop(*[f"_o_{f}" for f in fields], "_o_limit")


def _usable(values: Column) -> Column:
    """Suggested list values worth taking: of two characters or more."""
    trimmed = F.transform(F.coalesce(values, tx.str_array([])), tx.strip)
    return F.filter(trimmed, lambda v: v.isNotNull() & (F.length(v) >= 2))


def merge_suggestions(queries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Let a second opinion fill what was left empty, never change what was stated.

    Titles are appended to; suggested places must be known ones; years count
    only within 0..40 and only if none were stated; remote only if true. The
    number of fields filled goes into ``parse_notes``.
    """
    given = suggestions.select(
        "query_id",
        *[_usable(F.col(f)).alias(f"_s_{f}") for f in LIST_FIELDS],
        *[F.when(F.col(y).between(0, 40), F.col(y).cast("double")).alias(f"_s_{y}") for y in ("min_years", "max_years")],
        F.coalesce("remote_only", F.lit(False)).alias("_s_remote_only"),
    )
    known = F.filter(
        F.transform("_s_locations", lambda v: places.resolve_place(v)["display"]), lambda v: v.isNotNull()
    )
    given = given.withColumn("_s_locations", known)
    joined = queries.join(given, "query_id", "left")

    merged, new = [], {}
    for name in LIST_FIELDS:
        some = F.coalesce(F.size(f"_s_{name}") > 0, F.lit(False))
        fills = some & (F.size(name) == 0)
        value = F.when(fills, tx.first_by_key(F.col(f"_s_{name}"), tx.basic_normalize))
        if name == "titles":
            fills = some
            value = F.when(some, tx.first_by_key(F.concat("titles", "_s_titles"), tx.basic_normalize))
        new[name] = F.coalesce(value, F.col(name))
        merged.append(fills)
    open_years = F.col("min_years").isNull() & F.col("max_years").isNull()
    years = open_years & (F.col("_s_min_years").isNotNull() | F.col("_s_max_years").isNotNull())
    for y in ("min_years", "max_years"):
        new[y] = F.when(open_years, F.col(f"_s_{y}")).otherwise(F.col(y))
    remote = ~F.col("remote_only") & F.coalesce("_s_remote_only", F.lit(False))
    new["remote_only"] = F.col("remote_only") | remote
    count = sum((c.cast("int") for c in [*merged, years, remote]), F.lit(0))
    note = F.concat(F.lit("A language model filled in "), count.cast("string"), F.lit(" field(s) the rules missed."))
    new["parse_method"] = F.when(count > 0, F.lit("rules+llm")).otherwise(F.col("parse_method"))
    new["parse_notes"] = F.when(count > 0, F.array_append("parse_notes", note)).otherwise(F.col("parse_notes"))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in queries.columns])


def ordered_union_titles(queries: DataFrame) -> DataFrame:
    """Add ``search_titles``: titles and variants without repeats, best first."""
    return queries.withColumn("search_titles", places.search_titles(F.col("titles")))


def describe_query(queries: DataFrame) -> DataFrame:
    """Add ``summary``, a one-line restatement of what was understood."""

    def listed(col: str, before: str, after: str = "", sep: str = ", ") -> Column:
        return F.when(
            F.size(col) > 0, F.concat(F.lit(before), F.array_join(col, sep), F.lit(after))
        )

    wanted = F.struct(
        F.col("min_years"), F.col("max_years"), F.col("experience_level").alias("level"),
        F.col("experience_text").alias("text"),
    )
    stated = F.col("min_years").isNotNull() | F.col("max_years").isNotNull() | F.col("experience_level").isNotNull()
    summary = F.concat_ws(
        " · ",
        F.coalesce(listed("titles", "", sep=" / "), F.lit("any role")),
        F.when(stated, ex.describe_experience(wanted)),
        F.when(F.col("remote_only"), F.lit("remote")),
        listed("locations", "in "),
        listed("companies", "at "),
        listed("industries", "(", ")"),
        listed("keywords", "with "),
    )
    return queries.withColumn("summary", summary)
