"""Turning a log of free-text requests into criteria columns.

Each criterion is read by one step over the text that is left (``cur``) and
blanks what it used, the most explicitly worded first, so that the rest can be
taken as the role. Every step is a projection of built-in expressions over the
whole table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import experience as ex
from postmill.functions import places
from postmill.functions import text as tx
from postmill.operators.requests import REQUEST_SCHEMA


def _blanks(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def _blank_at(text: Column, start: Column, length: Column) -> Column:
    """The text with ``length`` characters from 1-based ``start`` turned into blanks."""
    return F.concat(F.left(text, start - 1), _blanks(length), F.substr(text, start + length))


def _split_list(body: Column) -> Column:
    """Items of 'A, B and C'; single characters are dropped."""
    parts = F.transform(
        F.split(body, fixed.REQUEST_LIST_BREAK),
        lambda p: F.regexp_replace(p, r"^[ .,\-–—\t]+|[ .,\-–—\t]+$", ""),
    )
    return F.filter(parts, lambda p: F.length(p) > 1)


def _dedupe(values: Column) -> Column:
    return F.transform(tx.first_by_key(values, tx.basic_normalize), tx.strip)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<whole, body>> of a pattern whose whole is not a group of its own."""
    flags = pattern[: pattern.index(")") + 1] if pattern.startswith("(?") and pattern[2] in "iU" else ""
    grouped = f"{flags}({pattern[len(flags):]})"
    zipped = F.arrays_zip(_found(text, grouped, 1).alias("whole"), _found(text, grouped, 2).alias("body"))
    return zipped


def _standing_alone(lowered: Column, name: Column) -> Column:
    """Whether the first occurrence of a name is not part of a longer word."""
    at = F.instr(lowered, name)

    def free(pos: Column) -> Column:
        around = F.concat(F.substring(lowered, F.greatest(pos - 1, F.lit(1)), F.when(pos > 1, 1).otherwise(0)),
                          F.substring(lowered, pos + F.length(name), F.lit(1)))
        return (pos > 0) & ~around.rlike(r"[\p{L}\p{N}]")

    return tx.let(at, free)


def _by_length(names) -> Column:
    """Longest first, as more specific names must win."""
    return tx.str_array(sorted(names, key=len, reverse=True))


def _consume(text: Column, matches: Column, used) -> Column:
    """Blank the first ``used(match)`` characters of each match, in order of appearance."""
    start = F.struct(F.lit("").alias("done"), text.alias("rest"))

    def step(acc: Column, m: Column) -> Column:
        def cut(at: Column) -> Column:
            n = used(m)
            tail = F.substr(m["whole"], n + 1)
            return F.struct(
                F.concat(acc["done"], F.left(acc["rest"], at - 1), _blanks(n), tail).alias("done"),
                F.substr(acc["rest"], at + F.length(m["whole"])).alias("rest"),
            )

        return tx.let(F.instr(acc["rest"], m["whole"]), cut)

    out = F.reduce(matches, start, step)
    return tx.let(out, lambda o: F.concat(o["done"], o["rest"]))


# --- steps -------------------------------------------------------------------------------


def _experience(df: DataFrame) -> DataFrame:
    cur = F.col("cur")
    numeric, worded = fixed.REQUEST_EXPERIENCE
    phrase = F.coalesce(
        F.nullif(F.regexp_extract(cur, numeric, 0), F.lit("")), F.nullif(F.regexp_extract(cur, worded, 0), F.lit(""))
    )
    before = F.when(
        cur.rlike(numeric), F.regexp_extract(cur, "(?s)^(.*?)" + numeric, 1)
    ).otherwise(F.regexp_extract(cur, "(?s)^(.*?)" + worded, 1))
    df = df.withColumns({"_phrase": phrase, "_at": F.length(before) + 1})
    df = df.withColumn("_exp", ex.parse_experience(F.col("_phrase")))
    used = F.col("_phrase").isNotNull()
    return df.withColumns(
        {
            "min_years": F.when(used, F.col("_exp.min_years")),
            "max_years": F.when(used, F.col("_exp.max_years")),
            "experience_level": F.when(used, F.col("_exp.level")),
            "experience_text": F.regexp_replace("_phrase", r"^[ .,]+|[ .,]+$", ""),
            "cur": F.when(used, _blank_at(cur, F.col("_at"), F.length("_phrase"))).otherwise(cur),
        }
    ).drop("_phrase", "_at", "_exp")


def _exclusions(df: DataFrame) -> DataFrame:
    found = F.flatten(F.transform(_found(F.col("cur"), fixed.REQUEST_EXCLUSION), _split_list))
    return df.withColumns(
        {
            "exclusions": _dedupe(F.filter(found, lambda v: F.length(v) > 2)),
            "cur": F.regexp_replace("cur", fixed.REQUEST_EXCLUSION, " "),
        }
    )


def _keywords(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {"_quoted": _found(F.col("cur"), fixed.REQUEST_QUOTED), "cur": F.regexp_replace("cur", fixed.REQUEST_QUOTED, " ")}
    )
    listed = F.flatten(F.transform(_found(F.col("cur"), fixed.REQUEST_KEYWORD), _split_list))
    return df.withColumns(
        {
            "keywords": _dedupe(F.concat("_quoted", listed)),
            "cur": F.regexp_replace("cur", fixed.REQUEST_KEYWORD, " "),
        }
    ).drop("_quoted")


def _remote(df: DataFrame) -> DataFrame:
    lowered = F.lower("cur")

    def first(terms: Column) -> Column:
        return F.get(F.filter(terms, lambda t: F.contains(lowered, t)), 0)

    df = df.withColumns(
        {"_remote": first(_by_length(fixed.REMOTE_TERMS)), "_hybrid": first(tx.str_array(fixed.HYBRID_TERMS))}
    )
    term = F.coalesce("_remote", "_hybrid")
    noted = F.col("_remote").isNull() & F.col("_hybrid").isNotNull()
    note = F.concat(F.lit("Noted '"), F.col("_hybrid"), F.lit("' — filtering on it is up to you."))
    return df.withColumns(
        {
            "remote_only": F.col("_remote").isNotNull(),
            "parse_notes": F.when(noted, F.array(note)).otherwise(tx.str_array([])),
            "cur": F.when(term.isNotNull(), _blank_at(F.col("cur"), F.instr(lowered, term), F.length(term))).otherwise(F.col("cur")),
        }
    ).drop("_remote", "_hybrid")


def _locations(df: DataFrame) -> DataFrame:
    clauses = F.transform(
        _matches(F.col("cur"), fixed.REQUEST_LOCATION),
        lambda m: F.struct(
            m["whole"].alias("whole"),
            m["body"].alias("body"),
            F.transform(
                _split_list(m["body"]),
                lambda v: F.struct(v.alias("name"), places.resolve_place(v)["display"].alias("place")),
            ).alias("items"),
        ),
    )
    df = df.withColumn(
        "_clauses", F.filter(clauses, lambda m: F.exists(m["items"], lambda i: i["place"].isNotNull()))
    )

    def used(m: Column) -> Column:
        """Up to the end of the last place before the first word that is none."""
        known = F.transform(m["items"], lambda i: i["place"].isNotNull())
        leading = F.coalesce(
            F.nullif(F.array_position(known, F.lit(False)), F.lit(0)) - 1, F.size(known).cast("bigint")
        )
        ends = F.transform(
            F.slice(m["items"], F.lit(1), leading.cast("int")),
            lambda i: F.instr(m["body"], i["name"]) - 1 + F.length(i["name"]),
        )
        lead = F.length(m["whole"]) - F.length(m["body"])
        return lead + F.greatest(F.coalesce(F.array_max(ends), F.lit(0)), F.lit(0))

    hits = F.flatten(
        F.transform(
            "_clauses",
            lambda m: F.transform(F.filter(m["items"], lambda i: i["place"].isNotNull()), lambda i: i["place"]),
        )
    )
    df = df.withColumns({"_hits": hits, "cur": _consume(F.col("cur"), F.col("_clauses"), used)})

    # Bare names without a preposition: a city first, else a country.
    lowered = F.lower("cur")
    cities = _by_length([alias for alias, _, _ in fixed.CITIES])
    countries = _by_length([name for name in fixed.COUNTRIES if len(name) > 3])
    none = F.size("_hits") == 0
    df = df.withColumns(
        {
            "_city": F.when(none, F.get(F.filter(cities, lambda n: _standing_alone(lowered, n)), 0)),
            "_country": F.when(none, F.get(F.filter(countries, lambda n: _standing_alone(lowered, n)), 0)),
        }
    )
    bare = F.coalesce("_city", "_country")
    display = tx.lookup({alias: display for alias, display, _ in fixed.CITIES}, F.col("_city"))
    named = F.coalesce(display, F.initcap("_country"))
    return df.withColumns(
        {
            "locations": F.when(bare.isNotNull(), F.array(named)).otherwise(_dedupe(F.col("_hits"))),
            "cur": F.when(bare.isNotNull(), _blank_at(F.col("cur"), F.instr(lowered, bare), F.length(bare))).otherwise(F.col("cur")),
        }
    ).drop("_clauses", "_hits", "_city", "_country")


def _industries(df: DataFrame) -> DataFrame:
    rows = F.from_json(
        F.lit(json.dumps([{"name": k, "terms": v} for k, v in fixed.INDUSTRY_TERMS.items()])),
        "array<struct<name:string,terms:array<string>>>",
    )
    lowered = F.lower("cur")
    named = F.transform(
        rows,
        lambda r: F.struct(
            r["name"].alias("name"), F.get(F.filter(r["terms"], lambda t: _standing_alone(lowered, t)), 0).alias("term")
        ),
    )
    df = df.withColumn("_named", F.filter(named, lambda r: r["term"].isNotNull()))
    cur = F.reduce(
        "_named", F.col("cur"), lambda text, r: _blank_at(text, F.instr(lowered, r["term"]), F.length(r["term"]))
    )
    return df.withColumns({"industries": F.transform("_named", lambda r: r["name"]), "cur": cur}).drop("_named")


def _companies(df: DataFrame) -> DataFrame:
    def is_company(v: Column) -> Column:
        key = tx.basic_normalize(v)
        other = fixed.NOT_A_COMPANY + list(fixed.INDUSTRY_TERMS)
        return ~key.isin(other) & places.resolve_place(v).isNull()

    clauses = F.transform(
        _matches(F.col("cur"), fixed.REQUEST_COMPANY),
        lambda m: F.struct(m["whole"].alias("whole"), _split_list(m["body"]).alias("items")),
    )
    df = df.withColumn(
        "_clauses", F.filter(clauses, lambda m: (F.size(m["items"]) > 0) & F.forall(m["items"], is_company))
    )
    return df.withColumns(
        {
            "companies": _dedupe(F.flatten(F.transform("_clauses", lambda m: m["items"]))),
            "cur": _consume(F.col("cur"), F.col("_clauses"), lambda m: F.length(m["whole"])),
        }
    ).drop("_clauses")


def _titles(df: DataFrame) -> DataFrame:
    rest = F.col("cur")
    for pattern in fixed.REQUEST_FILLER:
        rest = F.regexp_replace(rest, pattern, " ")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ .,\-]+|[ .,\-]+$", "")
    df = df.withColumn("_rest", rest)
    split = _split_list(F.col("_rest"))
    items = tx.let(split, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array("_rest")))
    spelled = F.transform(
        F.filter(items, lambda v: F.length(v) >= 2),
        lambda v: F.coalesce(F.initcap(tx.lookup(fixed.ROLE_ABBREVIATIONS, tx.basic_normalize(v))), v),
    )
    return df.withColumn("titles", _dedupe(spelled)).drop("_rest", "cur")


def structure_request_log(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests (query_id, raw) as rows of the request schema.

    Criteria are taken in the order experience, exclusions, keywords, remote,
    places, industries, companies; what is left names the role. Where nothing
    is recognised the whole phrase becomes the title, and ``parse_notes`` says so.
    """
    rows = requests.select("query_id", tx.strip(F.coalesce("raw", F.lit(""))).alias("raw"))
    rows = rows.withColumn("cur", F.col("raw"))
    for step in (_experience, _exclusions, _keywords, _remote, _locations, _industries, _companies, _titles):
        rows = step(rows)
    kept = max(1, min(limit or fixed.RESULT_LIMIT, fixed.MAX_RESULT_LIMIT))
    empty = F.col("raw") == ""
    unnamed = ~empty & (F.size("titles") == 0) & (F.size("keywords") == 0)
    placeless = ~empty & (F.size("locations") == 0) & ~F.col("remote_only")
    notes = F.concat(
        "parse_notes",
        F.array_compact(
            F.array(
                F.when(empty, F.lit("Empty search request.")),
                F.when(unnamed, F.lit("No role title recognised — searching on the whole phrase instead.")),
                F.when(placeless, F.lit("No location given — searching everywhere the sources cover.")),
            )
        ),
    )
    rows = rows.withColumns(
        {
            "titles": F.when(unnamed, F.array("raw")).otherwise(F.col("titles")),
            "parse_notes": notes, "parse_method": F.lit("rules"), "max_age_days": F.lit(45), "limit": F.lit(kept),
        }
    )
    names = [part.split()[0] for part in REQUEST_SCHEMA.split(", ")]
    return rows.select(*names)
