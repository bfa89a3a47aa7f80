"""Gazetteer column functions: places, countries, role titles, industries.

The gazetteer is a fixed list of under a hundred names, so lookups are
constant maps inside the expression instead of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx


def _plain(display: str) -> str:
    return display.lower().replace("ã", "a")


def _city_map() -> dict[str, tuple[str, str]]:
    return {alias: (display, code) for alias, display, code in fixed.CITIES}


def _place_map() -> Column:
    """Normalised spelling -> (display, country); a city wins over a country of that name."""
    rows = {name: (name.title(), code) for name, code in fixed.COUNTRIES.items()} | _city_map()
    named = {key: {"display": display, "country": code} for key, (display, code) in rows.items()}
    return tx.lit_map(named, "struct<display:string,country:string>")


def resolve_place(c: Column) -> Column:
    """Struct (display, country) of a place phrase, NULL when it is not a known place.

    The whole phrase is tried first, then the part before the first comma.
    """
    places = _place_map()
    whole = F.element_at(places, tx.basic_normalize(c))
    head = F.element_at(places, tx.basic_normalize(F.substring_index(c, ",", 1)))
    return F.when(F.contains(c, F.lit(",")), F.coalesce(whole, head)).otherwise(whole)


def resolve_location(df: DataFrame, col: str) -> DataFrame:
    """Add ``place_name`` and ``place_country`` for a location column."""
    place = resolve_place(F.col(col))
    return df.withColumns({"place_name": place["display"], "place_country": place["country"]})


def countries_for(locations: Column) -> Column:
    """Country codes implied by a list of places, first seen first."""
    codes = F.transform(locations, lambda v: resolve_place(v)["country"])
    return F.array_distinct(F.filter(codes, lambda v: v.isNotNull()))


def canonical_place(c: Column) -> Column:
    """One comparable name for a location: its first comma part that is a known place."""
    names = {name: name for name in fixed.COUNTRIES} | {
        alias: _plain(display) for alias, display, _ in fixed.CITIES
    }
    parts = F.transform(F.split(c, ","), lambda p: tx.lookup(names, tx.basic_normalize(p)))
    known = F.get(F.filter(parts, lambda p: p.isNotNull()), 0)
    return F.when(tx.is_blank(c), F.lit("")).otherwise(F.coalesce(known, tx.normalize_location(c)))


def duplicate_key(company: Column, title: Column, location: Column) -> Column:
    """Fingerprint of one role at one company in one place, word order ignored."""
    words = F.array_join(F.array_sort(F.array_distinct(F.split(tx.normalize_title(title), " "))), " ")
    return F.sha2(
        F.concat_ws("|", tx.normalize_company_name(company), F.trim(words), canonical_place(location)), 256
    )


def _alias_rows() -> list[tuple[str, str]]:
    rows: dict[tuple[str, str], None] = {}
    for alias, display, _ in fixed.CITIES:
        rows[(display, alias)] = None
        rows[(display, _plain(display))] = None
    for name in fixed.COUNTRIES:
        rows[(name.title(), name)] = None
    return list(rows)


def location_aliases_of(name: Column) -> Column:
    """Every normalised spelling of a place; an unknown place has its own name only."""
    grouped: dict[str, list[str]] = {}
    for display, alias in _alias_rows():
        grouped.setdefault(display, []).append(alias)

    def spellings(display: Column) -> Column:
        known = F.coalesce(tx.lookup(grouped, display, "array<string>"), tx.str_array([]))
        return F.array_union(known, F.array(tx.basic_normalize(display), tx.basic_normalize(name)))

    found = tx.let(F.coalesce(resolve_place(name)["display"], name), spellings)
    return F.filter(found, lambda a: a != "")


def country_aliases_of(code: Column) -> Column:
    """Names of a country."""
    grouped: dict[str, list[str]] = {}
    for name, iso in fixed.COUNTRIES.items():
        grouped.setdefault(iso, []).append(name)
    return F.coalesce(tx.lookup(grouped, code, "array<string>"), tx.str_array([]))


def location_aliases(spark: SparkSession) -> DataFrame:
    """Dimension table (display, alias) of every known spelling."""
    return spark.createDataFrame(_alias_rows(), "display string, alias string")


def country_aliases(spark: SparkSession) -> DataFrame:
    """Dimension table (country, alias)."""
    return spark.createDataFrame([(c, n) for n, c in fixed.COUNTRIES.items()], "country string, alias string")


def is_remote_term(c: Column) -> Column:
    return tx.basic_normalize(c).isin(fixed.REMOTE_TERMS)


def expand_title(c: Column) -> Column:
    """The title, its spelled-out abbreviation and its close variants, without repeats."""
    variants: dict[str, list[str]] = {k: [v] for k, v in fixed.ROLE_ABBREVIATIONS.items()}
    for key, more in fixed.TITLE_EXPANSIONS.items():
        variants[key] = variants.get(key, []) + more

    def fresh(key: Column) -> Column:
        extra = F.coalesce(tx.lookup(variants, key, "array<string>"), tx.str_array([]))
        return F.filter(extra, lambda v: v != key)

    return F.concat(F.array(tx.strip(c)), tx.let(tx.basic_normalize(c), fresh))


def search_titles(titles: Column) -> Column:
    """Requested titles with their variants; the first spelling of each wins."""
    return tx.first_by_key(F.flatten(F.transform(titles, expand_title)), tx.basic_normalize)


def industry_keywords(c: Column) -> Column:
    """Terms of a known industry, else the lowered name itself."""
    known = tx.lookup(fixed.INDUSTRY_TERMS, tx.basic_normalize(c), "array<string>")
    return F.coalesce(known, F.array(F.lower(tx.strip(c))))
