"""SQL fragments for the checks, written for DuckDB and independent of the library."""

from __future__ import annotations

from postmill import fixed


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def toks(x: str) -> str:
    """Sorted distinct words of more than one character."""
    return f"list_sort(list_distinct(list_filter(string_split({norm(x)}, ' '), lambda t: length(t) > 1)))"


def company(x: str) -> str:
    kept = f"list_filter(string_split({norm(x)}, ' '), lambda t: NOT list_contains({lst(fixed.COMPANY_SUFFIXES)}, t))"
    return f"coalesce(nullif(array_to_string({kept}, ' '), ''), {norm(x)})"


def title(x: str) -> str:
    text = f"lower(strip_accents(coalesce({x}, '')))"
    for pattern in fixed.TITLE_NOISE:
        text = f"regexp_replace({text}, {q(pattern)}, ' ', 'gi')"
    text = f"trim(regexp_replace({text}, '[^a-z0-9]+', ' ', 'g'))"
    for pattern, new in fixed.TITLE_REWRITES:
        text = f"regexp_replace({text}, {q(pattern)}, {q(new)}, 'g')"
    return f"trim(regexp_replace({text}, ' +', ' ', 'g'))"


def location(x: str) -> str:
    place = norm(x)
    for alias, new in fixed.LOCATION_REWRITES:
        place = rf"regexp_replace({place}, '\b{alias}\b', '{new}', 'g')"
    return (
        f"CASE WHEN regexp_matches({norm(x)}, {q(fixed.LOCATION_REMOTE_PATTERN)}) THEN "
        f"CASE WHEN regexp_matches({norm(x)}, {q(fixed.LOCATION_INDIA_PATTERN)}) THEN 'remote india' ELSE 'remote' END "
        f"ELSE {place} END"
    )


def places_cte() -> str:
    """(k, display, country): every spelling the gazetteer knows."""
    rows = {n: (n.title(), c) for n, c in fixed.COUNTRIES.items()} | {a: (d, c) for a, d, c in fixed.CITIES}
    values = ", ".join(f"({q(k)}, {q(d)}, {q(c)})" for k, (d, c) in rows.items())
    return f"gazetteer(k, display, country) AS (VALUES {values})"


def place_map(column: str) -> str:
    rows = {n: (n.title(), c) for n, c in fixed.COUNTRIES.items()} | {a: (d, c) for a, d, c in fixed.CITIES}
    pick = 0 if column == "display" else 1
    return "MAP {" + ", ".join(f"{q(k)}: {q(v[pick])}" for k, v in rows.items()) + "}"


def canonical_place(x: str) -> str:
    found = (
        f"list_filter(list_transform(string_split({x}, ','), lambda p: ({place_map('display')})[{norm('p')}]), "
        f"lambda p: p IS NOT NULL)[1]"
    )
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE coalesce({norm_of_null(found)}, {location(x)}) END"


def norm_of_null(x: str) -> str:
    return f"nullif({norm(x)}, '')"


def url(x: str) -> str:
    """Canonical address, for the plain addresses of the sample tables."""
    host = f"regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract({x}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = f"regexp_extract({x}, '\\?([^#]*)', 1)"
    kept = (
        f"array_to_string(list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '^[^=]*=.') "
        f"AND NOT regexp_matches(p, {q(fixed.TRACKING_PARAM_PATTERN)})), '&')"
    )
    return (
        f"lower(regexp_extract({x}, '^([a-zA-Z]+)://', 1)) || '://' || {host} || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"
    )


def dup_key(company_x: str, title_x: str, location_x: str) -> str:
    words = f"array_to_string(list_sort(list_distinct(string_split({title(title_x)}, ' '))), ' ')"
    return f"sha256({company(company_x)} || '|' || {words} || '|' || {canonical_place(location_x)})"


def case_first(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def level(x: str) -> str:
    return case_first((f"regexp_matches({x}, {q(p)})", q(n)) for p, n in fixed.EXPERIENCE_LEVELS)


def years(x: str, group: int, pattern: str) -> str:
    return f"least(CAST(nullif(regexp_extract({x}, {q(pattern)}, {group}), '') AS DOUBLE), 40.0)"


def exp_min(x: str) -> str:
    f = fixed
    return case_first(
        [
            (
                f"regexp_matches({x}, {q(f.EXPERIENCE_RANGE)})",
                f"least({years(x, 1, f.EXPERIENCE_RANGE)}, {years(x, 2, f.EXPERIENCE_RANGE)})",
            ),
            (f"regexp_matches({x}, {q(f.EXPERIENCE_MAXIMUM)})", "0.0"),
            (f"regexp_matches({x}, {q(f.EXPERIENCE_PLUS)})", years(x, 1, f.EXPERIENCE_PLUS)),
            (f"regexp_matches({x}, {q(f.EXPERIENCE_MINIMUM)})", years(x, 1, f.EXPERIENCE_MINIMUM)),
        ]
    )


def exp_max(x: str) -> str:
    f = fixed
    return case_first(
        [
            (
                f"regexp_matches({x}, {q(f.EXPERIENCE_RANGE)})",
                f"greatest({years(x, 1, f.EXPERIENCE_RANGE)}, {years(x, 2, f.EXPERIENCE_RANGE)})",
            ),
            (f"regexp_matches({x}, {q(f.EXPERIENCE_MAXIMUM)})", years(x, 1, f.EXPERIENCE_MAXIMUM)),
        ]
    )


def exp_text(x: str) -> str:
    f = fixed
    return case_first(
        (f"regexp_matches({x}, {q(p)})", f"trim(regexp_extract({x}, {q(p)}))")
        for p in (f.EXPERIENCE_RANGE, f.EXPERIENCE_MAXIMUM, f.EXPERIENCE_PLUS, f.EXPERIENCE_MINIMUM)
    )


def level_year(x: str, which: int) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {v[which]}" for k, v in fixed.LEVEL_YEARS.items()) + " END"


def bound(lo: str, hi: str, lvl: str, which: int) -> str:
    stated = f"({lo} IS NOT NULL OR {hi} IS NOT NULL)"
    value = f"coalesce({lo}, 0.0)" if which == 0 else f"coalesce({hi}, 40.0)"
    return f"CASE WHEN {stated} THEN {value} ELSE {level_year(lvl, which)} END"


def label_case(x: str, labels: dict, default: str = "NULL") -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in labels.items()) + f" ELSE {default} END"


def within(x: str, values) -> str:
    return f"{x} IN (" + ", ".join(q(v) for v in values) + ")"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def html_text(x: str) -> str:
    hidden = (
        r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
        r"|<template\b.*?</template\s*>|<!doctype[^>]*>"
    )
    text = f"regexp_replace(regexp_replace(coalesce({x}, ''), {q(hidden)}, ' ', 'g'), '<[/a-zA-Z][^>]*>', ' ', 'g')"
    for entity, char in [
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"),
        ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ldquo;", "“"),
        ("&rdquo;", "”"), ("&amp;", "&"),
    ]:
        text = f"replace({text}, {q(entity)}, {q(char)})"
    return f"trim(regexp_replace({text}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g'))"


def due(as_of: str) -> str:
    return f"coalesce(status NOT IN ('REJECTED', 'CLOSED') AND follow_up_date <= CAST({as_of} AS DATE), false)"
