"""String column functions: accent folding, normalisers, token sets, keys.

All of them are built from Spark's own expressions, so they stay inside
whole-stage code generation and can be used in any select, join or filter.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed

# Every character Python and the web treat as white space.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def lit_map(pairs: dict, value_type: str = "string") -> Column:
    """A constant map; Catalyst folds it to one literal."""
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string,{value_type}>")


def str_array(values) -> Column:
    """A constant array of strings, typed even when it is empty."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def lookup(pairs: dict, key: Column, value_type: str = "string") -> Column:
    """Value of ``key`` in a constant map, NULL when it is absent."""
    return F.element_at(lit_map(pairs, value_type), key)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    Column expressions are trees: using a costly one five times costs it five
    times, and nesting multiplies. A one-element transform binds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def collapse(c: Column) -> Column:
    """White space runs become one blank; both ends are trimmed."""
    # a blank on its own stays as it is: only longer runs and other characters are matched
    other = SPACE.replace(r"\s", r"\t\n\x0b\f\r")
    return F.trim(F.regexp_replace(c, f" {SPACE}+|{other}{SPACE}*", " "))


def strip(c: Column) -> Column:
    """Trim any white space at both ends, not only blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str], str]:
    """Folding tables generated from the Unicode decomposition rule.

    Returns the characters to translate, their one-to-one replacements, the
    characters that expand to several, and a character class that covers the
    latter loosely. Combining marks follow the replaced characters in the first
    string, so ``translate`` deletes them.
    """
    single, target, marks, several = [], [], [], {}
    for cp in list(range(0x80, 0xAC00)) + list(range(0xF900, 0x10000)) + list(range(0x1D400, 0x1D800)):
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if folded == ch:
            continue
        if len(folded) == 1:
            single.append(ch)
            target.append(folded)
        elif folded:
            several[ch] = folded
    ranges: list[list[int]] = []
    for cp in sorted(map(ord, several)):
        if ranges and cp - ranges[-1][1] <= 64:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    # The outer range is tested first, so ASCII characters cost one comparison.
    loose = r"[\x{80}-\x{ffff}&&[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges) + "]]"
    return "".join(single + marks), "".join(target), several, loose


def strip_accents(c: Column) -> Column:
    """Fold accents and compatibility forms to their base characters.

    Plain ASCII passes through untouched; other text takes one ``translate``.
    The few characters that expand (ligatures, fractions, units) are replaced
    one distinct character at a time, and only in values that hold any. Hangul
    syllables are left composed.
    """
    chars, targets, several, loose = _folding()

    # One delimited string is a much lighter constant than a map of a thousand entries.
    table = "\x01" + "".join(f"{ch}\x02{folded}\x01" for ch, folded in several.items())

    def spelled(ch: Column) -> Column:
        name = F.concat(F.lit("\x01"), ch, F.lit("\x02"))
        value = F.split_part(F.split_part(F.lit(table), name, F.lit(2)), F.lit("\x01"), F.lit(1))
        return F.when(F.contains(F.lit(table), name), value).otherwise(ch)

    def fold(text: Column) -> Column:
        present = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({loose})"), F.lit(1)))
        expanded = F.reduce(present, text, lambda done, ch: F.replace(done, ch, spelled(ch)))
        return (
            F.when(~text.rlike(r"[^\x00-\x7F]"), text)
            .when(text.rlike(loose), F.translate(expanded, chars, targets))
            .otherwise(F.translate(text, chars, targets))
        )

    return let(c, fold)


def basic_normalize(c: Column) -> Column:
    """Lower case, no accents, no punctuation, single blanks; NULL becomes ''."""
    folded = F.lower(strip_accents(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def tokens(normalized: Column) -> Column:
    """Words of an already normalised value."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def token_set_of(normalized: Column) -> Column:
    """Distinct words longer than one character of a normalised value."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) > 1))


def token_set(c: Column) -> Column:
    return token_set_of(basic_normalize(c))


def _without_suffixes(base: Column) -> Column:
    drop = str_array(fixed.COMPANY_SUFFIXES)
    kept = F.array_join(F.filter(F.split(base, " "), lambda t: ~F.array_contains(drop, t)), " ")
    return let(kept, lambda k: F.when(k != "", k).otherwise(base))


def normalize_company_name(c: Column) -> Column:
    """Company name without legal and generic suffixes; kept whole if nothing is left."""
    return let(basic_normalize(c), _without_suffixes)


def normalize_title(c: Column) -> Column:
    """Job title without posting noise, with common abbreviations spelled out."""
    text = F.lower(strip_accents(F.coalesce(c, F.lit(""))))
    for pattern in fixed.TITLE_NOISE:
        text = F.regexp_replace(text, "(?idU)" + pattern, " ")
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    for pattern, replacement in fixed.TITLE_REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return collapse(text)


def normalize_location(c: Column) -> Column:
    """Canonical place text; remote wording becomes 'remote' or 'remote india'."""

    def canonical(base: Column) -> Column:
        place = base
        for alias, name in fixed.LOCATION_REWRITES:
            place = F.regexp_replace(place, rf"\b{alias}\b", name)
        remote = F.when(base.rlike(fixed.LOCATION_INDIA_PATTERN), F.lit("remote india")).otherwise(F.lit("remote"))
        return F.when(base.rlike(fixed.LOCATION_REMOTE_PATTERN), remote).otherwise(F.trim(place))

    return let(basic_normalize(c), canonical)


def seniority_level(c: Column) -> Column:
    """Highest seniority named in a title (0..8), NULL when none is."""
    return F.array_max(
        F.transform(F.split(normalize_title(c), " "), lambda t: lookup(fixed.SENIORITY, t, "int"))
    )


def overlap_ratio(left: Column, right: Column) -> Column:
    """Jaccard of two duplicate-free token arrays, 0 when either is empty."""

    def ratio(both: Column) -> Column:
        a, b = F.size(both["a"]), F.size(both["b"])
        shared = F.size(F.array_intersect(both["a"], both["b"]))
        return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(let(shared, lambda n: n / (a + b - n)))

    return let(F.struct(left.alias("a"), right.alias("b")), ratio)


def jaccard(a: Column, b: Column) -> Column:
    return overlap_ratio(token_set(a), token_set(b))


def token_set_ops(a: Column, b: Column) -> Column:
    """Sizes of the shared and the combined token set of two values."""

    def sizes(both: Column) -> Column:
        return F.struct(
            F.size(F.array_intersect(both["a"], both["b"])).alias("shared"),
            F.size(F.array_union(both["a"], both["b"])).alias("combined"),
        )

    return let(F.struct(token_set(a).alias("a"), token_set(b).alias("b")), sizes)


def content_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the bar-joined normalised parts; NULL counts as ''."""
    return F.sha2(F.concat_ws("|", *[basic_normalize(p) for p in parts]), 256)


def padded_contains(haystack: Column, needle: Column) -> Column:
    """Whole-word containment of one normalised value in another."""
    return F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def contains_term(haystack: Column, term: Column) -> Column:
    text = basic_normalize(haystack)
    return let(basic_normalize(term), lambda needle: (needle != "") & padded_contains(text, needle))


def truncate_text(c: Column, limit: int = 280) -> Column:
    """Collapse white space and cut to ``limit`` characters, ending in an ellipsis."""

    def cut(text: Column) -> Column:
        short = F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))
        return F.when(F.length(text) <= limit, text).otherwise(short)

    return let(collapse(F.coalesce(c, F.lit(""))), cut)


def company_tokens_of(normalized_company: Column) -> Column:
    generic = str_array(fixed.GENERIC_COMPANY_WORDS)
    return F.filter(
        token_set_of(normalized_company), lambda t: ~F.array_contains(generic, t) & (F.length(t) > 2)
    )


def company_tokens(c: Column) -> Column:
    """Words of a company name distinctive enough to recognise it by."""
    return company_tokens_of(normalize_company_name(c))


def excerpt_around(text: Column, needle: Column, width: int = 160) -> Column:
    """A window of ``width`` characters round the first occurrence of ``needle``."""

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - width // 2)
        return F.when(at == 0, F.left(text, F.lit(width))).otherwise(collapse(F.substring(text, start, F.lit(width))))

    return let(F.instr(F.lower(text), F.lower(needle)), cut)


def number_text(c: Column) -> Column:
    """A number without a trailing '.0'."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def experience_label(min_years: Column, max_years: Column, text: Column) -> Column:
    """Human phrase for an experience requirement, honest about what is unknown."""
    low, high = number_text(min_years), number_text(max_years)
    return (
        F.when(~is_blank(text), text)
        .when(min_years.isNull() & max_years.isNull(), F.lit("Not stated"))
        .when(max_years.isNull(), F.concat(low, F.lit("+ years")))
        .when(min_years.isNull(), F.concat(F.lit("Up to "), high, F.lit(" years")))
        .otherwise(F.concat(low, F.lit("–"), high, F.lit(" years")))
    )


def humanize_days(days: Column) -> Column:
    """Age of a posting as a phrase."""

    def whole(x: Column) -> Column:
        return F.bround(x).cast("bigint").cast("string")

    return (
        F.when(days.isNull(), F.lit("date unknown"))
        .when(days < 1, F.lit("today"))
        .when(days < 2, F.lit("yesterday"))
        .when(days < 14, F.concat(whole(days), F.lit(" days ago")))
        .when(days < 60, F.concat(whole(days / 7), F.lit(" weeks ago")))
        .otherwise(F.concat(whole(days / 30), F.lit(" months ago")))
    )


def looks_remote(*values: Column) -> Column:
    """Whether any of the values mentions remote work."""
    blob = F.lower(F.concat_ws(" ", *values))
    return let(blob, lambda b: reduce(lambda x, y: x | y, [F.contains(b, F.lit(term)) for term in fixed.LOOKS_REMOTE_TERMS]))


def first_by_key(values: Column, key) -> Column:
    """Ordered distinct: keep the first value for each non-empty ``key(value)``."""
    keyed = F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))

    def firsts(pairs: Column) -> Column:
        keys = pairs["k"]
        kept = F.filter(
            pairs, lambda kv, i: (kv["k"] != "") & (F.array_position(keys, kv["k"]) == (i + 1).cast("bigint"))
        )
        return F.transform(kept, lambda kv: kv["v"])

    return let(keyed, firsts)


def clean_list(c: Column, max_items: int = 12, max_len: int | None = 120) -> Column:
    """Trim the items of a list, drop blank ones, cut long ones, keep the first few."""
    kept = F.filter(F.transform(c, strip), lambda v: v.isNotNull() & (v != ""))
    if max_len is not None:
        kept = F.transform(kept, lambda v: F.left(v, F.lit(max_len)))
    return F.slice(kept, 1, max_items)
