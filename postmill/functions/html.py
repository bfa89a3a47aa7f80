"""Columns read from HTML: visible text, structured data, addresses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx

# One pass, leftmost first, so a comment inside a script (or the reverse) is safe.
INVISIBLE = (
    r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>"
    r"|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>|!doctype[^>]*>)"
)
TAG = r"<[/a-zA-Z][^>]*>"
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"),
    ("&lsquo;", "‘"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]
JSONLD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
MAILTO = r"""(?is)<a\b[^>]*\bhref\s*=\s*(?:"\s*mailto:([^"]*)"|'\s*mailto:([^']*)')[^>]*>(.*?)</a\s*>"""


def html_to_text(c: Column, limit: int | None = None) -> Column:
    """Readable text of a page: hidden elements and tags out, white space collapsed.

    A chain of built-in expressions that knows the common named entities.
    ``limit`` cuts the result.
    """
    page = F.coalesce(c, F.lit(""))

    bare = F.regexp_replace(F.regexp_replace(page, INVISIBLE, " "), TAG, " ")
    plain = bare
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    text = F.when(F.contains(page, F.lit("&")), tx.collapse(plain)).otherwise(tx.collapse(bare))
    return text if limit is None else F.left(text, F.lit(limit))


# --- structured data ----------------------------------------------------------


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _flat_objects(scripts: pd.Series) -> pd.Series:
    """Objects of each page's JSON scripts in document order, following lists and @graph to any depth."""

    def objects(raw: str) -> list[str]:
        try:
            todo, out = [json.loads(raw)], []
        except (ValueError, RecursionError):
            return []
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                out.append(json.dumps(value, ensure_ascii=False))
                value = value.get("@graph")
                value = [value] if isinstance(value, dict) else value
            if isinstance(value, list):
                todo += reversed(value)
        return out

    return scripts.map(lambda raws: [] if raws is None else [o for raw in raws for o in objects(raw)])


def jsonld_blocks(html: Column) -> Column:
    """ARRAY<VARIANT> of the page's linked-data objects; unreadable blocks are skipped."""
    raw = F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1))
    flat = F.pandas_udf(_flat_objects, "array<string>")(raw)
    return F.transform(F.coalesce(flat, F.array().cast("array<string>")), lambda r: F.try_parse_json(r))


def text_of(block: Column, key: str) -> Column:
    """String value of a key of a JSON object, NULL when absent or empty."""
    return F.nullif(F.try_variant_get(block, f'$["{key}"]', "string"), F.lit(""))


def has_type(block: Column, name: str) -> Column:
    """Whether the object's ``@type`` (or ``type``) is, or lists, ``name``."""

    def names(key: str) -> Column:
        many = F.try_variant_get(block, f'$["{key}"]', "array<string>")
        return F.coalesce(many, F.array(text_of(block, key)))

    declared = F.when(text_of(block, "@type").isNotNull(), names("@type")).otherwise(names("type"))
    return F.coalesce(F.array_contains(F.transform(declared, F.lower), name.lower()), F.lit(False))


def extract_jsonld(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per linked-data object: the page's columns, ``pos`` and ``block``."""
    return pages.select("*", F.posexplode(jsonld_blocks(F.col(html))).alias("pos", "block"))


def job_posting_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(has_type(F.col("block"), "JobPosting"))


def hiring_organization(block: Column) -> Column:
    """Employer named by a posting object: the organisation's name, or the plain string."""
    org = F.try_variant_get(block, '$["hiringOrganization"]', "variant")
    return F.when(_is_object(org), text_of(org, "name")).otherwise(text_of(block, "hiringOrganization"))


# --- addresses ------------------------------------------------------------------


def extract_emails(c: Column) -> Column:
    """Distinct lower-case addresses in a text, first seen first."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({fixed.EMAIL_PATTERN})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.lower(m), r"\.+$", "")))


def mailto_links(html: Column) -> Column:
    """ARRAY<STRUCT<email, anchor>> of the page's mailto links."""

    def group(n: int) -> Column:
        return F.regexp_extract_all(html, F.lit(MAILTO), F.lit(n))

    links = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("t"))
    plain = F.transform(
        links,
        lambda x: F.struct(
            F.lower(tx.strip(F.substring_index(F.concat(x["a"], x["b"]), "?", 1))).alias("email"),
            html_to_text(x["t"], None).alias("anchor"),
        ),
    )
    return F.filter(plain, lambda x: x["email"].rlike(f"^(?:{fixed.EMAIL_PATTERN})$"))


def extract_mailto(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per mailto link: the page's columns, ``pos``, ``email`` and ``anchor``."""
    links = pages.select("*", F.posexplode(mailto_links(F.col(html))).alias("pos", "link"))
    return links.withColumns({"email": F.col("link.email"), "anchor": F.col("link.anchor")}).drop("link")


def email_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def is_personal_address(email: Column) -> Column:
    return email_domain(email).isin(fixed.PERSONAL_DOMAINS)


def _local_part_in(email: Column, words: list[str]) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    return local.isin(words) | F.regexp_extract(local, r"^([^.\-_+]*)", 1).isin(words)


def is_role_address(email: Column) -> Column:
    return _local_part_in(email, fixed.ROLE_LOCALPARTS)


def is_talent_address(email: Column) -> Column:
    return _local_part_in(email, fixed.TALENT_LOCALPARTS)


def email_kind(email: Column) -> Column:
    """'personal', 'talent', 'role' or 'individual'."""
    return (
        F.when(is_personal_address(email), F.lit("personal"))
        .when(is_talent_address(email), F.lit("talent"))
        .when(is_role_address(email), F.lit("role"))
        .otherwise(F.lit("individual"))
    )


def clean_email(c: Column, domain: Column) -> Column:
    """An address fit to record for a company, NULL when it is not.

    Personal mailboxes never are; with a known company domain the address must
    be on it or below it.
    """

    def accepted(email: Column) -> Column:
        host = F.substring_index(email, "@", -1)
        foreign = ~tx.is_blank(domain) & (host != domain) & ~F.endswith(host, F.concat(F.lit("."), domain))
        bad = ~F.contains(email, F.lit("@")) | (F.length(email) > 320) | is_personal_address(email)
        return F.when(email.isNotNull() & ~bad & ~F.coalesce(foreign, F.lit(False)), email)

    bare = F.substring_index(F.regexp_replace(F.lower(tx.strip(c)), "^mailto:", ""), "?", 1)
    return tx.let(tx.strip(bare), accepted)


def classify_contact_title(c: Column) -> Column:
    """Hiring role a job title stands for, NULL when it is unrelated to hiring."""
    role = F.lit(None).cast("string")
    for pattern, name in reversed(fixed.CONTACT_TITLES):
        role = F.when(c.rlike(pattern), F.lit(name)).otherwise(role)
    return role


def is_person_name(c: Column) -> Column:
    """Two to four capitalised words of at most 120 characters."""
    return c.rlike("(?U)" + fixed.PERSON_NAME_PATTERN) & (F.length(c) <= 120)
