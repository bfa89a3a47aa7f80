"""URL column functions, built on the RFC 3986 component pattern.

Spark's own ``parse_url`` gives NULL for many addresses seen in the wild, so
components are taken with one regular expression instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx

COMPONENTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
IPV4_PATTERN = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, COMPONENTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, COMPONENTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, COMPONENTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, COMPONENTS, 4)


def hostname(url: Column) -> Column:
    """Lower-case host without user info, port or brackets; '' when there is none."""
    authority = F.substring_index(netloc(url), "@", -1)
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(bracketed != "", bracketed).otherwise(F.substring_index(authority, ":", 1)))


def port_text(url: Column) -> Column:
    """Port as written, '' when there is none."""
    authority = F.substring_index(netloc(url), "@", -1)
    return F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:\[\]]*):([\s\S]+)$", 1)


def _drop_www(host: Column) -> Column:
    return F.when(F.startswith(host, F.lit("www.")), F.substr(host, F.lit(5))).otherwise(host)


def _bare_path(p: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/"))


def percent_encode(c: Column, keep_slash: bool = False, plus: bool = True) -> Column:
    """Percent-encode as web forms do; blanks become '+' or '%20'."""
    out = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    if not plus:
        out = F.replace(out, F.lit("+"), F.lit("%20"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def _kept_params(q: Column) -> Column:
    """Query parameters with a value and without tracking names, re-encoded."""
    pairs = F.filter(F.split(q, "&"), lambda p: p.rlike("^[^=]*=[\\s\\S]"))

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    split = F.transform(
        pairs,
        lambda p: F.struct(
            decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
            decoded(F.regexp_extract(p, "^[^=]*=([\\s\\S]*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(split, lambda p: ~p["k"].rlike(fixed.TRACKING_PARAM_PATTERN))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(percent_encode(p["k"]), F.lit("="), percent_encode(p["v"]))), "&"
    )


def _parts(url: Column) -> Column:
    """The components of an address, each taken once."""
    return F.struct(
        url.alias("url"), scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"),
        query(url).alias("query"),
    )


def canonicalize_url(c: Column) -> Column:
    """One stable address per page: no tracking parameters, fragment, 'www.' or trailing slash."""

    def rebuilt(p: Column) -> Column:
        params = F.when(p["query"] == "", F.lit("")).otherwise(_kept_params(p["query"]))
        whole = F.concat(
            p["scheme"], F.lit("://"), _drop_www(F.lower(p["netloc"])), _bare_path(p["path"]),
            tx.let(params, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))),
        )
        return F.when((p["scheme"] == "") | (p["netloc"] == ""), p["url"]).otherwise(whole)

    return tx.let(tx.strip(c), lambda url: tx.let(_parts(url), rebuilt))


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment; the query is kept."""

    def rebuilt(p: Column) -> Column:
        default = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
        port = F.when((p["port"] == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
        whole = F.concat(
            p["scheme"], F.lit("://"), p["host"], port, _bare_path(F.regexp_replace(p["path"], r";[^/]*$", "")),
            F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
        )
        return F.when(p["host"] == "", p["url"]).otherwise(whole)

    def parts(url: Column) -> Column:
        return F.struct(
            url.alias("url"), scheme(url).alias("scheme"), hostname(url).alias("host"), port_text(url).alias("port"),
            path(url).alias("path"), query(url).alias("query"),
        )

    return tx.let(tx.strip(c), lambda url: tx.let(parts(url), rebuilt))


def extract_domain(c: Column) -> Column:
    """Host without 'www.' of an address whose scheme may be missing."""
    lowered = F.lower(tx.strip(c))
    url = F.when(F.contains(lowered, F.lit("://")), lowered).otherwise(F.concat(F.lit("https://"), lowered))
    return _drop_www(F.regexp_replace(hostname(url), r"\.+$", ""))


def employer_domain(c: Column) -> Column:
    """The employer's own host, NULL for an IP, a bare name or a job board's host."""
    markers = "|".join(m.replace(".", r"\.") for m in fixed.THIRD_PARTY_HOSTS)

    def usable(host: Column) -> Column:
        bad = (
            (host == "") | host.rlike(IPV4_PATTERN) | F.contains(host, F.lit(":"))
            | ~F.contains(host, F.lit(".")) | host.rlike(markers)
        )
        return F.when(~bad, host)

    return tx.let(_drop_www(hostname(tx.strip(c))), usable)


def board_host_matches(url: Column, token: Column) -> Column:
    """Whether the address is on a job board host and carries the board token."""
    hosts = "|".join(h.replace(".", r"\.") for row in fixed.BOARD_PLATFORMS for h in row[4])
    lowered = F.lower(url)
    return lowered.rlike(hosts) & F.contains(lowered, F.lower(token))


def people_search_url(company: Column, terms: Column) -> Column:
    """A people-search link the user can open; it names nobody."""
    words = tx.strip(F.concat(company, F.lit(" "), terms))
    return F.concat(
        F.lit("https://www.linkedin.com/search/results/people/?keywords="),
        percent_encode(words, keep_slash=True, plus=False),
    )


def url_path(c: Column) -> Column:
    return F.coalesce(F.nullif(path(c), F.lit("")), F.lit("/"))
