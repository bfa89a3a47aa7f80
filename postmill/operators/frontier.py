"""Crawl planning over tables of addresses, rules and attempts."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import text as tx
from postmill.functions import urls
from postmill.plans.skew import first_k, ordered_chunks, running
from postmill.session import checkpoint

# --- network addresses -----------------------------------------------------------


def _hex_key(address) -> str:
    return f"{address.version}:{int(address):0{8 if address.version == 4 else 32}x}"


def network_table(spark: SparkSession, cidrs: Iterable[str] | None = None) -> DataFrame:
    """Dimension table (cidr, low, high) of networks that must not be fetched from.

    Bounds are hexadecimal strings, so one string comparison covers IPv4 and IPv6.
    """
    if cidrs is None:
        cidrs = fixed.BLOCKED_NETWORKS + fixed.NON_GLOBAL_NETWORKS + [
            f"{a}/{128 if ':' in a else 32}" for a in fixed.METADATA_ADDRESSES
        ]
    rows = []
    for cidr in cidrs:
        pieces = [ipaddress.ip_network(cidr)]
        for hole in map(ipaddress.ip_network, fixed.GLOBAL_EXCEPTIONS):
            pieces = [
                piece
                for p in pieces
                for piece in (p.address_exclude(hole) if p.version == hole.version and hole.subnet_of(p) else [p])
            ]
        rows += [(cidr, _hex_key(p.network_address), _hex_key(p.broadcast_address)) for p in pieces]
    return spark.createDataFrame(rows, "cidr string, low string, high string")


def ip_key(ip: Column) -> Column:
    """Sortable key of an address, NULL when it is not one."""
    octets = F.split(ip, r"\.")
    four = F.concat(
        F.lit("4:"), *[F.lpad(F.lower(F.hex(F.get(octets, i).try_cast("int"))), 2, "0") for i in range(4)]
    )
    sides = F.split(F.lower(ip), "::")

    def groups(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda g: g != "")

    left, right = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    six = F.concat(F.lit("6:"), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))
    compressed = F.contains(ip, F.lit("::"))
    valid = (
        ip.rlike(r"(?i)^[0-9a-f:]{2,39}$")
        & ~ip.rlike(r"(?i)[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")
        & F.when(compressed, missing >= 1).otherwise(missing == 0)
    )
    return F.when(ip.rlike(urls.IPV4_PATTERN), four).when(valid, six)


def disjoint_ranges(networks: DataFrame) -> DataFrame:
    """(low, high) of a table of ranges that may meet or nest, as ranges that don't, by running maxima over chunks."""
    keys, order = ["_all"], ["low", "high"]
    rows = networks.select(F.left("low", F.lit(2)).alias("_all"), "low", "high").distinct()
    ready = ordered_chunks(rows, keys, order)
    ready = running(running(ready, keys, order, {"_top": ("max", F.col("high"))}), keys, order, {"_before": ("previous", F.col("_top"))})
    opens = F.when(F.col("_before").isNull() | (F.col("low") > F.col("_before")), F.col("low"))
    named = running(ready.withColumn("_open", opens), keys, order, {"_island": ("max", F.col("_open"))})
    return named.groupBy(F.col("_island").alias("low")).agg(F.max("high").alias("high"))


def shared_prefix(low: Column, high: Column) -> Column:
    """The longest beginning that the two ends of a range share."""
    length = F.size(F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.left(low, i) == F.left(high, i)))
    return F.left(low, length)


def ip_cidr_join(ips: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Add ``is_public``: a readable address that lies in none of the networks.

    An address within a range begins with what both ends of the range share, so the
    ranges are found by equality under that prefix, of any length and for a list
    of any size. Ranges are made disjoint first: then a prefix has at most 15, as each
    spans another pair of neighbouring next digits, and no list of one prefix is long.
    """
    keyed = ips.withColumn("_key", ip_key(F.col(ip)))
    ranges = disjoint_ranges(networks).withColumn("_prefix", shared_prefix(F.col("low"), F.col("high")))
    lengths = F.sequence(F.lit(2), F.length("_key"))
    looked = keyed.select("_key").filter("_key IS NOT NULL").distinct().select("_key", F.explode(F.transform(lengths, lambda i: F.left("_key", i))).alias("_prefix"))
    hits = looked.join(ranges, "_prefix").filter(F.col("_key").between(F.col("low"), F.col("high"))).select("_key").distinct().withColumn("_blocked", F.lit(True))
    public = F.col("_key").isNotNull() & F.col("_blocked").isNull()
    return keyed.join(hits, "_key", "left").withColumn("is_public", public).drop("_key", "_blocked")


def url_guard(urls_df: DataFrame, dns: DataFrame, networks: DataFrame, allow_private: bool = False) -> DataFrame:
    """Add ``reject_reason``, NULL for an address that may be fetched.

    Checks run in a fixed order and the first failure is reported. ``dns`` is a
    table (host, ip); a literal address resolves to itself.
    """
    raw = tx.strip(F.coalesce(F.col("url"), F.lit("")))
    scheme, host = urls.scheme(raw), F.regexp_replace(urls.hostname(raw), r"\.+$", "")
    port_text = urls.port_text(raw)
    port = F.when(port_text == "", F.when(scheme == "https", 443).otherwise(80)).otherwise(
        F.when(port_text.rlike(r"^\d{1,5}$"), port_text.try_cast("int"))
    )
    port = F.when(port == 0, F.when(scheme == "https", 443).otherwise(80)).when(port <= 65535, port)
    user_info = F.regexp_extract(urls.netloc(raw), "^(.*)@", 1)

    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), c, F.lit("'"))

    reason = (
        F.when(raw == "", F.lit("URL is empty"))
        .when(F.length(raw) > fixed.MAX_URL_LENGTH, F.lit(f"URL exceeds {fixed.MAX_URL_LENGTH} characters"))
        .when(raw.rlike(r"[\n\r\t ]"), F.lit("URL contains whitespace or control characters"))
        .when(
            ~scheme.isin("http", "https"),
            F.concat(
                F.lit("Scheme "),
                quoted(F.coalesce(F.nullif(scheme, F.lit("")), F.lit("(none)"))),
                F.lit(" is not allowed; use http or https"),
            ),
        )
        .when((user_info != "") & (user_info != ":"), F.lit("URLs with embedded credentials are not allowed"))
        .when(host == "", F.lit("URL has no hostname"))
        .when(port.isNull(), F.lit("URL has an invalid port"))
    )
    if not allow_private:
        suffix = "(" + "|".join(s.replace(".", r"\.") for s in fixed.BLOCKED_SUFFIXES) + ")$"
        reason = (
            reason.when(
                host.isin(fixed.BLOCKED_HOSTNAMES), F.concat(F.lit("Hostname "), quoted(host), F.lit(" is blocked"))
            )
            .when(
                host.rlike(suffix),
                F.concat(F.lit("Hostname "), quoted(host), F.lit(" is on a blocked internal domain")),
            )
            .when(
                ~port.isin(fixed.ALLOWED_PORTS),
                F.concat(F.lit("Port "), port.cast("string"), F.lit(" is not allowed")),
            )
        )
    checked = urls_df.withColumns({"_host": host, "_early": reason})

    hosts = checked.filter("_early IS NULL").select("_host").distinct()
    literal = hosts.filter(ip_key(F.col("_host")).isNotNull()).select("_host", F.col("_host").alias("ip"))
    looked_up = hosts.join(dns.select(F.lower("host").alias("_host"), "ip"), "_host")
    resolved = ip_cidr_join(literal.unionByName(looked_up).distinct(), networks)
    verdict = resolved.groupBy("_host").agg(F.min(F.when(~F.col("is_public"), F.col("ip"))).alias("_bad_ip"))
    verdict = verdict.withColumn("_known", F.lit(True))

    late = F.when(
        F.col("_known").isNull(), F.concat(F.lit("Hostname could not be resolved: "), F.col("_host"))
    )
    if not allow_private:
        late = late.when(
            F.col("_bad_ip").isNotNull(),
            F.concat(
                F.lit("Hostname "), quoted(F.col("_host")), F.lit(" resolves to non-public address "),
                F.col("_bad_ip"), F.lit("; refusing to fetch"),
            ),
        )
    return (
        checked.join(verdict, "_host", "left")
        .withColumn("reject_reason", F.coalesce(F.col("_early"), late))
        .drop("_host", "_early", "_bad_ip", "_known")
    )


# --- robots and redirects ------------------------------------------------------


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, urls.COMPONENTS, 1), F.lit("://"), urls.netloc(url))


def robots_join(urls_df: DataFrame, robots: DataFrame, rules: DataFrame, as_of: Column, ttl_s: int = 3600) -> DataFrame:
    """Decide per address whether robots rules permit it.

    ``robots`` has one row per fetched policy (origin, fetched_at, status,
    crawl_delay), status NULL when it could not be reached; ``rules`` has
    (origin, rule_ord, prefix, allow). The first rule whose prefix starts the
    path decides, none means allowed. A policy older than ``ttl_s`` does not count.
    """
    newest = robots.filter(
        (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp")))
        < ttl_s * 1_000_000
    )
    newest = newest.groupBy("origin").agg(
        F.max_by(F.struct("status", "crawl_delay"), "fetched_at").alias("policy")
    )
    path = F.concat(
        urls.url_path(F.col("url")),
        F.when(urls.query(F.col("url")) == "", F.lit("")).otherwise(
            F.concat(F.lit("?"), urls.query(F.col("url")))
        ),
    )
    keyed = urls_df.withColumns({"origin": origin(F.col("url")), "_path": path})
    # a policy's rules are one short array, so an address never becomes a row per rule
    ruled = rules.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("rule_ord", "prefix", "allow"))).alias("_rules"))
    first_rule = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["prefix"])), 0)["allow"]
    status = F.col("policy.status")
    reason = (
        F.when(F.col("policy").isNull(), F.lit("robots.txt not fetched recently"))
        .when(status.isNull(), F.lit("robots.txt unreachable"))
        .when(status == 404, F.lit("no robots.txt (404)"))
        .when(status >= 400, F.concat(F.lit("robots.txt returned HTTP "), status.cast("string")))
        .when(~F.coalesce(F.col("_rule"), F.lit(True)), F.lit("disallowed by robots.txt"))
        .otherwise(F.lit("robots.txt parsed"))
    )
    return (
        keyed.join(newest, "origin", "left")
        .join(ruled, "origin", "left")
        .withColumn("_rule", first_rule)
        .withColumn("reason", reason)
        .withColumn("allowed", F.col("reason").isin("robots.txt parsed", "no robots.txt (404)"))
        .withColumn("crawl_delay", F.col("policy.crawl_delay"))
        .drop("policy", "_path", "_rule", "_rules")
    )


def resolve_redirects(urls_df: DataFrame, edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """Follow redirects for at most ``max_hops`` hops.

    Adds ``final_url``, ``hops`` and ``is_redirect``, true when the last page
    reached still redirects. ``edges`` is (from_url, to_url), one row per page.
    """
    out = urls_df.withColumns({"final_url": F.col("url"), "hops": F.lit(0)})
    step = edges.select(F.col("from_url").alias("final_url"), F.col("to_url").alias("_next"))
    for _ in range(max_hops):
        out = out.join(step, "final_url", "left").withColumns(
            {
                "hops": F.col("hops") + F.when(F.col("_next").isNull(), 0).otherwise(1),
                "final_url": F.coalesce(F.col("_next"), F.col("final_url")),
            }
        ).drop("_next")
    return out.join(step, "final_url", "left").withColumn("is_redirect", F.col("_next").isNotNull()).drop("_next")


# --- fetch outcomes ----------------------------------------------------------------


def fetch_outcome(status: Column, body_bytes: Column, max_bytes: int | None = None) -> Column:
    """'blocked', 'retryable', 'gone', 'ok' or 'other'; with ``max_bytes`` a larger body counts as blocked."""
    oversized = F.lit(False) if max_bytes is None else body_bytes > max_bytes
    return (
        F.when(status.isin(fixed.BLOCKING_STATUSES), F.lit("blocked"))
        .when(status.isin(fixed.RETRYABLE_STATUSES), F.lit("retryable"))
        .when(oversized, F.lit("blocked"))
        .when(status.isin(fixed.GONE_STATUSES), F.lit("gone"))
        .when(status.between(200, 299), F.lit("ok"))
        .otherwise(F.lit("other"))
    )


def fetch_stats(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: requests, refusals by cause, errors, bytes and politeness waits."""
    blocked = F.col("blocked_reason")
    return log.groupBy(run).agg(
        F.count_if(blocked.isNull() | blocked.startswith("http_")).alias("requests"),
        F.count_if(blocked == "robots_disallowed").alias("blocked_by_robots"),
        F.count_if(blocked.startswith("http_")).alias("blocked_by_site"),
        F.count_if(blocked == "unsafe_url").alias("ssrf_rejected"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.when(blocked.isNull(), F.col("bytes")).otherwise(0)).alias("bytes_downloaded"),
        F.count_if(F.col("waited_s") > 0).alias("rate_limit_waits"),
        F.coalesce(F.sum("waited_s"), F.lit(0.0)).alias("rate_limit_seconds"),
    )


def retry_plan(log: DataFrame, max_retries: int = 2) -> DataFrame:
    """The attempts made per address and what follows each.

    Adds ``attempt`` (1-based), ``action`` and ``backoff_s``. A network error
    or a retryable status is tried again after 2^n seconds, a refusal never is.
    """
    first = first_k(log, ["url"], [F.col("ord")], max_retries + 1, rank="attempt")
    again = F.col("error").isNotNull() | F.col("status").isin(fixed.RETRYABLE_STATUSES)
    refused = F.coalesce(F.col("status").isin(fixed.BLOCKING_STATUSES), F.lit(False))
    settled = F.coalesce(~again | refused, F.lit(True))
    # Attempts after the first settled one were never due.
    stop = first.groupBy("url").agg(F.min(F.when(settled, F.col("attempt"))).alias("_stop"))
    action = (
        F.when(refused, F.lit("stop"))
        .when(settled, F.lit("done"))
        .when(F.col("attempt") > max_retries, F.lit("give_up"))
        .otherwise(F.lit("retry"))
    )
    return (
        first.join(stop, "url")
        .filter(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
        .withColumn("action", action)
        .withColumn("backoff_s", F.when(F.col("action") == "retry", F.pow(F.lit(2.0), F.col("attempt") - 1)))
        .drop("_stop")
    )


# --- budgets and pacing ------------------------------------------------------------


def crawl_company_budget(companies: DataFrame, budget: int = 10) -> DataFrame:
    """Which companies of a search are crawled.

    Input (search_id, company, ord, cached). Companies count in first-seen
    order; a cached one is served from the cache, one past the budget is not
    checked. Adds nothing but ``decision``: 'cached', 'crawl' or 'over_budget'.
    """
    seen = companies.groupBy("search_id", "company").agg(
        F.min("ord").alias("first_ord"), F.bool_or("cached").alias("cached")
    )
    within = first_k(seen, ["search_id"], [F.col("first_ord")], budget).select(
        "search_id", "company", F.lit(True).alias("_within")
    )
    decision = (
        F.when(F.col("cached"), F.lit("cached")).when(F.col("_within"), F.lit("crawl")).otherwise(F.lit("over_budget"))
    )
    return seen.join(within, ["search_id", "company"], "left").withColumn("decision", decision).drop("_within")


def crawl_page_budget(attempts: DataFrame, per_company: int = 4, per_run: int = 120) -> DataFrame:
    """Pages that may be tried: the first few per company, then the first few per run.

    Input (run_id, company, ord, url); attempts count whether or not they succeed.
    """
    by_company = first_k(attempts, ["run_id", "company"], [F.col("ord")], per_company)
    return first_k(by_company, ["run_id"], [F.col("ord")], per_run, rank="attempt")


def failure_streak_stop(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Tag attempts made after ``limit`` consecutive failures as skipped.

    Input (query_id, ord, ok). Adds ``streak`` (failures in a row up to here)
    and ``skipped``. A success resets the streak.
    """
    chunks = ordered_chunks(attempts, ["query_id"], ["ord"])
    counted = running(chunks, ["query_id"], ["ord"], {"_n": ("sum", F.lit(1))})
    marked = running(counted, ["query_id"], ["ord"], {"_last_ok": ("max", F.when(F.col("ok"), F.col("_n")))})
    marked = marked.withColumn("streak", F.col("_n") - F.coalesce(F.col("_last_ok"), F.lit(0)))
    stops = marked.filter(F.col("streak") >= limit).groupBy("query_id").agg(F.min("ord").alias("_stop"))
    return (
        marked.join(stops, "query_id", "left")
        .withColumn("skipped", F.coalesce(F.col("ord") > F.col("_stop"), F.lit(False)))
        .drop("_n", "_last_ok", "_stop", "_chunk")
    )


def politeness_schedule(
    arrivals: DataFrame, domain: str, ts: str, delay_s: Column | float, order: str
) -> DataFrame:
    """When each fetch may start so that a domain is called at most once per delay.

    ``start_i = max(arrival_i, start_{i-1} + delay)`` unrolls to
    ``i * delay + max over j <= i of (arrival_j - j * delay)``, a running
    maximum. Adds ``start_us`` (epoch microseconds) and ``waited_s``. The delay
    must be constant within a domain.
    """
    delay = delay_s if isinstance(delay_s, Column) else F.lit(delay_s)
    base = arrivals.withColumns(
        {"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_delay": (delay * 1_000_000).cast("bigint")}
    )
    keys, by = [domain], ["_at", order]
    ranked = running(ordered_chunks(base, keys, by), keys, by, {"_i": ("sum", F.lit(1))})
    slack = F.col("_at") - F.col("_i") * F.col("_delay")
    out = running(ranked, keys, by, {"_peak": ("max", slack)})
    return (
        out.withColumn("start_us", F.col("_i") * F.col("_delay") + F.col("_peak"))
        .withColumn("waited_s", (F.col("start_us") - F.col("_at")) / 1_000_000.0)
        .drop("_at", "_delay", "_i", "_peak", "_chunk")
    )
