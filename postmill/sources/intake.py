"""From many sources to one posting table: cleaning, ordering, eligibility, boards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import places
from postmill.functions import text as tx
from postmill.plans.skew import first_k, first_per_key


def tag_incomplete(raw: DataFrame) -> DataFrame:
    """Clean the three required fields and tag rows lacking one with a ``drop_reason``."""
    cleaned = raw.withColumns(
        {
            "title": tx.collapse(F.coalesce("title", F.lit(""))),
            "company_name": tx.collapse(F.coalesce("company_name", F.lit(""))),
            "url": tx.strip(F.coalesce("url", F.lit(""))),
        }
    )
    lacking = (F.col("title") == "") | (F.col("url") == "") | (F.col("company_name") == "")
    return cleaned.withColumn("drop_reason", F.when(lacking, F.lit("incomplete")))


def clean_raw_jobs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete postings, dropped count per source)."""
    tagged = tag_incomplete(raw)
    dropped = tagged.groupBy("source").agg(F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"))
    return tagged.filter("drop_reason IS NULL").drop("drop_reason"), dropped


#: Sources whose rows are counted by name; all others count as one.
OBSERVED = [*fixed.SOURCE_LABELS, "OTHER"]


def observe_intake(tagged: DataFrame, name: str = "intake") -> tuple[DataFrame, Observation]:
    """The same rows, and what each source brought: ``{source}_rows`` and ``{source}_incomplete``.

    The counts come with the first action that reads the rows, without a pass of their own.
    """
    seen = Observation(name)
    source = F.when(F.col("source").isin(list(fixed.SOURCE_LABELS)), F.col("source")).otherwise("OTHER")
    counts = []
    for s in OBSERVED:
        counts += [
            F.count_if(source == s).alias(f"{s}_rows"),
            F.count_if((source == s) & F.col("drop_reason").isNotNull()).alias(f"{s}_incomplete"),
        ]
    return tagged.observe(seen, *counts), seen


def union_sources(parts: Iterable[tuple[int, DataFrame]]) -> DataFrame:
    """All sources as one table, each row keeping its source's place as ``provider_ord``."""
    tagged = [df.withColumn("provider_ord", F.lit(place)) for place, df in sorted(parts, key=lambda p: p[0])]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def source_eligibility(
    queries: DataFrame, settings: Sequence[str] = (), have_seed_boards: bool = True
) -> DataFrame:
    """One row per request and source: ``runs`` and, when it does not, ``skip_reason``."""
    rows = [
        F.struct(
            F.lit(place).alias("provider_ord"),
            F.lit(name).alias("source"),
            F.lit(label).alias("label"),
            F.lit(", ".join(s for s in needed if s not in settings)).alias("missing"),
            F.lit(remote_only).alias("remote_only_source"),
        )
        for place, (name, label, needed, remote_only, _) in enumerate(fixed.JOB_SOURCES)
    ]
    pairs = queries.select("*", F.inline(F.array(*rows))).withColumn(
        "_countries", places.countries_for(F.col("locations"))
    )
    covered = F.arrays_overlap("_countries", tx.str_array(fixed.ADZUNA_COUNTRIES))
    places_named = F.size("locations") > 0
    reason = (
        F.when(F.col("missing") != "", F.concat(F.lit("not configured (set "), F.col("missing"), F.lit(")")))
        .when(
            (F.col("source") == "company_boards") & (F.size("companies") == 0) & ~F.lit(have_seed_boards),
            F.lit("no companies named in the search and no company board file configured"),
        )
        .when(
            (F.col("source") == "adzuna") & places_named & ~covered,
            F.lit("no supported country could be resolved from the search locations"),
        )
        .when(
            (F.col("source") == "usajobs") & (F.size("_countries") > 0) & ~F.array_contains("_countries", "us"),
            F.lit("covers United States postings only"),
        )
        .when(
            F.col("remote_only_source") & places_named & ~F.col("remote_only"),
            F.lit("only carries remote roles; the search names specific locations"),
        )
    )
    return pairs.select(
        "query_id", "provider_ord", "source", "label", reason.isNull().alias("runs"), reason.alias("skip_reason")
    )


def title_wanted(title: Column, wanted: Column) -> Column:
    """Whether a title holds a wanted one, or all but one of its words.

    ``wanted`` is an array of normalised titles; an empty one accepts anything.
    """
    plain = tx.basic_normalize(title)
    words = F.array_distinct(tx.tokens(plain))

    def close(candidate: Column) -> Column:
        parts = F.array_distinct(tx.tokens(candidate))
        shared = F.size(F.array_intersect(parts, words))
        return (candidate != "") & (
            F.contains(plain, candidate) | (shared >= F.greatest(F.lit(1), F.size(parts) - 1))
        )

    return (F.size(wanted) == 0) | F.exists(wanted, close)


def provider_title_filter(jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """For sources without a text search: keep postings whose title their request wants."""
    wanted = queries.select(
        "query_id",
        F.transform(places.search_titles(F.col("titles")), tx.basic_normalize).alias("_wanted"),
    )
    kept = jobs.join(wanted, "query_id").filter(title_wanted(F.col("title"), F.col("_wanted")))
    return kept.drop("_wanted")


def apply_age_limit(jobs: DataFrame, as_of: Column, days: int = 45) -> DataFrame:
    """Keep postings at most ``days`` old; an unknown date is kept."""
    return jobs.filter(F.col("posted_at").isNull() | (F.col("posted_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY")))


def limit_per_source(df: DataFrame, cap: int = 60, order: str = "item_ord") -> DataFrame:
    """The first ``cap`` postings of each request and source."""
    return first_k(df, ["query_id", "source"], [F.col(order)], cap)


# --- company boards ----------------------------------------------------------------


def seed_boards(spark: SparkSession, path: str) -> DataFrame:
    """Boards of a file (platform, token, company, seed_ord)."""
    return boards_listed(spark.read.text(path, wholetext=True))


def boards_listed(documents: DataFrame) -> DataFrame:
    """Boards of JSON documents in ``value``: a list, or an object with ``boards``; bad rows are skipped."""
    whole = F.try_parse_json("value")
    listed = F.coalesce(
        F.try_variant_get(whole, "$.boards", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>")
    )
    entries = documents.select(F.posexplode(listed).alias("seed_ord", "entry"))

    def get(name: str) -> Column:
        return tx.strip(F.coalesce(F.try_variant_get("entry", f"$.{name}", "string"), F.lit("")))

    boards = entries.select(
        F.lower(get("platform")).alias("platform"),
        get("token").alias("token"),
        F.coalesce(F.nullif(get("company"), F.lit("")), get("token")).alias("company"),
        "seed_ord",
    )
    return boards.filter((F.col("token") != "") & F.col("platform").isin([p[0] for p in fixed.BOARD_PLATFORMS]))


def candidate_tokens(company: Column) -> Column:
    """Plausible board tokens of a company, most likely first."""
    base = tx.basic_normalize(
        F.regexp_replace(F.coalesce(company, F.lit("")), "(?i)" + fixed.LEGAL_SUFFIX_PATTERN, " ")
    )
    guesses = F.array(F.replace(base, F.lit(" "), F.lit("")), F.replace(base, F.lit(" "), F.lit("-")),
                      F.substring_index(base, " ", 1))
    return F.array_distinct(F.filter(guesses, lambda t: F.length(t) >= 2))


def board_token_candidates(companies: DataFrame) -> DataFrame:
    """One row per company and candidate token, in order."""
    return companies.select("company", F.posexplode(candidate_tokens(F.col("company"))).alias("ord", "token"))


def resolve_boards(companies: DataFrame, catalog: DataFrame, known: DataFrame) -> DataFrame:
    """The board of each company: one already known, else its first candidate that exists.

    ``catalog`` is (platform, token, n_jobs) and only boards with postings
    count; candidates are tried token by token, platform by platform. ``known``
    is (company_key, platform, token).
    """
    order = tx.lit_map({p[0]: i for i, p in enumerate(fixed.BOARD_PLATFORMS)}, "int")
    live = catalog.filter("n_jobs >= 1").select("platform", "token").distinct()
    probed = (
        board_token_candidates(companies.select("company").distinct())
        .join(live, "token")
        .groupBy("company")
        .agg(F.min_by(F.struct("platform", "token"), F.struct("ord", F.element_at(order, F.col("platform")))).alias("probed"))
    )
    keyed = companies.withColumn("company_key", tx.normalize_company_name(F.col("company")))
    confirmed = known.groupBy("company_key").agg(F.min(F.struct("platform", "token")).alias("known"))
    board = F.coalesce(F.col("known"), F.col("probed"))
    return (
        keyed.join(confirmed, "company_key", "left")
        .join(probed, "company", "left")
        .select("company", "company_key", board["platform"].alias("platform"), board["token"].alias("token"))
    )


def target_boards(queries: DataFrame, resolved: DataFrame, seeds: DataFrame, max_companies: int = 8) -> DataFrame:
    """Boards each request reads: those of the companies it names, then seeds, at most ``max_companies``.

    A request that names companies takes only seeds of those companies; one
    that names none takes the first seeds of the file.
    """
    named = queries.select(
        "query_id", F.posexplode("companies").alias("pos", "company")
    )
    own = named.join(
        resolved.filter("token IS NOT NULL").select("company", "platform", "token").distinct(), "company"
    ).select("query_id", "platform", "token", "company", F.lit(0).alias("tier"), F.col("pos").alias("ord"))

    wanted = queries.select("query_id", F.explode("companies").alias("name")).select(
        "query_id", tx.normalize_company_name(F.col("name")).alias("company_key")
    ).distinct()
    keyed_seeds = seeds.withColumn("company_key", tx.normalize_company_name(F.col("company")))
    matching = wanted.join(keyed_seeds, "company_key").select(
        "query_id", "platform", "token", "company", F.lit(1).alias("tier"), F.col("seed_ord").alias("ord")
    )
    # The first different seeds of the file, as one short array carried to every open request.
    once = first_per_key(seeds, ["platform", "token"], [F.col("seed_ord")])
    head = once.orderBy("seed_ord").limit(max_companies)
    head = head.agg(F.sort_array(F.collect_list(F.struct("seed_ord", "platform", "token", "company"))).alias("seeds"))
    open_requests = queries.filter(F.size("companies") == 0).select("query_id", F.lit(1).alias("_one"))
    defaults = open_requests.join(F.broadcast(head.withColumn("_one", F.lit(1))), "_one").select(
        "query_id", F.inline("seeds")
    ).select("query_id", "platform", "token", "company", F.lit(1).alias("tier"), F.col("seed_ord").alias("ord"))

    every = own.unionByName(matching).unionByName(defaults)
    best = every.groupBy("query_id", "platform", "token").agg(
        F.min(F.struct("tier", "ord", "company")).alias("best")
    ).select("query_id", "platform", "token", "best.*")
    return first_k(best, ["query_id"], [F.col("tier"), F.col("ord")], max_companies, rank="board_rank")


def board_url_build(boards: DataFrame) -> DataFrame:
    """Add ``api_url`` and ``public_url`` for a known platform with a token."""

    def filled(position: int) -> Column:
        template = tx.lookup({p[0]: p[position] for p in fixed.BOARD_PLATFORMS}, F.col("platform"))
        return F.when(~tx.is_blank(F.col("token")), F.replace(template, F.lit("{token}"), F.col("token")))

    return boards.withColumns({"api_url": filled(1), "public_url": filled(2)})


def board_of_url(url: Column) -> Column:
    """Struct (platform, token) of a board address, NULL elsewhere."""
    lowered = F.lower(url)
    token = F.substring_index(F.regexp_replace(lowered, "/+$", ""), "/", -1)
    out = F.lit(None).cast("struct<platform:string,token:string>")
    for name, _, _, _, hosts in reversed(fixed.BOARD_PLATFORMS):
        pattern = "|".join(h.replace(".", r"\.") for h in hosts)
        out = F.when(lowered.rlike(pattern), F.struct(F.lit(name).alias("platform"), token.alias("token"))).otherwise(out)
    return F.when(token != "", out)


def known_boards(companies: DataFrame) -> DataFrame:
    """Boards already confirmed, read back from stored careers addresses."""
    board = board_of_url(F.col("careers_url"))
    return companies.select(
        F.col("normalized_name").alias("company_key"), board["platform"].alias("platform"), board["token"].alias("token")
    ).filter("token IS NOT NULL")
