"""Reading landed source payloads into one posting shape.

A payload table holds one API response per row: ``body`` (JSON text),
``query_url``, and for company boards ``company`` and ``token``. Responses
differ from source to source and from day to day, so each body is parsed as a
VARIANT and fields are taken leniently; an item that is not an object is
skipped. ``read_payloads`` makes such a table from a folder of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates, html
from postmill.functions import text as tx

POSTING_COLUMNS = [
    "title", "company_name", "url", "source", "source_query_url", "external_id", "apply_url", "location",
    "is_remote", "employment_type", "department", "salary_text", "description", "posted_at", "payload",
]


def read_payloads(
    spark: SparkSession, path: str, company: str | None = None, token: str | None = None, boards: DataFrame | None = None
) -> DataFrame:
    """One row per landed file: ``body``, ``query_url`` (the file), ``company``, ``token``.

    With ``boards`` (token, company) one call reads the folders of all boards,
    such as ``root/*``: a file's token is the name of its folder, and a token the
    table does not have is its own company's name.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.input_file_name().alias("query_url")
    )
    if boards is None:
        return files.withColumns({"company": F.lit(company).cast("string"), "token": F.lit(token).cast("string")})
    known = boards.groupBy("token").agg(F.min("company").alias("company"))
    files = files.withColumn("token", F.regexp_extract("query_url", "([^/]+)/[^/]+$", 1))
    return files.join(known, "token", "left").select(
        "body", "query_url", F.coalesce("company", "token").alias("company"), "token"
    )


def unreadable(payloads: DataFrame, path: str) -> DataFrame:
    """What a reader of the list at ``path`` passes over: query_url, reason ('body', 'list' or 'item') and n."""

    def told(reason: str, n: Column | int) -> Column:
        return F.struct(F.lit(reason).alias("reason"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n"))

    def of_list(listed: Column) -> Column:
        odd = F.size(F.filter(listed, lambda x: ~_is_object(x)))
        return F.when(listed.isNull(), told("list", 1)).otherwise(told("item", odd))

    def of_body(v: Column) -> Column:
        return F.when(v.isNull(), told("body", 1)).otherwise(tx.let(F.try_variant_get(v, path, "array<variant>"), of_list))

    # a body is parsed once and its items are looked at once: a filter on columns of a select would repeat both
    found = F.filter(F.array(tx.let(F.try_parse_json("body"), of_body)), lambda x: x["n"] > 0)
    return payloads.select("query_url", F.inline(found))


def _is_object(item: Column) -> Column:
    """Whether a JSON value is an object, told without spelling its schema."""
    return F.try_variant_get(item, "$", "map<string,variant>").isNotNull()


# --- field access ------------------------------------------------------------------


def field(item: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON item, NULL when absent; an empty string counts as absent."""
    value = F.try_variant_get(item, path, kind)
    return F.nullif(value, F.lit("")) if kind == "string" else value


def plain(item: Column, path: str) -> Column:
    """A field that must be plain text: NULL when it is an object or a list."""
    value = F.try_variant_get(item, path, "variant")
    nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
    return F.when(~F.coalesce(nested, F.lit(False)), field(item, path))


def texts(item: Column, path: str, inner: str | None = None) -> Column:
    """Non-empty strings of a JSON list, or of one field of its objects."""
    items = F.coalesce(F.try_variant_get(item, path, "array<variant>"), F.array().cast("array<variant>"))
    values = F.transform(items, lambda v: F.try_variant_get(v, f"$.{inner}" if inner else "$", "string"))
    return F.filter(values, lambda v: v != "")


def joined(values: Column) -> Column:
    return F.nullif(F.array_join(values, ", "), F.lit(""))


def flag(item: Column, path: str) -> Column:
    """Truth of a loosely typed field."""
    value = F.lower(field(item, path))
    return F.coalesce(~value.isin("false", "0"), F.lit(False))


def _items(payloads: DataFrame, path: str) -> DataFrame:
    """One row per object of the list at ``path``, with ``item`` and ``item_ord``."""
    listed = F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")
    rows = payloads.select("*", F.posexplode(listed).alias("item_ord", "item"))
    return rows.filter(_is_object(F.col("item")))


def _postings(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    text = F.lit(None).cast("string")
    defaults = {
        "external_id": text, "apply_url": text, "location": text, "is_remote": F.lit(False),
        "employment_type": text, "department": text, "salary_text": text,
    }
    shaped = defaults | columns | {"source": F.lit(source), "source_query_url": F.col("query_url")}
    for name in ("title", "company_name", "url"):
        shaped[name] = F.coalesce(shaped[name], F.lit(""))
    # Columns a landed table adds of its own (a search id, a load date) travel along.
    used = {"body", "query_url", "company", "token", "item", *POSTING_COLUMNS}
    kept = [c for c in rows.columns if c not in used]
    return rows.select(*kept, *[shaped[c].alias(c) for c in POSTING_COLUMNS])


def _board_payload(platform: str) -> Column:
    return F.create_map(F.lit("board"), F.col("token"), F.lit("platform"), F.lit(platform))


def _note(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


# --- company boards ----------------------------------------------------------------


def greenhouse_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$.jobs"), F.col("item")
    location = F.coalesce(field(item, "$.location.name"), plain(item, "$.location"))
    return _postings(
        rows, "GREENHOUSE",
        title=field(item, "$.title"), company_name=F.col("company"), url=field(item, "$.absolute_url"),
        external_id=field(item, "$.id"), location=location,
        is_remote=tx.looks_remote(location, field(item, "$.title")),
        department=joined(texts(item, "$.departments", "name")),
        description=html.html_to_text(field(item, "$.content")),
        posted_at=dates.parse_datetime(F.coalesce(field(item, "$.first_published"), field(item, "$.updated_at"))),
        payload=_board_payload("greenhouse"),
    )


def lever_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$"), F.col("item")
    location, commitment = field(item, "$.categories.location"), field(item, "$.categories.commitment")
    return _postings(
        rows, "LEVER",
        title=field(item, "$.text"), company_name=F.col("company"),
        url=F.coalesce(field(item, "$.hostedUrl"), field(item, "$.applyUrl")),
        external_id=field(item, "$.id"), apply_url=field(item, "$.applyUrl"), location=location,
        is_remote=tx.looks_remote(location, commitment), employment_type=commitment,
        department=field(item, "$.categories.team"),
        description=F.coalesce(
            field(item, "$.descriptionPlain"), html.html_to_text(field(item, "$.description"))
        ),
        posted_at=dates.parse_datetime(field(item, "$.createdAt")),
        payload=_board_payload("lever"),
    )


def ashby_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$.jobs"), F.col("item")
    return _postings(
        rows, "ASHBY",
        title=field(item, "$.title"), company_name=F.col("company"),
        url=F.coalesce(field(item, "$.jobUrl"), field(item, "$.applyUrl")),
        external_id=field(item, "$.id"), apply_url=field(item, "$.applyUrl"), location=field(item, "$.location"),
        is_remote=flag(item, "$.isRemote"), employment_type=field(item, "$.employmentType"),
        department=F.coalesce(field(item, "$.department"), field(item, "$.team")),
        description=F.coalesce(
            field(item, "$.descriptionPlain"), html.html_to_text(field(item, "$.descriptionHtml"))
        ),
        posted_at=dates.parse_datetime(F.coalesce(field(item, "$.publishedAt"), field(item, "$.updatedAt"))),
        payload=_board_payload("ashby"),
    )


# --- aggregators -------------------------------------------------------------------


def adzuna_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$.results"), F.col("item")
    low, high = (F.nullif(field(item, f"$.salary_{s}"), F.lit("0")) for s in ("min", "max"))
    amount = F.concat(F.coalesce(low, F.lit("")), F.lit("–"), F.coalesce(high, F.lit("")))
    salary = F.when(
        low.isNotNull() | high.isNotNull(),
        tx.strip(F.concat(F.coalesce(field(item, "$.salary_currency"), F.lit("")), F.lit(" "), amount)),
    )
    location = field(item, "$.location.display_name")
    return _postings(
        rows, "ADZUNA",
        title=field(item, "$.title"), company_name=field(item, "$.company.display_name"),
        url=field(item, "$.redirect_url"), external_id=field(item, "$.id"), location=location,
        is_remote=tx.looks_remote(location, field(item, "$.title")),
        employment_type=field(item, "$.contract_time"), department=field(item, "$.category.label"),
        salary_text=salary, description=html.html_to_text(field(item, "$.description")),
        posted_at=dates.parse_datetime(field(item, "$.created")),
        payload=_note(adzuna_id=field(item, "$.id")),
    )


def themuse_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$.results"), F.col("item")
    location = joined(texts(item, "$.locations", "name"))
    return _postings(
        rows, "THE_MUSE",
        title=field(item, "$.name"), company_name=field(item, "$.company.name"),
        url=field(item, "$.refs.landing_page"), external_id=field(item, "$.id"), location=location,
        is_remote=tx.looks_remote(location), employment_type=field(item, "$.type"),
        department=joined(texts(item, "$.categories", "name")),
        description=html.html_to_text(field(item, "$.contents")),
        posted_at=dates.parse_datetime(field(item, "$.publication_date")),
        payload=_note(levels=joined(texts(item, "$.levels", "name"))),
    )


def remotive_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$.jobs"), F.col("item")
    return _postings(
        rows, "REMOTIVE",
        title=field(item, "$.title"), company_name=field(item, "$.company_name"), url=field(item, "$.url"),
        external_id=field(item, "$.id"),
        location=F.coalesce(field(item, "$.candidate_required_location"), F.lit("Remote")),
        is_remote=F.lit(True), employment_type=field(item, "$.job_type"), department=field(item, "$.category"),
        salary_text=field(item, "$.salary"), description=html.html_to_text(field(item, "$.description")),
        posted_at=dates.parse_datetime(field(item, "$.publication_date")),
        payload=_note(tags=joined(texts(item, "$.tags"))),
    )


def arbeitnow_postings(payloads: DataFrame) -> DataFrame:
    rows, item = _items(payloads, "$.data"), F.col("item")
    return _postings(
        rows, "ARBEITNOW",
        title=field(item, "$.title"), company_name=field(item, "$.company_name"), url=field(item, "$.url"),
        external_id=field(item, "$.slug"), location=field(item, "$.location"), is_remote=flag(item, "$.remote"),
        employment_type=joined(texts(item, "$.job_types")),
        description=html.html_to_text(field(item, "$.description")),
        posted_at=dates.parse_datetime(field(item, "$.created_at")),
        payload=_note(tags=joined(texts(item, "$.tags"))),
    )


def jobicy_postings(payloads: DataFrame) -> DataFrame:
    """The salary text is the first of minimum salary and currency, as the source sends them."""
    rows, item = _items(payloads, "$.jobs"), F.col("item")
    return _postings(
        rows, "JOBICY",
        title=field(item, "$.jobTitle"), company_name=field(item, "$.companyName"), url=field(item, "$.url"),
        external_id=field(item, "$.id"), location=F.coalesce(field(item, "$.jobGeo"), F.lit("Remote")),
        is_remote=F.lit(True), employment_type=joined(texts(item, "$.jobType")),
        department=joined(texts(item, "$.jobIndustry")),
        salary_text=F.coalesce(
            F.nullif(field(item, "$.annualSalaryMin"), F.lit("0")), field(item, "$.salaryCurrency")
        ),
        description=html.html_to_text(
            F.coalesce(field(item, "$.jobDescription"), field(item, "$.jobExcerpt"))
        ),
        posted_at=dates.parse_datetime(field(item, "$.pubDate")),
        payload=_note(level=field(item, "$.jobLevel")),
    )


def usajobs_postings(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "$.SearchResult.SearchResultItems")
    rows = rows.withColumn("item", F.try_variant_get("item", "$.MatchedObjectDescriptor", "variant"))
    rows, item = rows.filter("item IS NOT NULL"), F.col("item")
    return _postings(
        rows, "USAJOBS",
        title=field(item, "$.PositionTitle"),
        company_name=F.coalesce(field(item, "$.OrganizationName"), field(item, "$.DepartmentName")),
        url=field(item, "$.PositionURI"), external_id=field(item, "$.PositionID"),
        apply_url=F.get(texts(item, "$.ApplyURI"), 0),
        location=joined(F.slice(texts(item, "$.PositionLocation", "LocationName"), 1, 3)),
        employment_type=joined(texts(item, "$.PositionSchedule", "Name")),
        description=html.html_to_text(
            F.coalesce(field(item, "$.UserArea.Details.JobSummary"), field(item, "$.QualificationSummary"))
        ),
        posted_at=dates.parse_datetime(field(item, "$.PublicationStartDate")),
        payload=_note(grade=field(item, "$.JobGrade")),
    )


READERS = {
    "greenhouse": greenhouse_postings,
    "lever": lever_postings,
    "ashby": ashby_postings,
    "adzuna": adzuna_postings,
    "themuse": themuse_postings,
    "remotive": remotive_postings,
    "arbeitnow": arbeitnow_postings,
    "jobicy": jobicy_postings,
    "usajobs": usajobs_postings,
}


def register_reader(name: str, reader) -> None:
    """Add a source: a function from a payload table to a posting table."""
    READERS[name] = reader


def read_source(
    spark: SparkSession, name: str, path: str, company: str | None = None, token: str | None = None,
    boards: DataFrame | None = None,
) -> DataFrame:
    """Postings of one source from a folder of landed responses, or from the folders of all its boards."""
    return READERS[name](read_payloads(spark, path, company, token, boards))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (url, html, ...) from a parquet table."""
    return spark.read.parquet(path)
