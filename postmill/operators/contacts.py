"""Published contacts: reading them from postings and pages, choosing, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import html, urls
from postmill.functions import text as tx
from postmill.plans.skew import first_k, first_per_key, ordered_chunks, running
from postmill.session import checkpoint

CONTACT_COLUMNS = [
    "company_key", "company_name", "role", "name", "title", "email", "email_status", "profile_url", "search_url",
    "source", "source_url", "source_excerpt", "confidence", "rationale", "source_ord", "page_ord", "item_ord",
]
_TEXT = ("name", "title", "email", "profile_url", "search_url", "source_url", "source_excerpt", "rationale")
# Elements that start a new block of page text.
BLOCK_EDGE = r"(?i)</?(?:div|li|ul|ol|td|tr|table|section|article|main|body|nav|header|footer|dl)\b[^>]*>"
HREF = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""


def _contacts(rows: DataFrame, source_ord: int, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    defaults = {c: none for c in _TEXT} | {
        "company_key": F.col("company_key"), "company_name": F.col("company_name"),
        "page_ord": F.lit(0), "item_ord": F.lit(0), "source_ord": F.lit(source_ord),
    }
    shaped = defaults | columns
    return rows.select(*[shaped[c].alias(c) for c in CONTACT_COLUMNS])


def role_rank(role: Column) -> Column:
    return tx.lookup({r: i for i, r in enumerate(fixed.CONTACT_ROLE_LABELS)}, role, "int")


def contact_dedupe_key(df: DataFrame) -> DataFrame:
    """Add ``dedupe_key``: identity within a company, by name before address."""
    key = (
        F.when(~tx.is_blank(F.col("name")), F.concat(F.lit("name:"), tx.basic_normalize(F.col("name"))))
        .when(~tx.is_blank(F.col("email")), F.concat(F.lit("email:"), F.lower("email")))
        .when(~tx.is_blank(F.col("search_url")), F.concat(F.lit("search:"), F.col("role")))
        .otherwise(
            F.concat(
                F.lit("other:"), tx.basic_normalize(F.coalesce(F.nullif("title", F.lit("")), F.col("role")))
            )
        )
    )
    return df.withColumn("dedupe_key", key)


# --- where contacts are published -----------------------------------------------------


def contacts_from_posting(postings: DataFrame) -> DataFrame:
    """Addresses a posting publishes: company_key, company_name, company_domain, posting_url, description."""
    found = postings.select(
        "company_key", "company_name", "company_domain", "posting_url", "description",
        F.posexplode(html.extract_emails(F.col("description"))).alias("item_ord", "raw"),
    ).withColumn("address", html.clean_email(F.col("raw"), F.col("company_domain")))
    address = F.col("address")
    alias = html.is_role_address(address) | html.is_talent_address(address)
    return _contacts(
        found.filter("address IS NOT NULL"), 0,
        role=F.when(alias, F.lit("TALENT_ALIAS")).otherwise(F.lit("TALENT_ACQUISITION")),
        title=F.lit("Contact address published on the job posting"),
        email=address, email_status=F.lit("PUBLISHED_TEAM_ALIAS"),
        source=F.lit("JOB_POSTING_CONTACT"), source_url=F.col("posting_url"),
        source_excerpt=tx.excerpt_around(F.col("description"), address),
        confidence=F.lit(0.75), rationale=F.lit("Published on the job posting itself."),
        item_ord=F.col("item_ord"),
    )


def contacts_from_jsonld(pages: DataFrame) -> DataFrame:
    """People with a hiring title in a page's structured data.

    ``pages`` has company_key, company_name, company_domain, page_url, page_ord, html.
    """
    blocks = html.extract_jsonld(pages).filter(html.has_type(F.col("block"), "Person"))
    rows = blocks.withColumns(
        {
            "_title": tx.strip(F.coalesce(html.text_of(F.col("block"), "jobTitle"), F.lit(""))),
            "_name": tx.collapse(F.coalesce(html.text_of(F.col("block"), "name"), F.lit(""))),
            "_email": html.clean_email(html.text_of(F.col("block"), "email"), F.col("company_domain")),
        }
    ).withColumn("_role", html.classify_contact_title(F.col("_title")))
    good = rows.filter((F.col("_role").isNotNull()) & (F.col("_name") != "") & (F.length("_name") <= 120))
    return _contacts(
        good, 1,
        role=F.col("_role"), name=F.col("_name"), title=F.col("_title"), email=F.col("_email"),
        email_status=F.when(F.col("_email").isNotNull(), F.lit("PUBLISHED_ATTRIBUTED")).otherwise(F.lit("NONE")),
        profile_url=html.text_of(F.col("block"), "url"), source=F.lit("COMPANY_TEAM_PAGE"),
        source_url=F.col("page_url"),
        source_excerpt=F.concat(F.lit("Published structured data: "), F.col("_name"), F.lit(" — "), F.col("_title")),
        confidence=F.lit(0.9), rationale=F.lit("Named in the page's own structured data."),
        page_ord=F.col("page_ord"), item_ord=F.col("pos"),
    )


def contacts_from_mailto(pages: DataFrame) -> DataFrame:
    """Team inboxes and named people behind a page's mailto links."""
    links = html.extract_mailto(pages).withColumn("_email", html.clean_email(F.col("email"), F.col("company_domain")))
    email, anchor = F.col("_email"), F.col("anchor")
    talent, role = html.is_talent_address(email), html.is_role_address(email)
    shared = role | talent
    inbox = shared & (talent | html.classify_contact_title(anchor).isNotNull())
    person = ~shared & html.is_person_name(anchor)
    good = links.filter(email.isNotNull() & (inbox | person))

    def pick(team, named) -> Column:
        return F.when(shared, team if isinstance(team, Column) else F.lit(team)).otherwise(
            named if isinstance(named, Column) else F.lit(named)
        )

    return _contacts(
        good, 2,
        role=pick("TALENT_ALIAS", "TALENT_ACQUISITION"), name=F.when(~shared, anchor),
        title=pick("Shared talent inbox", "Recruiting contact"), email=email,
        email_status=pick("PUBLISHED_TEAM_ALIAS", "PUBLISHED_ATTRIBUTED"),
        source=pick("COMPANY_CAREERS_PAGE", "COMPANY_TEAM_PAGE"), source_url=F.col("page_url"),
        source_excerpt=pick(
            F.concat(F.lit("Published as a mailto link on "), F.col("page_url")),
            F.concat(F.lit("Published link attributing "), email, F.lit(" to "), anchor),
        ),
        confidence=pick(F.lit(0.7), F.lit(0.85)),
        rationale=pick(
            "A team address the company publishes for exactly this purpose.",
            "The company published this address against this person's name.",
        ),
        page_ord=F.col("page_ord"), item_ord=F.col("pos"),
    )


def people_blocks(pages: DataFrame) -> DataFrame:
    """People listed in a page's visible text with a hiring title.

    The page is cut at block elements. A block of thirty characters or less is
    read together with its neighbours. Within a block the first line that looks
    like a name, and is not itself a title, is the person; each person counts
    once per page.
    """
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), html.INVISIBLE, " ")

    def lines_of(part: Column) -> Column:
        texts = F.transform(F.split(part, html.TAG), lambda t: html.html_to_text(t, None))
        return F.filter(texts, lambda t: t != "")

    parts = pages.withColumn("_parts", F.filter(F.split(visible, BLOCK_EDGE), lambda p: F.trim(p) != ""))
    blocks = parts.select(
        "company_key", "company_name", "company_domain", "page_url", "page_ord",
        F.posexplode(
            F.transform(
                "_parts",
                lambda p, i: F.struct(
                    p.alias("own"),
                    F.coalesce(F.get("_parts", i - 1), F.lit("")).alias("before"),
                    F.coalesce(F.get("_parts", i + 1), F.lit("")).alias("after"),
                ),
            )
        ).alias("block_ord", "b"),
    )
    # Cheap test first: most blocks name no hiring title at all.
    blocks = blocks.filter(html.classify_contact_title(html.html_to_text(F.col("b.own"), None)).isNotNull())
    short = F.length(html.html_to_text(F.col("b.own"), None)) <= 30
    around = F.concat_ws("<br>", "b.before", "b.own", "b.after")
    blocks = blocks.withColumn("_html", F.when(short, around).otherwise(F.col("b.own")))
    blocks = blocks.withColumns({"_titles": lines_of(F.col("b.own")), "_lines": lines_of(F.col("_html"))})
    titled = blocks.select(
        "*", F.posexplode(F.filter("_titles", lambda t: html.classify_contact_title(t).isNotNull())).alias("line_ord", "_line")
    )
    name = F.get(
        F.filter("_lines", lambda t: html.is_person_name(t) & html.classify_contact_title(t).isNull()), 0
    )
    hrefs = F.regexp_extract_all(F.col("_html"), F.lit(HREF), F.lit(1))
    mailtos = F.transform(
        F.filter(hrefs, lambda h: F.startswith(F.lower(tx.strip(h)), F.lit("mailto:"))), lambda h: tx.strip(h)
    )
    written = html.extract_emails(F.array_join("_lines", "\n"))
    clean = F.filter(
        F.transform(F.concat(written, mailtos), lambda a: html.clean_email(a, F.col("company_domain"))),
        lambda a: a.isNotNull(),
    )
    profile = F.get(F.filter(hrefs, lambda h: F.contains(F.lower(h), F.lit("linkedin.com/in/"))), 0)
    found = titled.withColumns(
        {
            "_title": F.col("_line"), "_name": name, "_email": F.get(clean, 0), "_profile": profile,
            "_key": tx.basic_normalize(name),
        }
    ).filter("_name IS NOT NULL")
    found = first_per_key(
        found.select(
            "company_key", "company_name", "page_url", "page_ord", "block_ord", "line_ord", "_title", "_name",
            "_email", "_profile", "_key", F.array_join("_lines", "\n").alias("_excerpt"),
        ),
        ["company_key", "page_url", "_key"],
        [F.col("block_ord"), F.col("line_ord")],
    )
    email = F.col("_email")
    return _contacts(
        found, 3,
        role=html.classify_contact_title(F.col("_title")), name=F.col("_name"), title=F.col("_title"), email=email,
        email_status=F.when(email.isNull(), F.lit("NONE"))
        .when(html.is_role_address(email), F.lit("PUBLISHED_TEAM_ALIAS"))
        .otherwise(F.lit("PUBLISHED_ATTRIBUTED")),
        profile_url=F.col("_profile"), source=F.lit("COMPANY_TEAM_PAGE"), source_url=F.col("page_url"),
        source_excerpt=F.col("_excerpt"),
        confidence=F.when(email.isNotNull(), F.lit(0.8)).otherwise(F.lit(0.6)),
        rationale=F.concat(
            F.lit("Listed on "), urls.netloc(F.col("page_url")), F.lit(" as "), F.col("_title"), F.lit(".")
        ),
        page_ord=F.col("page_ord"), item_ord=F.shiftleft(F.col("block_ord").cast("long"), 32) + F.col("line_ord"),
    )


def search_links(companies: DataFrame) -> DataFrame:
    """One directory search per company; it names nobody."""
    return _contacts(
        companies, 4,
        role=F.lit("SEARCH_LINK"),
        title=F.concat(F.lit("Search LinkedIn for recruiters at "), F.col("company_name")),
        email_status=F.lit("NONE"),
        search_url=urls.people_search_url(
            F.col("company_name"), F.coalesce("role_hint", F.lit("recruiter talent acquisition"))
        ),
        source=F.lit("DIRECTORY_SEARCH_LINK"), confidence=F.lit(0.2),
        rationale=F.lit(
            "A search you run in your own LinkedIn session. This is a link, not a person — "
            "nothing here claims a specific recruiter exists."
        ),
    )


def union_contact_sources(*parts: DataFrame) -> DataFrame:
    """All contact sources as one table; ``source_ord`` keeps their order."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# --- choosing ------------------------------------------------------------------------


def dedupe_contacts(candidates: DataFrame) -> DataFrame:
    """The best-evidenced record per company and identity.

    One with an address wins, then the better role, then the higher confidence;
    the first found wins a tie.
    """
    keyed = contact_dedupe_key(candidates)
    order = [
        tx.is_blank(F.col("email")), role_rank(F.col("role")), -F.col("confidence"),
        F.col("source_ord"), F.col("page_ord"), F.col("item_ord"),
    ]
    return first_per_key(keyed, ["company_key", "dedupe_key"], order)


def _usefulness() -> dict[str, Column]:
    return {
        "_rank": role_rank(F.col("role")),
        "_no_email": tx.is_blank(F.col("email")),
        "_no_name": tx.is_blank(F.col("name")),
        "_doubt": -F.col("confidence"),
    }


def rank_contacts(candidates: DataFrame) -> DataFrame:
    """Add ``contact_rank`` (0-based) per company: best role, then with an address, then named."""
    order = ["_rank", "_no_email", "_no_name", "_doubt", "source_ord", "page_ord", "item_ord"]
    ready = ordered_chunks(candidates.withColumns(_usefulness()), ["company_key"], order)
    ranked = running(ready, ["company_key"], order, {"_n": ("sum", F.lit(1))})
    return ranked.withColumn("contact_rank", F.col("_n") - 1).drop(
        "_n", "_chunk", "_rank", "_no_email", "_no_name", "_doubt"
    )


def top_contacts_per_job(jobs: DataFrame, contacts: DataFrame, n: int = 6) -> DataFrame:
    """The best ``n`` contacts of its company for every job: (job_id, contact_id, rank, relevance)."""
    found = [F.col(c) for c in ("first_seen_at", "source_ord", "page_ord", "item_ord") if c in contacts.columns]
    order = [
        role_rank(F.col("role")), tx.is_blank(F.col("email")), tx.is_blank(F.col("name")),
        F.col("confidence").desc_nulls_last(), *found, F.col("contact_id"),
    ]
    best = first_k(contacts, ["company_key"], order, n, rank="_n").withColumn("rank", F.col("_n") - 1)
    relevance = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("rank") * F.lit(0.15))
    return jobs.select("job_id", "company_key").join(best.select("company_key", "contact_id", "rank"), "company_key").select(
        "job_id", "contact_id", "rank", relevance.alias("relevance")
    )


def contact_rationale(df: DataFrame) -> DataFrame:
    """Add ``rationale``: why the contact is listed."""
    role = F.col("role")
    where = F.coalesce(F.nullif("source_url", F.lit("")), tx.lookup(fixed.SOURCE_LABELS, F.col("source")))
    text = (
        F.when(role == "SEARCH_LINK", F.lit("A search to run yourself — no specific person is being claimed here."))
        .when(role == "TALENT_ALIAS", F.concat(F.lit("Team address published by "), F.col("company_name"), F.lit(".")))
        .otherwise(
            F.concat(tx.lookup(fixed.CONTACT_ROLE_LABELS, role), F.lit(" — found on "), where, F.lit("."))
        )
    )
    return df.withColumn("rationale", text)


def role_hint(titles: Column) -> Column:
    """Words for the directory search, led by the role being sought."""
    first = tx.strip(F.coalesce(F.get(titles, 0), F.lit("")))
    return tx.strip(F.concat(F.lit("recruiter talent acquisition "), first))


# --- finding -------------------------------------------------------------------------


def candidate_pages(companies: DataFrame) -> DataFrame:
    """Pages worth checking per company, best first: (company_key, page_ord, page_url)."""
    root = F.concat(F.lit("https://"), F.col("company_domain"))
    on_site = F.when(
        ~tx.is_blank(F.col("company_domain")),
        F.array(*[F.concat(root, F.lit(p)) for p in fixed.CAREER_PATHS]),
    ).otherwise(tx.str_array([]))
    own = F.when(~tx.is_blank(F.col("careers_url")), F.array("careers_url")).otherwise(tx.str_array([]))
    pages = tx.first_by_key(F.concat(own, on_site), lambda p: F.lower(F.regexp_replace(p, "/+$", "")))
    return companies.select("company_key", F.posexplode(pages).alias("page_ord", "page_url"))


def discover_contacts(companies: DataFrame, postings: DataFrame, pages: DataFrame, max_pages: int = 4) -> DataFrame:
    """Published contacts of each company, deduped and ranked.

    ``companies``: company_key, company_name, company_domain, careers_url,
    role_hint. ``postings``: company_key, posting_url, description. ``pages``:
    url, final_url, status, html. The page budget counts attempts, whether or
    not a page answered.
    """
    known = companies.select("company_key", "company_name", "company_domain")
    texts = postings.join(known, "company_key").select(
        "company_key", "company_name", "company_domain", "posting_url", "description"
    )
    tries = candidate_pages(companies).filter(F.col("page_ord") < max_pages)
    fetched = pages.filter(F.col("status").between(200, 299)).select(
        F.col("url").alias("page_url"), F.coalesce("final_url", "url").alias("_final"), "html"
    )
    read = (
        tries.join(fetched, "page_url")
        .join(known, "company_key")
        .select("company_key", "company_name", "company_domain", F.col("_final").alias("page_url"), "page_ord", "html")
    )
    found = union_contact_sources(
        contacts_from_posting(texts), contacts_from_jsonld(read), contacts_from_mailto(read), people_blocks(read),
        search_links(companies),
    )
    # written once: the chunks of the ranking are counted and bounded before they are made, and would read all pages each time
    return rank_contacts(checkpoint(dedupe_contacts(found)))


def contact_cache_split(companies: DataFrame, contacts: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Add ``cached``: the company has contacts and was checked within ``hours``."""
    have = contacts.filter(~F.col("is_archived")).select("company_key").distinct().withColumn("_have", F.lit(True))

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    recent = micros(F.col("contacts_checked_at")) > micros(as_of) - hours * 3_600_000_000
    return (
        companies.join(have, "company_key", "left")
        .withColumn("cached", F.coalesce(F.col("_have") & recent, F.lit(False)))
        .drop("_have")
    )


# --- checking addresses -------------------------------------------------------------


def email_deliverability(emails: DataFrame, mx: DataFrame, enabled: bool = True) -> DataFrame:
    """Add ``verification`` and ``verification_confidence``.

    ``mx`` is (domain, resolves, has_mx): no row or ``resolves`` NULL means the
    domain could not be checked. Deliverable role addresses are only 'risky'.
    """
    if not enabled:
        return emails.withColumns(
            {"verification": F.lit("not_checked"), "verification_confidence": F.lit(0.0)}
        )
    address = F.lower(tx.strip(F.coalesce("email", F.lit(""))))
    syntax = (
        address.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$")
        & (F.length(F.substring_index(address, "@", 1)) <= 64)
        & (F.length(address) <= 254)
    )
    keyed = emails.withColumns({"_address": address, "domain": html.email_domain(address)})
    joined = keyed.join(mx.select("domain", "resolves", "has_mx"), "domain", "left")
    status = (
        F.when(~syntax, F.lit("invalid"))
        .when(F.col("resolves").isNull(), F.lit("unknown"))
        .when(~F.col("resolves") | ~F.coalesce("has_mx", F.lit(False)), F.lit("invalid"))
        .when(html.is_role_address(F.col("_address")), F.lit("risky"))
        .otherwise(F.lit("valid"))
    )
    confidence = tx.lookup({"valid": 0.8, "risky": 0.55, "invalid": 0.0, "unknown": 0.0}, F.col("verification"), "double")
    return joined.withColumn("verification", status).withColumn("verification_confidence", confidence).drop(
        "_address", "domain", "resolves", "has_mx"
    )


def verification_payload(body: Column) -> Column:
    """Struct (status, confidence, reason) from an e-mail vendor's answer.

    Percentages are scaled to 0..1 and clamped; without a usable number the
    status decides.
    """
    whole = F.try_parse_json(body)
    data = F.coalesce(F.try_variant_get(whole, "$.data", "variant"), whole)

    def get(name: str) -> Column:
        return F.nullif(F.try_variant_get(data, f"$.{name}", "string"), F.lit(""))

    word = F.lower(F.coalesce(get("status"), get("result"), get("state"), F.lit("unknown")))
    status = F.coalesce(tx.lookup(fixed.VENDOR_EMAIL_STATUSES, word), F.lit("unknown"))
    number = F.coalesce(get("confidence"), get("score")).try_cast("double")
    scaled = F.when(number > 1, number / 100.0).otherwise(number)
    fallback = tx.lookup(fixed.VENDOR_DEFAULT_CONFIDENCE, status, "double")
    return F.struct(
        status.alias("status"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, fallback))).alias("confidence"),
        F.coalesce(get("reason"), word).alias("reason"),
    )
