"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import duck as d
from harness.registry import query
from harness.views import as_of, requests, sql, table, view, AS_OF_TEXT
from postmill import fixed
from postmill.functions import dates, html, places, urls
from postmill.functions import experience as ex
from postmill.functions import text as tx
from postmill.operators import contacts as con
from postmill.operators import tracker
from postmill.operators import requests as req

AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"
c = F.col


def over(name: str, source: str, key: str, column, oracle_value: str, columns: str = "value"):
    """One computed column over a table or view, next to its key."""

    def run(spark, sf):
        return view(spark, sf, source).select(key, column().alias(columns))

    query(name, f"SELECT {key}, {oracle_value} AS {columns} FROM {source}")(run)


def joined(x):
    return F.array_join(F.array_sort(x), "|")


over("strip_accents", "documents", "doc_id", lambda: F.md5(tx.strip_accents(c("text"))), "md5(strip_accents(text))")
over("basic_normalize", "documents", "doc_id", lambda: F.md5(tx.basic_normalize(c("text"))), f"md5({d.norm('text')})")
over(
    "normalize_company_name", "postings", "posting_id", lambda: tx.normalize_company_name(c("company_name")),
    d.company("company_name"),
)
over("normalize_title", "postings", "posting_id", lambda: tx.normalize_title(c("title")), d.title("title"))
over("normalize_location", "postings", "posting_id", lambda: tx.normalize_location(c("location")), d.location("location"))
over(
    "seniority_level", "postings", "posting_id", lambda: tx.seniority_level(c("title")).cast("bigint"),
    "CAST(list_max(list_transform(string_split(" + d.title("title") + ", ' '), lambda t: CASE t "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.SENIORITY.items()) + " END)) AS BIGINT)",
)
over("token_set", "documents", "doc_id", lambda: F.md5(joined(tx.token_set(c("text")))), f"md5(array_to_string({d.toks('text')}, '|'))")
@query(
    "jaccard",
    f"""SELECT posting_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
      ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS value
    FROM (SELECT posting_id, {d.toks('title')} AS a, {d.toks("concat_ws(' ', description, title, location)")} AS b FROM postings)""",
)
def _(spark, sf):
    both = F.concat_ws(" ", "description", "title", "location")
    return view(spark, sf, "postings").select("posting_id", F.round(tx.jaccard(c("title"), both), 6).alias("value"))


@query(
    "token_set_ops",
    f"""SELECT posting_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS combined
    FROM (SELECT posting_id, {d.toks('title')} AS a, {d.toks("'senior product manager analyst'")} AS b FROM postings)""",
)
def _(spark, sf):
    ops = tx.token_set_ops(c("title"), F.lit("senior product manager analyst"))
    return view(spark, sf, "postings").select(
        "posting_id", ops["shared"].cast("bigint").alias("shared"), ops["combined"].cast("bigint").alias("combined")
    )


over(
    "content_fingerprint", "postings", "posting_id",
    lambda: tx.content_fingerprint(c("company_name"), c("title"), c("location")),
    f"sha256({d.norm('company_name')} || '|' || {d.norm('title')} || '|' || {d.norm('location')})",
)
over(
    "contains_term", "documents", "doc_id", lambda: tx.contains_term(c("text"), F.lit("The")),
    f"contains(' ' || {d.norm('text')} || ' ', ' the ')",
)
over(
    "truncate_text", "documents", "doc_id", lambda: tx.truncate_text(c("text"), 280),
    r"""CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 280 THEN trim(regexp_replace(text, '\s+', ' ', 'g'))
        ELSE rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 279)) || '…' END""",
)
over("canonical_place", "postings", "posting_id", lambda: places.canonical_place(c("location")), d.canonical_place("location"))
over(
    "duplicate_key", "postings", "posting_id",
    lambda: places.duplicate_key(c("company_name"), c("title"), c("location")),
    d.dup_key("company_name", "title", "location"),
)
over(
    "company_tokens", "postings", "posting_id", lambda: joined(tx.company_tokens(c("company_name"))),
    f"array_to_string(list_filter({d.toks(d.company('company_name'))}, lambda t: length(t) > 2 AND NOT list_contains({d.lst(fixed.GENERIC_COMPANY_WORDS)}, t)), '|')",
)
over(
    "excerpt_around", "documents", "doc_id", lambda: tx.excerpt_around(c("text"), F.lit("ENTIAL")),
    r"""CASE WHEN strpos(lower(text), 'ential') = 0 THEN left(text, 160)
        ELSE trim(regexp_replace(substr(text, greatest(1, strpos(lower(text), 'ential') - 80), 160), '\s+', ' ', 'g')) END""",
)


@query(
    "contact_dedupe_key",
    f"""SELECT contact_id, CASE WHEN name IS NOT NULL THEN 'name:' || {d.norm('name')} WHEN email IS NOT NULL THEN 'email:' || lower(email)
        WHEN search_url IS NOT NULL THEN 'search:' || role ELSE 'other:' || {d.norm('coalesce(title, role)')} END AS dedupe_key FROM contacts""",
)
def _(spark, sf):
    return con.contact_dedupe_key(view(spark, sf, "contacts")).select("contact_id", "dedupe_key")


@query(
    "contact_rationale",
    f"""SELECT contact_id, CASE role WHEN 'SEARCH_LINK' THEN 'A search to run yourself — no specific person is being claimed here.'
        WHEN 'TALENT_ALIAS' THEN 'Team address published by ' || company_name || '.'
        ELSE {d.label_case('role', fixed.CONTACT_ROLE_LABELS)} || ' — found on ' || coalesce(source_url, {d.label_case('source', fixed.SOURCE_LABELS)}) || '.' END AS rationale
        FROM contacts""",
)
def _(spark, sf):
    return con.contact_rationale(view(spark, sf, "contacts")).select("contact_id", "rationale")


@query(
    "people_search_url",
    """SELECT posting_id, 'https://www.linkedin.com/search/results/people/?keywords=' ||
         replace(url_encode(company_name || ' recruiter ' || title), '%2F', '/') AS value FROM postings""",
)
def _(spark, sf):
    link = urls.people_search_url(c("company_name"), F.concat(F.lit("recruiter "), c("title")))
    return view(spark, sf, "postings").select("posting_id", link.alias("value"))


@query(
    "humanize_days",
    f"""SELECT job_id, CASE WHEN age IS NULL THEN 'date unknown' WHEN age < 1 THEN 'today' WHEN age < 2 THEN 'yesterday'
          WHEN age < 14 THEN CAST(CAST(round_even(age, 0) AS BIGINT) AS VARCHAR) || ' days ago'
          WHEN age < 60 THEN CAST(CAST(round_even(age / 7, 0) AS BIGINT) AS VARCHAR) || ' weeks ago'
          ELSE CAST(CAST(round_even(age / 30, 0) AS BIGINT) AS VARCHAR) || ' months ago' END AS value
        FROM (SELECT job_id, CASE WHEN job_id % 10 > 0 THEN (epoch_us({AS_OF}) - epoch_us(posted_at)) / 86400000000.0 END AS age FROM jobs)""",
)
def _(spark, sf):
    age = F.when(c("job_id") % 10 > 0, dates.age_days(c("posted_at"), c("discovered_at"), as_of()))
    return view(spark, sf, "jobs").select("job_id", tx.humanize_days(age).alias("value"))


@query(
    "job_age_days",
    f"SELECT job_id, round((epoch_us({AS_OF}) - epoch_us(coalesce(posted_at, discovered_at))) / 86400000000.0, 6) AS value FROM jobs",
)
def _(spark, sf):
    age = dates.age_days(c("posted_at"), c("discovered_at"), as_of())
    return view(spark, sf, "jobs").select("job_id", F.round(age, 6).alias("value"))


_num = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
over(
    "experience_label", "jobs", "job_id",
    lambda: tx.experience_label(c("min_years"), c("max_years"), c("experience_text")),
    f"""CASE WHEN coalesce(experience_text, '') <> '' THEN experience_text WHEN min_years IS NULL AND max_years IS NULL THEN 'Not stated'
      WHEN max_years IS NULL THEN {_num.format('min_years')} || '+ years' WHEN min_years IS NULL THEN 'Up to ' || {_num.format('max_years')} || ' years'
      ELSE {_num.format('min_years')} || '–' || {_num.format('max_years')} || ' years' END""",
)
over(
    "looks_remote", "postings", "posting_id", lambda: tx.looks_remote(c("location"), c("title")),
    "regexp_matches(lower(concat_ws(' ', location, title)), 'remote|work from home|anywhere')",
)
over(
    "follow_up_due", "apps", "application_id",
    lambda: tracker.follow_up_due(c("follow_up_date"), c("status"), as_of()), d.due(AS_OF),
)

# --- addresses -------------------------------------------------------------------------


@query(
    "canonicalize_url",
    f"""SELECT 'page' AS kind, page_id AS id, {d.url('url')} AS value FROM pages
        UNION ALL SELECT 'posting', posting_id, {d.url('url')} FROM postings""",
)
def _(spark, sf):
    rows = sql(spark, sf, "SELECT 'page' AS kind, page_id AS id, url FROM pages UNION ALL SELECT 'posting', posting_id, url FROM postings")
    return rows.select("kind", "id", urls.canonicalize_url(c("url")).alias("value"))


over(
    "normalize_url", "pages", "page_id", lambda: urls.normalize_url(c("url")),
    r"""lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')
        || regexp_extract(url, '(\?[^#]+)', 1)""",
)
over(
    "extract_domain", "pages", "page_id", lambda: urls.extract_domain(F.when(c("page_id") % 2 == 0, c("url")).otherwise(F.regexp_replace("url", "^https?://", ""))),
    r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '')",
)
_job_site = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://boards.greenhouse.io/acme/', CAST(page_id AS STRING))
  WHEN 1 THEN concat('http://10.0.', CAST(page_id % 200 AS STRING), '.7:8080/careers') WHEN 2 THEN 'http://localhost/jobs' ELSE url END AS url FROM pages"""


@query(
    "employer_domain",
    rf"""SELECT page_id, CASE WHEN page_id % 5 < 3 THEN NULL ELSE regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') END AS value
      FROM ({_job_site})""",
)
def _(spark, sf):
    return sql(spark, sf, _job_site).select("page_id", urls.employer_domain(c("url")).alias("value"))


@query(
    "board_host_matches",
    f"""SELECT page_id, (contains(lower(url), 'greenhouse.io') OR contains(lower(url), 'lever.co') OR contains(lower(url), 'ashbyhq.com'))
       AND contains(lower(url), lower(concat('Acme/', CAST(page_id % 100 AS VARCHAR)))) AS value FROM ({_job_site})""",
)
def _(spark, sf):
    token = F.concat(F.lit("Acme/"), (c("page_id") % 100).cast("string"))
    return sql(spark, sf, _job_site).select("page_id", urls.board_host_matches(c("url"), token).alias("value"))


# --- dates -----------------------------------------------------------------------------

_dated = """SELECT o_orderkey, o_orderdate, o_orderkey % 9 AS kind FROM orders"""


@query(
    "parse_datetime",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL WHEN o_orderkey % 9 IN (1, 3, 4, 5, 6) THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S')
        WHEN o_orderkey % 9 = 7 THEN strftime(date_trunc('day', o_orderdate) + INTERVAL 6 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S')
        ELSE {d.ts('o_orderdate')} END AS value FROM orders""",
)
def _(spark, sf):
    day = c("o_orderdate")
    text = (
        F.when(c("kind") == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(c("kind") == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(c("kind") == 2, (F.unix_micros(day.cast("timestamp")) / 1000).cast("bigint").cast("string"))
        .when(c("kind") == 3, F.date_format(day, "dd MMM yyyy"))
        .when(c("kind") == 4, F.date_format(day, "MMM d, yyyy"))
        .when(c("kind") == 5, F.date_format(F.date_trunc("day", day), "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(c("kind") == 6, F.when(F.dayofmonth(day) > 12, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy")))
        .when(c("kind") == 7, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00+05:30")))
        .otherwise(F.lit("some day soon"))
    )
    rows = sql(spark, sf, _dated)
    return rows.select("o_orderkey", F.date_format(dates.parse_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("value"))


# --- pages -----------------------------------------------------------------------------


@query("html_to_text", f"SELECT page_id, md5({d.html_text('html')}) AS value, CAST(length({d.html_text('html')}) AS BIGINT) AS n FROM pages")
def _(spark, sf):
    text = html.html_to_text(c("html"), None)
    return table(spark, sf, "pages").select("page_id", F.md5(text).alias("value"), F.length(text).cast("bigint").alias("n"))


_ld = """regexp_extract(html, '<script type="application/ld\\+json">(.*?)</script>', 1)"""


@query(
    "extract_jsonld",
    f"""SELECT url, CAST(0 AS BIGINT) AS pos, json_extract_string({_ld}, '$."@type"') AS kind FROM posting_fetch WHERE {_ld} <> ''""",
)
def _(spark, sf):
    blocks = html.extract_jsonld(view(spark, sf, "posting_fetch"))
    return blocks.select("url", c("pos").cast("bigint").alias("pos"), html.text_of(c("block"), "@type").alias("kind"))


@query(
    "job_posting_blocks",
    f"""SELECT url, json_extract_string({_ld}, '$.validThrough') AS ends FROM posting_fetch WHERE json_extract_string(nullif({_ld}, ''), '$."@type"') = 'JobPosting'""",
)
def _(spark, sf):
    blocks = html.job_posting_blocks(html.extract_jsonld(view(spark, sf, "posting_fetch")))
    return blocks.select("url", html.text_of(c("block"), "validThrough").alias("ends"))


@query(
    "hiring_organization",
    f"""SELECT url, coalesce(json_extract_string({_ld}, '$.hiringOrganization.name'), json_extract_string({_ld}, '$.hiringOrganization')) AS employer
        FROM posting_fetch WHERE {_ld} <> ''""",
)
def _(spark, sf):
    blocks = html.extract_jsonld(view(spark, sf, "posting_fetch"))
    return blocks.select("url", html.hiring_organization(c("block")).alias("employer"))


_emails = f"list_distinct(list_transform(regexp_extract_all(text, {d.q(fixed.EMAIL_PATTERN)}), lambda m: lower(m)))"


@query("extract_emails", f"SELECT doc_id, array_to_string(list_sort({_emails}), '|') AS value FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(html.extract_emails(c("text"))).alias("value"))


_mail = """SELECT company_key, unnest(regexp_extract_all(html, '<a href="mailto:([^"]*)">([^<]*)</a>', 1)) AS link,
  unnest(regexp_extract_all(html, '<a href="mailto:([^"]*)">([^<]*)</a>', 2)) AS anchor,
  unnest(range(len(regexp_extract_all(html, '<a href="mailto:([^"]*)">([^<]*)</a>')))) AS pos, company_domain FROM team_pages"""


@query("extract_mailto", f"SELECT company_key, CAST(pos AS BIGINT) AS pos, lower(split_part(link, '?', 1)) AS email, anchor FROM ({_mail})")
def _(spark, sf):
    return html.extract_mailto(view(spark, sf, "team_pages")).select(
        "company_key", c("pos").cast("bigint").alias("pos"), "email", "anchor"
    )


_people = """SELECT c_custkey, concat(CASE c_custkey % 8 WHEN 0 THEN 'careers' WHEN 1 THEN 'jobs-eu' WHEN 2 THEN 'anna.bell' WHEN 3 THEN 'info'
   WHEN 4 THEN 'no-reply' WHEN 5 THEN 'hr+de' WHEN 6 THEN 'carl' ELSE 'support.team' END, '@',
   CASE WHEN c_custkey % 11 = 0 THEN 'gmail.com' WHEN c_custkey % 11 = 1 THEN concat('mail.c', CAST(c_custkey AS STRING), '.example.com')
     WHEN c_custkey % 11 = 2 THEN 'other.example.net' ELSE concat('c', CAST(c_custkey AS STRING), '.example.com') END) AS email,
   CASE WHEN c_custkey % 6 > 0 THEN concat('c', CAST(c_custkey AS STRING), '.example.com') END AS domain FROM customer"""
_local = "split_part(email, '@', 1)"
_first = "regexp_extract(split_part(email, '@', 1), '^([^.\\-_+]*)', 1)"


@query(
    "email_kind",
    f"""SELECT c_custkey, CASE WHEN {d.within("split_part(email, '@', 2)", fixed.PERSONAL_DOMAINS)} THEN 'personal'
      WHEN {d.within(_local, fixed.TALENT_LOCALPARTS)} OR {d.within(_first, fixed.TALENT_LOCALPARTS)} THEN 'talent'
      WHEN {d.within(_local, fixed.ROLE_LOCALPARTS)} OR {d.within(_first, fixed.ROLE_LOCALPARTS)} THEN 'role' ELSE 'individual' END AS value FROM ({_people})""",
)
def _(spark, sf):
    return sql(spark, sf, _people).select("c_custkey", html.email_kind(c("email")).alias("value"))


@query(
    "clean_email",
    f"""SELECT c_custkey, CASE WHEN {d.within("split_part(email, '@', 2)", fixed.PERSONAL_DOMAINS)} THEN NULL
      WHEN domain IS NOT NULL AND split_part(email, '@', 2) <> domain AND NOT ends_with(split_part(email, '@', 2), '.' || domain) THEN NULL
      ELSE email END AS value FROM ({_people})""",
)
def _(spark, sf):
    sent = F.concat(F.lit(" MAILTO:"), F.upper("email"), F.lit("?subject=x"))
    return sql(spark, sf, _people).select("c_custkey", html.clean_email(sent, c("domain")).alias("value"))


over(
    "classify_contact_title", "contacts", "contact_id", lambda: html.classify_contact_title(c("title")),
    d.case_first((f"regexp_matches(title, {d.q(p)})", d.q(r)) for p, r in fixed.CONTACT_TITLES),
)


@query(
    "is_person_name",
    r"SELECT contact_id, coalesce(regexp_matches(trim(coalesce(name, title)), '^[A-ZÉÈÀÇÊÖÄÜÑÓÍ][\w\p{L}’''\-]+(?:\s+[A-Z][\w\p{L}’''\-]+){1,3}$'), false) AS value FROM contacts",
)
def _(spark, sf):
    rows = view(spark, sf, "contacts")
    return rows.select("contact_id", html.is_person_name(F.coalesce("name", "title")).alias("value"))


# --- experience and places ----------------------------------------------------------------

_need = "concat(title, '. ', description)"


@query(
    "parse_experience",
    f"""SELECT posting_id, {d.exp_min(_need)} AS min_years, {d.exp_max(_need)} AS max_years, {d.level(_need)} AS level, {d.exp_text(_need)} AS phrase FROM postings""",
)
def _(spark, sf):
    found = ex.parse_experience(F.concat(c("title"), F.lit(". "), c("description")))
    rows = view(spark, sf, "postings").select("posting_id", found.alias("x"))
    return rows.select("posting_id", "x.min_years", "x.max_years", "x.level", c("x.text").alias("phrase"))


@query(
    "experience_bounds",
    f"""SELECT posting_id, {d.bound('lo', 'hi', 'lvl', 0)} AS low, {d.bound('lo', 'hi', 'lvl', 1)} AS high FROM
      (SELECT posting_id, {d.exp_min(_need)} AS lo, {d.exp_max(_need)} AS hi, {d.level(_need)} AS lvl FROM postings)""",
)
def _(spark, sf):
    found = ex.parse_experience(F.concat(c("title"), F.lit(". "), c("description")))
    rows = view(spark, sf, "postings").select("posting_id", ex.experience_bounds(found).alias("b"))
    return rows.select("posting_id", "b.low", "b.high")


def _whole_or_head(column: str) -> str:
    m = d.place_map(column)
    return f"coalesce(({m})[{d.norm('location')}], ({m})[{d.norm("split_part(location, ',', 1)")}])"


@query(
    "resolve_location",
    f"SELECT posting_id, {_whole_or_head('display')} AS place_name, {_whole_or_head('country')} AS place_country FROM postings",
)
def _(spark, sf):
    return places.resolve_location(view(spark, sf, "postings"), "location").select("posting_id", "place_name", "place_country")


@query(
    "countries_for",
    f"""SELECT posting_id, array_to_string(list_sort(list_distinct(list_filter([{_whole_or_head('country')},
        ({d.place_map('country')})[{d.norm("split_part(title, ' ', 1)")}], 'de'], lambda x: x IS NOT NULL))), '|') AS value FROM postings""",
)
def _(spark, sf):
    listed = F.array(c("location"), F.substring_index("title", " ", 1), F.lit("Munich, Bavaria"))
    return view(spark, sf, "postings").select("posting_id", joined(places.countries_for(listed)).alias("value"))


_variants = {k: [v] for k, v in fixed.ROLE_ABBREVIATIONS.items()}
for _k, _v in fixed.TITLE_EXPANSIONS.items():
    _variants[_k] = _variants.get(_k, []) + _v
_variant_map = "MAP {" + ", ".join(f"{d.q(k)}: {d.lst(v)}" for k, v in _variants.items()) + "}"


@query(
    "expand_title",
    f"SELECT posting_id, array_to_string(list_concat([title], coalesce(({_variant_map})[{d.norm('title')}], []::VARCHAR[])), '|') AS value FROM postings",
)
def _(spark, sf):
    return view(spark, sf, "postings").select("posting_id", F.array_join(places.expand_title(c("title")), "|").alias("value"))


@query(
    "industry_keywords",
    f"""SELECT c_custkey, coalesce(array_to_string((MAP {{{', '.join(f"{d.q(k)}: {d.lst(v)}" for k, v in fixed.INDUSTRY_TERMS.items())}}})[
        CASE c_custkey % 3 WHEN 0 THEN 'fintech' WHEN 1 THEN 'ai' ELSE 'none' END], '|'),
        lower(c_mktsegment)) AS value FROM customer""",
)
def _(spark, sf):
    name = F.when(c("c_custkey") % 3 == 0, "FinTech").when(c("c_custkey") % 3 == 1, " AI ").otherwise(c("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(places.industry_keywords(name), "|").alias("value"))


def _alias_values() -> str:
    return ", ".join(f"({d.q(a)}, {d.q(b)})" for a, b in places._alias_rows())


@query(
    "location_aliases",
    f"""WITH known(display, alias) AS (VALUES {_alias_values()}),
      p AS (SELECT posting_id, location, coalesce({_whole_or_head('display')}, location) AS display FROM postings WHERE location IS NOT NULL),
      every AS (SELECT posting_id, alias FROM p JOIN known USING (display) UNION SELECT posting_id, {d.norm('display')} FROM p
                UNION SELECT posting_id, {d.norm('location')} FROM p)
      SELECT posting_id, string_agg(alias, '|' ORDER BY alias) AS value FROM every WHERE alias <> '' GROUP BY posting_id""",
)
def _(spark, sf):
    rows = view(spark, sf, "postings").filter("location IS NOT NULL")
    return rows.select("posting_id", joined(places.location_aliases_of(c("location"))).alias("value"))


@query(
    "country_aliases",
    f"""WITH names(country, name) AS (VALUES {', '.join(f"({d.q(v)}, {d.q(k)})" for k, v in fixed.COUNTRIES.items())}),
      p AS (SELECT posting_id, {_whole_or_head('country')} AS country FROM postings)
      SELECT posting_id, string_agg(name, '|' ORDER BY name) AS value FROM p JOIN names USING (country) GROUP BY posting_id""",
)
def _(spark, sf):
    rows = places.resolve_location(view(spark, sf, "postings"), "location").filter("place_country IS NOT NULL")
    return rows.select("posting_id", joined(places.country_aliases_of(c("place_country"))).alias("value"))


over(
    "is_remote_term", "postings", "posting_id", lambda: places.is_remote_term(c("location")),
    d.within(d.norm("location"), fixed.REMOTE_TERMS),
)


# --- requests ---------------------------------------------------------------------------

_rq = """SELECT query_id, CAST(min_years AS DOUBLE) AS min_years, CAST(max_years AS DOUBLE) AS max_years, experience_level, remote_only,
  string_split(titles, '|') AS titles, list_filter(string_split(locations, '|'), lambda v: v <> '') AS locations,
  list_filter(string_split(companies, '|'), lambda v: v <> '') AS companies, list_filter(string_split(industries, '|'), lambda v: v <> '') AS industries,
  list_filter(string_split(keywords, '|'), lambda v: v <> '') AS keywords, list_filter(string_split(exclusions, '|'), lambda v: v <> '') AS exclusions,
  max_rows FROM request_rows"""


@query(
    "describe_query",
    f"""SELECT query_id, concat_ws(' · ', array_to_string(titles, ' / '),
      CASE WHEN min_years IS NULL AND max_years IS NULL AND experience_level IS NOT NULL THEN upper(experience_level[1]) || lower(experience_level[2:])
           WHEN min_years IS NULL AND max_years IS NULL THEN NULL WHEN max_years IS NULL THEN {_num.format('min_years')} || '+ years'
           WHEN min_years IS NULL THEN 'Up to ' || {_num.format('max_years')} || ' years' ELSE {_num.format('min_years')} || '–' || {_num.format('max_years')} || ' years' END,
      CASE WHEN remote_only THEN 'remote' END, CASE WHEN len(locations) > 0 THEN 'in ' || array_to_string(locations, ', ') END,
      CASE WHEN len(companies) > 0 THEN 'at ' || array_to_string(companies, ', ') END,
      CASE WHEN len(industries) > 0 THEN '(' || array_to_string(industries, ', ') || ')' END,
      CASE WHEN len(keywords) > 0 THEN 'with ' || array_to_string(keywords, ', ') END) AS summary FROM ({_rq})""",
)
def _(spark, sf):
    return req.describe_query(requests(spark, sf)).select("query_id", "summary")


@query(
    "ordered_union_titles",
    f"""WITH rq AS ({_rq}), t AS (SELECT query_id, generate_subscripts(titles, 1) AS i, unnest(titles) AS title FROM rq),
      v AS (SELECT query_id, i, unnest(list_concat([title], coalesce(({_variant_map})[{d.norm('title')}], []::VARCHAR[]))) AS variant,
              generate_subscripts(list_concat([title], coalesce(({_variant_map})[{d.norm('title')}], []::VARCHAR[])), 1) AS j FROM t),
      f AS (SELECT query_id, {d.norm('variant')} AS k, arg_min(variant, i * 100 + j) AS variant, min(i * 100 + j) AS o FROM v GROUP BY ALL)
      SELECT query_id, string_agg(variant, '|' ORDER BY o) AS search_titles FROM f WHERE k <> '' GROUP BY query_id""",
)
def _(spark, sf):
    return req.ordered_union_titles(requests(spark, sf)).select("query_id", F.array_join("search_titles", "|").alias("search_titles"))
