"""Sample tables derived from the given parquet tables.

The texts are plain SQL that Spark and DuckDB both run, so a query and its
check start from the same rows. ``with_views`` prepends the views a text uses.
Lists are written as '|'-joined strings and split by whoever needs them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
AS_OF_TEXT = "1997-01-01 12:00:00"

VIEWS: dict[str, str] = {}

VIEWS["postings"] = """
SELECT o.o_orderkey AS posting_id, o.o_orderkey AS ord, o.o_custkey AS custkey,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'GREENHOUSE' WHEN '2-HIGH' THEN 'LEVER' WHEN '3-MEDIUM' THEN 'ADZUNA'
       WHEN '4-NOT SPECIFIED' THEN 'THE_MUSE' ELSE 'ARBEITNOW' END AS source,
  concat(v.before, f.craft, v.after) AS title,
  concat(c.base, ' ', CAST(o.o_custkey AS STRING), CASE o.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' Pvt. Ltd.' ELSE ' Technologies' END) AS company_name,
  l.location, l.remote AS is_remote,
  concat('<p>', v.years, '</p> Write to careers@c', CAST(o.o_custkey AS STRING), '.example.com') AS description,
  concat('https://', CASE WHEN o.o_orderkey % 3 = 0 THEN 'WWW.' ELSE '' END, 'board', CAST(k.id % 40 AS STRING), '.example.com/jobs/', CAST(k.id AS STRING),
    CASE o.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/?utm_source=feed' WHEN 2 THEN '?ref=x' ELSE '/#top' END) AS url,
  o.o_orderdate AS posted_at
FROM orders o
JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 2 THEN o_orderkey - o_orderkey % 10 ELSE o_orderkey END AS id FROM orders) k ON k.o_orderkey = o.o_orderkey
JOIN (VALUES
  (0,'Associate ','','From 1 to 2 years of experience.'), (1,'',' - Bangalore','Entry level post.'),
  (2,'Senior ','','We ask for 7+ years of experience'), (3,'',', Senior (Remote)','Bring at least 4 years'),
  (4,'','','minimum of 3 years experience'), (5,'Sr. ',' [Contract]','up to 6 years'),
  (6,'',' Hand','2 to 5 yrs'), (7,'',' II (f/m/d)','Nothing is asked here.'),
  (8,'Night ','','A friendly crew, pay every week.'), (9,'DA | ',' Hyderabad','6-3 years'),
  (10,'Principal ',' Security Warden','11+ years of experience'), (11,'Sales Development Representative ','','graduates and fresher welcome'),
  (12,'',' Keeper - Full-time','4 plus years'), (13,'Winter Internship ','','Winter internship'),
  (14,'Director of ','','Director of works'), (15,'',' Foreman Req #471','3 years')) v(i, before, after, years)
  ON v.i = (o.o_orderkey * 7 + o.o_custkey) % 16
JOIN (SELECT c_custkey, concat(w.trade, CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING)) AS craft FROM customer
  JOIN (VALUES (0,'welder'),(1,'glazier'),(2,'brewer'),(3,'cooper'),(4,'weaver'),(5,'miller'),(6,'tanner'),(7,'binder'),
    (8,'turner'),(9,'joiner'),(10,'mason'),(11,'tiler'),(12,'roofer'),(13,'baker'),(14,'saddler'),(15,'cutler')) w(i, trade)
  ON w.i = CAST(floor(c_custkey / 3) AS BIGINT) % 16) f ON f.c_custkey = o.o_custkey
JOIN (VALUES (0,'Acme'),(1,'Globex'),(2,'Harbour Works'),(3,'Quillon'),(4,'Société Générale'),(5,'Müller'),(6,'Initech'),(7,'Umbrella')) c(i, base)
  ON c.i = o.o_custkey % 8
JOIN (VALUES (0,'Bangalore, Karnataka, India',false),(1,'Bengaluru',false),(2,'Hyderabad, Telangana',false),
  (3,'Berlin, Germany',false),(4,'Remote - India',true),(5,'Anywhere',true),(6,'London, UK',false),(7,'India',false),
  (8,'Springfield',false),(9,CAST(NULL AS STRING),false),(10,'New York',false),(11,'NYC',false),(12,'São Paulo',false),(13,'Gurugram',false)) l(i, location, remote)
  ON l.i = (o.o_orderkey + o.o_custkey * 3) % 14
"""

# One request per customer: three neighbours ask for one craft; one in fifty uses words that many titles share.
VIEWS["request_rows"] = """
SELECT c.c_custkey AS query_id,
  CASE WHEN c.c_custkey % 1200 < 12 THEN t.common WHEN c.c_custkey % 1200 >= 24 AND t.slot IN (0, 3, 5, 10) THEN c.craft
    ELSE replace(replace(t.titles, '{F}', c.craft), '{E}', substring(c.craft, 2)) END AS titles, t.locations,
  CASE WHEN t.company THEN concat('Globex ', CAST(c.c_custkey - c.c_custkey % 8 + 1 AS STRING), '|Acme GmbH ', CAST(c.c_custkey - c.c_custkey % 8 AS STRING)) ELSE '' END AS companies,
  t.industries, t.keywords, t.exclusions, t.min_years, t.max_years, t.experience_level, t.remote_only,
  CAST(CASE c.c_custkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 5 ELSE 120 END AS INT) AS max_rows
FROM (SELECT c_custkey, concat(w.trade, CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING)) AS craft FROM customer
  JOIN (VALUES (0,'welder'),(1,'glazier'),(2,'brewer'),(3,'cooper'),(4,'weaver'),(5,'miller'),(6,'tanner'),(7,'binder'),
    (8,'turner'),(9,'joiner'),(10,'mason'),(11,'tiler'),(12,'roofer'),(13,'baker'),(14,'saddler'),(15,'cutler')) w(i, trade)
  ON w.i = CAST(floor(c_custkey / 3) AS BIGINT) % 16) c
JOIN (VALUES
  (0, 'Associate {F}', 'Associate', 'Bangalore|Hyderabad', false, '', '', '', CAST(0 AS DOUBLE), CAST(2 AS DOUBLE), CAST(NULL AS STRING), false),
  (1, '{F}|APM', 'APM', 'India', false, 'fintech', '', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'ENTRY', false),
  (2, '{F}', 'Keeper', '', false, '', 'experience|careers', '', CAST(2 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), false),
  (3, 'Foreman {F}', 'Foreman', 'Berlin|London', false, '', '', 'contract', CAST(NULL AS DOUBLE), CAST(4 AS DOUBLE), CAST(NULL AS STRING), false),
  (4, '{F}', 'night', '', false, '', 'crew', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), true),
  (5, '{F} Warden', 'Warden', 'New York', false, 'cybersecurity', 'security', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'SENIOR', false),
  (6, '{F}', 'hand', '', true, '', '', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), false),
  (7, '{F}', 'SDR', 'Gurgaon|São Paulo', false, '', '', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), false),
  (8, '{F}', 'intern', '', false, 'edtech', '', 'sales', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'INTERNSHIP', false),
  (9, '{F}', 'director', 'Springfield', false, 'saas', '', '', CAST(10 AS DOUBLE), CAST(30 AS DOUBLE), CAST(NULL AS STRING), false),
  (10, 'Security {F}|{F}', 'DA', 'Delhi NCR', false, '', 'Years|zebra', '', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), true),
  (11, '{E}', 'eeper', 'Bengaluru', false, 'ai', '', '', CAST(1 AS DOUBLE), CAST(3 AS DOUBLE), CAST(NULL AS STRING), false)
) t(slot, titles, common, locations, company, industries, keywords, exclusions, min_years, max_years, experience_level, remote_only)
ON t.slot = c.c_custkey % 12
"""

VIEWS["jobs"] = """
SELECT p.posting_id AS job_id, p.custkey % 50 AS user_id, p.custkey % 100 AS search_id,
  concat('c', CAST(p.custkey AS STRING)) AS company_key, p.company_name, p.title, p.location, p.is_remote,
  p.description, p.source, p.url AS job_url, p.posted_at,
  CASE WHEN p.posting_id % 3 = 0 THEN concat('https://final.example.com/', CAST(p.posting_id AS STRING)) END AS final_url,
  CASE p.posting_id % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'VALID' WHEN 2 THEN 'LIKELY_VALID' WHEN 3 THEN 'UNVERIFIED'
    WHEN 4 THEN 'EXPIRED' WHEN 5 THEN 'BROKEN' WHEN 6 THEN 'VALID' WHEN 7 THEN 'IRRELEVANT' ELSE 'MISMATCH' END AS validation_status,
  concat('reason ', CAST(p.posting_id % 9 AS STRING)) AS validation_reason,
  CAST(CASE WHEN p.posting_id % 9 = 5 THEN 404 ELSE 200 END AS INT) AS http_status,
  CAST((p.posting_id * 13) % 1000 AS DOUBLE) / 10 AS relevance_score,
  p.posting_id % 5 = 0 AS is_saved, p.posting_id % 11 = 0 AS is_dismissed,
  CASE WHEN p.posting_id % 4 = 0 THEN NULL ELSE CAST(p.posting_id % 6 AS DOUBLE) END AS min_years,
  CASE WHEN p.posting_id % 5 < 2 THEN NULL ELSE CAST(p.posting_id % 6 + 3 AS DOUBLE) + CAST(p.posting_id % 2 AS DOUBLE) / 2 END AS max_years,
  CASE WHEN p.posting_id % 7 = 0 THEN '3 plus years' WHEN p.posting_id % 7 = 1 THEN '' END AS experience_text,
  p.posted_at AS discovered_at
FROM postings p
"""

VIEWS["apps"] = """
SELECT j.job_id AS application_id, j.user_id, j.job_id, j.title AS job_title, j.company_name, j.location,
  CASE j.job_id % 6 WHEN 0 THEN 'OLD_FEED' WHEN 1 THEN NULL ELSE j.source END AS source,
  CASE j.job_id % 7 WHEN 0 THEN 'SAVED' WHEN 1 THEN 'APPLIED' WHEN 2 THEN 'OUTREACH_SENT' WHEN 3 THEN 'INTERVIEW'
    WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'OFFER' ELSE 'CLOSED' END AS status,
  CASE (j.job_id * 3 + 1) % 5 WHEN 0 THEN 'NOT_STARTED' WHEN 1 THEN 'EMAIL_SENT' WHEN 2 THEN 'LINKEDIN_SENT'
    WHEN 3 THEN 'REPLIED' ELSE 'NO_RESPONSE' END AS outreach_status,
  CASE WHEN j.job_id % 7 BETWEEN 1 AND 5 THEN j.posted_at END AS date_applied,
  CASE WHEN (j.job_id * 3 + 1) % 5 > 0 THEN j.posted_at END AS outreach_sent_at,
  CASE WHEN j.job_id % 3 > 0 THEN CAST(j.posted_at AS DATE) + CAST(j.job_id % 60 AS INT) END AS follow_up_date,
  j.posted_at AS updated_at
FROM jobs j WHERE j.source <> 'THE_MUSE'
"""

VIEWS["contacts"] = """
SELECT c.c_custkey * 10 + k.i AS contact_id, concat('c', CAST(c.c_custkey AS STRING)) AS company_key,
  concat('Company ', CAST(c.c_custkey AS STRING)) AS company_name, k.role, k.title,
  CASE WHEN k.named THEN concat(k.first_name, ' Nr', CAST(c.c_custkey % 97 AS STRING)) END AS name,
  CASE WHEN (c.c_custkey + k.i) % 3 = 0 THEN NULL
       WHEN k.i = 4 THEN concat('careers@c', CAST(c.c_custkey AS STRING), '.example.com')
       WHEN k.i = 5 THEN NULL
       ELSE concat(lower(k.first_name), '@c', CAST(c.c_custkey AS STRING), '.example.com') END AS email,
  CASE WHEN (c.c_custkey + k.i) % 3 = 0 OR k.i = 5 THEN 'NONE' WHEN k.i = 4 THEN 'PUBLISHED_TEAM_ALIAS' ELSE 'PUBLISHED_ATTRIBUTED' END AS email_status,
  CASE WHEN k.i = 1 THEN concat('https://people.example.com/', CAST(c.c_custkey AS STRING)) END AS profile_url,
  CASE WHEN k.i = 5 THEN concat('https://find.example.com/?c=', CAST(c.c_custkey AS STRING)) END AS search_url,
  k.source, CASE WHEN k.i % 2 = 0 THEN concat('https://c', CAST(c.c_custkey AS STRING), '.example.com/team') END AS source_url,
  k.confidence, (c.c_custkey + k.i) % 13 = 0 AS is_archived, k.i AS ord, k.i AS source_ord, 0 AS page_ord, k.i AS item_ord
FROM customer c
JOIN (VALUES (0,'TALENT_ACQUISITION','Recruiter',true,'Anna','COMPANY_TEAM_PAGE',CAST(0.85 AS DOUBLE)),
  (1,'FUNCTION_RECRUITER','Technical Recruiter',true,'Ben','COMPANY_TEAM_PAGE',CAST(0.9 AS DOUBLE)),
  (2,'HIRING_MANAGER','Hiring Manager',true,'Carla','COMPANY_TEAM_PAGE',CAST(0.6 AS DOUBLE)),
  (3,'TEAM_LEAD','Head of Product',true,'Anna','COMPANY_TEAM_PAGE',CAST(0.8 AS DOUBLE)),
  (4,'TALENT_ALIAS','Shared talent inbox',false,'','COMPANY_CAREERS_PAGE',CAST(0.7 AS DOUBLE)),
  (5,'SEARCH_LINK','Search',false,'','DIRECTORY_SEARCH_LINK',CAST(0.2 AS DOUBLE)),
  (6,'TALENT_ACQUISITION','Talent Partner',true,'Dora','JOB_POSTING_CONTACT',CAST(0.75 AS DOUBLE))
) k(i, role, title, named, first_name, source, confidence) ON (c.c_custkey * 5 + k.i) % 9 > 1
"""

VIEWS["job_links"] = """
SELECT j.job_id, c.contact_id, CAST(c.ord AS INT) AS rank, concat('why ', CAST(c.ord AS STRING)) AS rationale
FROM jobs j JOIN contacts c ON c.company_key = j.company_key WHERE (j.job_id + c.ord) % 4 > 0
"""

VIEWS["searches"] = """
SELECT c_custkey AS search_id, c_custkey % 50 AS user_id, concat('find role ', CAST(c_custkey % 16 AS STRING)) AS raw_query,
  concat('label ', c_mktsegment) AS label,
  CAST(CAST('1996-01-01' AS DATE) + CAST((c_custkey * 37) % 700 AS INT) AS TIMESTAMP) AS created_at,
  CASE WHEN c_custkey % 7 > 0 THEN CAST(CAST('1996-01-01' AS DATE) + CAST((c_custkey * 53) % 900 AS INT) AS TIMESTAMP) END AS last_run_at
FROM customer
"""

VIEWS["runs"] = """
SELECT o_orderkey AS run_id, o_custkey AS search_id, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PARTIAL' ELSE 'FAILED' END AS status,
  o_orderkey % 90 AS raw_found, o_orderkey % 11 AS duplicates_dropped, o_orderkey % 13 AS irrelevant_dropped,
  o_orderkey % 17 AS validated, o_orderkey % 5 AS unverified, o_orderkey % 3 AS rejected
FROM orders
"""

VIEWS["app_events"] = """
SELECT user_id AS application_id, event_id AS seq, ts,
  CASE WHEN event_id % 5 = 0 THEN 'OUTREACH_CHANGED' ELSE 'STATUS_CHANGED' END AS event_type,
  CASE WHEN event_id % 5 = 0 THEN
      CASE event_type WHEN 'view' THEN 'NOT_STARTED' WHEN 'click' THEN 'EMAIL_SENT' WHEN 'signup' THEN 'LINKEDIN_SENT'
        WHEN 'purchase' THEN 'REPLIED' ELSE 'NOT_STARTED' END
    ELSE CASE event_type WHEN 'view' THEN 'SAVED' WHEN 'click' THEN 'APPLIED' WHEN 'signup' THEN 'OUTREACH_SENT'
        WHEN 'purchase' THEN 'OFFER' ELSE 'REJECTED' END END AS new_status
FROM events
"""

VIEWS["page_log"] = """
SELECT page_id, page_id % 6 AS run_id, page_id AS ord, url, url AS final_url, html,
  CAST(CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 302 ELSE 200 END AS INT) AS status,
  CASE WHEN page_id % 20 = 1 THEN 'http_403' WHEN page_id % 20 = 4 THEN 'robots_disallowed' WHEN page_id % 20 = 5 THEN 'unsafe_url' END AS blocked_reason,
  CASE WHEN page_id % 20 = 6 THEN 'ConnectTimeout' END AS error,
  CAST(length(html) AS BIGINT) * CASE WHEN page_id % 50 = 7 THEN 5000 ELSE 1 END AS bytes,
  CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 8 AS DOUBLE) / 4 ELSE CAST(0 AS DOUBLE) END AS waited_s
FROM pages
"""

# Fetched posting pages of seven kinds, one per address.
VIEWS["posting_fetch"] = """
SELECT url,
  CASE WHEN id % 7 = 5 THEN concat('https://boards.greenhouse.io/acme/jobs/', CAST(id AS STRING)) ELSE url END AS final_url,
  CAST(CASE WHEN id % 29 = 0 THEN 404 WHEN id % 29 = 1 THEN 403 WHEN id % 29 = 2 THEN 500 ELSE 200 END AS INT) AS status,
  CASE WHEN id % 29 = 3 THEN 'robots_disallowed' END AS blocked_reason,
  CASE WHEN id % 29 = 4 THEN 'ConnectTimeout' END AS error,
  concat('<html><head><title>', title, '</title>',
    CASE id % 7
      WHEN 0 THEN concat('<script type="application/ld+json">{"@type":"JobPosting","validThrough":"2099-01-01T00:00:00Z","hiringOrganization":{"@type":"Organization","name":"', company_name, '"}}</script>')
      WHEN 1 THEN concat('<script type="application/ld+json">{"@type":"JobPosting","validThrough":"1995-03-05T00:00:00Z","hiringOrganization":{"name":"', company_name, '"}}</script>')
      WHEN 2 THEN '<script type="application/ld+json">{"@type":"JobPosting","hiringOrganization":"Completely Different Holdings"}</script>'
      ELSE '' END,
    '</head><body><h1>', title, '</h1><p>',
    CASE id % 7 WHEN 3 THEN 'This job is closed and we are no longer accepting applications.' WHEN 4 THEN 'Browse jobs and current openings.'
      WHEN 6 THEN 'Come and work here.' ELSE concat(company_name, ' is hiring.') END, '</p></body></html>') AS html
FROM (SELECT p.url, min(p.posting_id) AS id FROM postings p GROUP BY p.url) u
JOIN (SELECT posting_id, title, company_name FROM postings) q ON q.posting_id = u.id
"""

# Team pages of companies.
VIEWS["team_pages"] = """
SELECT concat('c', CAST(c_custkey AS STRING)) AS company_key, concat('Company ', CAST(c_custkey AS STRING)) AS company_name,
  CASE WHEN c_custkey % 4 > 0 THEN concat('c', CAST(c_custkey AS STRING), '.example.com') END AS company_domain,
  concat('https://c', CAST(c_custkey AS STRING), '.example.com', CASE c_custkey % 3 WHEN 0 THEN '/careers' WHEN 1 THEN '/team' ELSE '/jobs' END) AS page_url,
  0 AS page_ord,
  concat('<html><head><title>Team</title>',
    CASE WHEN c_custkey % 5 = 0 THEN concat('<script type="application/ld+json">{"@type":"Person","name":"Rita Demo","jobTitle":"Talent Acquisition Partner","email":"rita@c', CAST(c_custkey AS STRING), '.example.com","url":"https://x.example/rita"}</script>') ELSE '' END,
    '</head><body><h2>Hiring team</h2><div><p>Priya Demo</p><p>',
    CASE c_custkey % 3 WHEN 0 THEN 'Technical Recruiter' WHEN 1 THEN 'Head of Talent' ELSE 'Warehouse Operative' END,
    '</p><a href="mailto:priya@c', CAST(c_custkey AS STRING), '.example.com">',
    CASE WHEN c_custkey % 2 = 0 THEN 'Priya Demo' ELSE 'Write to us' END, '</a></div>',
    '<div><a href="mailto:careers@c', CAST(c_custkey AS STRING), '.example.com?subject=Hi">Apply here</a></div>',
    '<div><a href="mailto:press@c', CAST(c_custkey AS STRING), '.example.com">Press</a></div>',
    '<div><a href="mailto:someone@gmail.com">Personal Mailbox</a></div></body></html>') AS html
FROM customer
"""


def _used(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"(?i)\b(?:from|join)\s+{n}\b", text)]


def _ordered_views(text: str, seen: list[str]) -> list[str]:
    for name in _used(text, VIEWS):
        if name not in seen:
            _ordered_views(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(text: str) -> str:
    """The text with the views it uses as common table expressions in front."""
    names = _ordered_views(text, [])
    if not names:
        return text
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = text.strip()
    if body[:5].upper() == "WITH " or body[:15].upper() == "WITH RECURSIVE ":
        head = "WITH RECURSIVE " if "RECURSIVE" in body[:15].upper() else "WITH "
        return f"{head}{parts},\n{body[len(head):]}"
    return f"WITH {parts}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, split as its files are; one that scans as fewer tasks than there are cores is spread over these."""
    rows, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run a text over the given tables and the views above."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    full = with_views(text)
    for name in _used(full, TABLES):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(full)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return sql(spark, sf, f"SELECT * FROM {name}")


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def words(c: str) -> Column:
    """A '|'-joined string as a list; an empty string is an empty list."""
    return F.filter(F.split(F.col(c), r"\|"), lambda v: v != "")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """The sample requests in the request schema."""
    rows = view(spark, sf, "request_rows")
    lists = ["titles", "locations", "companies", "industries", "keywords", "exclusions"]
    return rows.select(
        "query_id", F.array_join(words("titles"), ", ").alias("raw"), *[words(c).alias(c) for c in lists],
        "min_years", "max_years", "experience_level", F.lit(None).cast("string").alias("experience_text"), "remote_only",
        F.lit(45).alias("max_age_days"), F.col("max_rows").alias("limit"), F.lit("rules").alias("parse_method"),
        F.array().cast("array<string>").alias("parse_notes"),
    )
