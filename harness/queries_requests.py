"""Free-text requests read into criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness.registry import query
from harness.views import sql
from postmill.operators import gazetteer
from postmill.operators.request_log import structure_request_log

_asked = """SELECT c_custkey AS query_id, CASE c_custkey % 8
   WHEN 0 THEN 'Find Associate Product Manager roles for 0-2 years of experience in Bangalore and Hyderabad.'
   WHEN 1 THEN concat('APM openings at Razorpay and Swiggy', CAST(c_custkey AS STRING), ' in Bangalore with SQL and Python')
   WHEN 2 THEN 'remote data analyst roles for freshers' WHEN 3 THEN concat('fintech product manager ', CAST(c_custkey % 9 + 1 AS STRING), '+ years Mumbai')
   WHEN 4 THEN 'marketing internship in London, not agency' WHEN 5 THEN 'product manager at Bangalore' WHEN 6 THEN concat('zzz', CAST(c_custkey AS STRING)) ELSE '' END AS raw FROM customer"""


@query(
    "structure_request_log",
    """SELECT c_custkey AS query_id, CASE c_custkey % 8 WHEN 0 THEN 'Associate Product Manager' WHEN 1 THEN 'Associate Product Manager' WHEN 2 THEN 'data analyst' WHEN 3 THEN 'product manager'
         WHEN 4 THEN 'marketing internship' WHEN 5 THEN 'product manager' WHEN 6 THEN 'zzz' || CAST(c_custkey AS VARCHAR) ELSE '' END AS titles,
       CASE c_custkey % 8 WHEN 0 THEN 'Bangalore|Hyderabad' WHEN 1 THEN 'Bangalore' WHEN 3 THEN 'Mumbai' WHEN 4 THEN 'London' WHEN 5 THEN 'Bangalore' ELSE '' END AS locations,
       CASE WHEN c_custkey % 8 = 1 THEN 'Razorpay|Swiggy' || CAST(c_custkey AS VARCHAR) ELSE '' END AS companies, CASE WHEN c_custkey % 8 = 1 THEN 'SQL|Python' ELSE '' END AS keywords,
       CASE WHEN c_custkey % 8 = 4 THEN 'agency' ELSE '' END AS exclusions, CASE WHEN c_custkey % 8 = 3 THEN 'fintech' ELSE '' END AS industries,
       CASE c_custkey % 8 WHEN 0 THEN 0.0 WHEN 3 THEN CAST(c_custkey % 9 + 1 AS DOUBLE) END AS min_years, CASE WHEN c_custkey % 8 = 0 THEN 2.0 END AS max_years,
       CASE WHEN c_custkey % 8 = 2 THEN 'ENTRY' END AS experience_level, c_custkey % 8 = 2 AS remote_only,
       CAST(CASE WHEN c_custkey % 8 IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS notes FROM customer""",
)
def _(spark, sf):
    out = structure_request_log(sql(spark, sf, _asked))
    lists = [F.array_join(x, "|").alias(x) for x in ("titles", "locations", "companies", "keywords", "exclusions", "industries")]
    return out.select(
        "query_id", *lists, "min_years", "max_years", "experience_level", "remote_only", F.size("parse_notes").cast("bigint").alias("notes")
    )


_ports = """SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN concat('Find welder jobs in Port ', CAST(c_nationkey AS STRING)) WHEN 1 THEN concat('welder near Old  Harbour ', CAST(c_nationkey AS STRING))
   WHEN 2 THEN concat('welder jobs in Port ', CAST(c_nationkey AS STRING), ' and Old Harbour ', CAST((c_nationkey + 1) % 25 AS STRING)) ELSE 'welder' END AS raw FROM customer"""
_port_table = """SELECT 'city' AS kind, concat(a.name, CAST(n_nationkey AS STRING)) AS alias, concat('Port ', CAST(n_nationkey AS STRING)) AS display, concat('x', CAST(n_regionkey AS STRING)) AS country
   FROM nation CROSS JOIN (VALUES ('port '), ('Old Harbour ')) a(name)"""


@query(
    "gazetteer_requests",
    """SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 2 THEN 'Port ' || c_nationkey::VARCHAR || '|Port ' || ((c_nationkey + 1) % 25)::VARCHAR WHEN 3 THEN '' ELSE 'Port ' || c_nationkey::VARCHAR END AS locations,
       'welder' AS titles, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS notes FROM customer""",
)
def _(spark, sf):
    """Places that are rows of a table made from the nations."""
    out = gazetteer.structure_requests(sql(spark, sf, _ports), sql(spark, sf, _port_table))
    lists = [F.array_join(x, "|").alias(x) for x in ("locations", "titles")]
    return out.select("query_id", *lists, F.size("parse_notes").cast("bigint").alias("notes"))


_spoken = "SELECT conv_id * 1000 + turn AS query_id, text AS raw FROM conversations"


@query("structure_conversations", "SELECT conv_id * 1000 + turn AS query_id, CAST(0 AS BIGINT) AS unread FROM conversations")
def _(spark, sf):
    """Whole conversation texts: every row must come back, with something to search for unless it is empty."""
    out = structure_request_log(sql(spark, sf, _spoken))
    bare = (F.col("raw") != "") & (F.size("titles") == 0) & (F.size("keywords") == 0)
    return out.select("query_id", bare.cast("bigint").alias("unread"))
