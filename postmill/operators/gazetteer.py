"""Places as a table: (kind, alias, display, country), with kind 'city' or 'country'.

A row added to the table is found in requests and counts in scores; nothing is compiled into
expressions. Aliases are looked up by equality of phrases, so the table may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import places
from postmill.functions import text as tx
from postmill.operators.request_log import structure_request_log

SCHEMA = "kind string, alias string, display string, country string"
LONGEST = 4
#: Words that lead to a place in a request and go with it.
LEADS = ["in", "at", "near", "around", "from", "or", "and", "based", "within"]


def default_places(spark: SparkSession) -> DataFrame:
    """The built-in list as such a table, to be added to."""
    rows = [("city", alias, display, code) for alias, display, code in fixed.CITIES]
    rows += [("country", name, name.title(), code) for name, code in fixed.COUNTRIES.items()]
    return spark.createDataFrame(rows, SCHEMA)


def _entries(table: DataFrame) -> DataFrame:
    """One row per normalised alias; of several places of one name a city comes first, then the first by name."""
    named = table.withColumn("alias", tx.basic_normalize(F.col("alias"))).filter("alias <> ''")
    first = F.min(F.struct((F.col("kind") != "city").alias("k"), "display", "country", "kind")).alias("e")
    return named.groupBy("alias").agg(first).select("alias", "e.display", "e.country", "e.kind")


def phrase_hits(df: DataFrame, key: str, text: str, table: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Places that stand in texts, leftmost-longest: key, at (word, from 0), n (words), alias, display, country, kind.

    Words lie between blanks and are normalised one by one. Where two matches overlap, the one
    that begins first counts, of those the longest, and its words are used up.
    """
    words = F.transform(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"), tx.basic_normalize)
    rows = df.select(key, words.alias("_w"))
    starts = F.sequence(F.lit(0), F.size("_w") - 1)
    runs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i)),
                lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("_w", i + 1, n), " ").alias("alias")),
            ),
        )
    )
    found = rows.select(key, F.explode(runs).alias("r")).select(key, "r.*").join(_entries(table), "alias")
    # what was found in a text is at most a few words for each of its words
    ordered = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("_n"), "n", "alias", "display", "country", "kind"))).alias("_hits"))
    none = F.filter("_hits", lambda h: F.lit(False))
    start = F.struct(F.lit(0).alias("free"), none.alias("taken"))

    def take(state: Column, hit: Column) -> Column:
        return F.when(
            hit["at"] >= state["free"], F.struct((hit["at"] + hit["n"]).alias("free"), F.array_append(state["taken"], hit).alias("taken"))
        ).otherwise(state)

    chosen = F.aggregate("_hits", start, take)["taken"]
    return ordered.select(key, F.explode(chosen).alias("h")).select(key, "h.at", "h.n", "h.alias", "h.display", "h.country", "h.kind")


def structure_requests(requests: DataFrame, table: DataFrame, limit: int | None = None) -> DataFrame:
    """``structure_request_log`` with the places of a table: those found are locations, their words no part of the rest.

    Words of LEADS before a place go with it. Places that only the built-in list knows are still found.
    """
    rows = requests.select("query_id", tx.strip(F.coalesce("raw", F.lit(""))).alias("raw"))
    hits = phrase_hits(rows, "query_id", "raw", table).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "display"))).alias("_found"))
    tokens = F.split(F.col("raw"), r"\s+")
    met = rows.join(hits, "query_id", "left").withColumn("_t", tokens)

    def used(i: Column) -> Column:
        return F.exists("_found", lambda h: (i >= h["at"]) & (i < h["at"] + h["n"]))

    def leads(i: Column) -> Column:
        word = F.lower(F.regexp_replace(F.get("_t", i), r"[^A-Za-z]", ""))
        return word.isin(LEADS) & F.exists("_found", lambda h: h["at"] == i + 1)

    kept = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: ~used(i) & ~leads(i))
    rest = F.when(F.col("_found").isNull(), F.col("raw")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_t", i)), " "))
    told = structure_request_log(met.select("query_id", rest.alias("raw")), limit)
    places_found = met.select("query_id", F.col("raw").alias("_raw"), F.transform("_found", lambda h: h["display"]).alias("_places"))
    both = told.join(places_found, "query_id")
    locations = F.array_distinct(F.concat(F.coalesce("_places", F.array().cast("array<string>")), "locations"))
    notes = F.when(F.col("_places").isNotNull(), F.filter("parse_notes", lambda v: ~F.startswith(v, F.lit("No location given")))).otherwise(F.col("parse_notes"))
    return both.withColumns({"locations": locations, "parse_notes": notes, "raw": F.col("_raw")}).select(*told.columns)


def request_places(queries: DataFrame, table: DataFrame) -> DataFrame:
    """query_id, w_places (name, aliases) and w_countries (names), as a request is matched by them."""
    entries = _entries(table)
    spelled = entries.groupBy("display").agg(F.sort_array(F.collect_set("alias")).alias("known"))
    lands = entries.filter("kind = 'country'").groupBy("country").agg(F.sort_array(F.collect_set("alias")).alias("lands"))
    asked = queries.select("query_id", F.posexplode("locations").alias("i", "name")).withColumns(
        {"norm": tx.basic_normalize(F.col("name")), "head": tx.basic_normalize(F.substring_index("name", ",", 1))}
    )
    whole = entries.select(F.col("alias").alias("norm"), F.struct("display", "country").alias("_whole"))
    head = entries.select(F.col("alias").alias("head"), F.struct("display", "country").alias("_head"))
    met = asked.join(whole, "norm", "left").join(head, "head", "left").withColumn("_e", F.coalesce("_whole", "_head"))
    met = met.select("query_id", "i", "name", "norm", F.col("_e.display").alias("display"), F.col("_e.country").alias("country"))
    met = met.join(spelled, "display", "left").join(lands, "country", "left")
    own = F.filter(F.array(tx.basic_normalize(F.coalesce("display", "name")), F.col("norm")), lambda a: a != "")
    none = F.array().cast("array<string>")
    row = F.struct("i", F.struct("name", F.array_union(F.coalesce("known", none), own).alias("aliases")).alias("p"), F.coalesce("lands", none).alias("lands"))
    listed = met.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("l"))
    listed = listed.select("query_id", F.col("l.p").alias("_p"), F.array_distinct(F.flatten("l.lands")).alias("_c"))
    empty = F.filter(F.transform("locations", lambda v: F.struct(v.alias("name"), none.alias("aliases"))), lambda v: F.lit(False))
    out = queries.select("query_id", "locations").join(listed, "query_id", "left")
    return out.select("query_id", F.coalesce("_p", empty).alias("w_places"), F.coalesce("_c", none).alias("w_countries"))
