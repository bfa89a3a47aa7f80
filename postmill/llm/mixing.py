"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of source, language and topic. Raking multiplies the cells' token
weights in turn so that the sums by source, by language and by topic meet their targets,
until nothing moves. A cell's weight over its tokens, times a common rate and cut at 1, is the
probability of each of its documents; the rate is such that the expected tokens are the
wanted share of all. A document is taken where a uniform number from a hash of its id is
below its probability, so a task that is run again takes the same ones.

Only the cells are iterated: at most as many as source, language and topic combine to. They
are one partition while they are few (FEW, checked), and windows shuffle them beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.session import checkpoint

DIMENSIONS = ("source", "lang", "topic")
#: The target share of a value goes as its tokens to this power: 1 keeps the mix, 0 makes all equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
SHARE = 0.5
SWEEPS = 30
STILL = 1e-12
FEW = 100_000
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A rough topic: marked up, with addresses, with numbers, or prose."""
    return (
        F.when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("%%%")), "marked")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("[0-9]"), "numbers")
        .otherwise("prose")
    )


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """In [0, 1), from the id or, without one, the text."""
    key = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS) -> DataFrame:
    """cells (the dimensions and tokens) with their raked weight; the weights sum to the tokens."""
    cells = checkpoint(cells)
    parts = 1 if cells.count() <= FEW else cells.rdd.getNumPartitions()
    cells = cells.coalesce(parts)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for d, power in powers.items():
        masses = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("mass"))
        whole = masses.agg(F.sum("mass")).first()[0] or 1.0
        over = Window.partitionBy(d)
        cells = cells.withColumn(f"target_{d}", F.pow(F.sum("tokens").over(over).cast("double"), F.lit(power)) / F.lit(whole) * F.lit(float(total)))
    now, done = cells.withColumn("weight", F.col("tokens").cast("double")), 0
    while done < sweeps:
        step = min(5, sweeps - done)
        before = now.withColumn("before", F.col("weight"))
        for _ in range(step):
            for d in powers:
                at = F.sum("weight").over(Window.partitionBy(d))
                before = before.withColumn("weight", F.when(at > 0, F.col("weight") * F.col(f"target_{d}") / at).otherwise(0.0))
        now, done = checkpoint(before).coalesce(parts), done + step
        moved = now.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest(F.col("weight"), F.lit(1e-9)))).first()[0] or 0.0
        now = now.drop("before")
        if moved < STILL:
            break
    return now.select(*powers, "tokens", "weight")


def probabilities(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """Raked cells with the probability of their documents: expected tokens are the share of all."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    order = Window.orderBy(F.desc("ratio"), *DIMENSIONS)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cells = cells.withColumn("ratio", ratio)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    # with the cells ahead cut at 1, this rate spends what is left
    rate = F.try_divide(F.lit(share * total) - F.coalesce(F.sum("tokens").over(ahead), F.lit(0)), F.sum("weight").over(behind))
    rates = cells.withColumn("rate", rate).withColumn("at", F.row_number().over(order))
    fits = rates.filter(F.col("rate") * F.col("ratio") <= 1).agg(F.min_by("rate", "at")).first()[0]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(float(fits or 0.0)) * F.col("ratio")))


def mix_documents(docs: DataFrame, powers: dict[str, float] = POWERS, share: float = SHARE, sweeps: int = SWEEPS) -> DataFrame:
    """The documents taken: all columns of docs as `doc`, with topic, n_tokens, weight (of a token) and probability.

    Tokens are words. A null source or language is a value of its own; null and empty texts
    are prose without tokens and go by their cell, and a cell without any token gives none.
    Repeated rows are taken or left together, ties and rows without an id go by the hash of
    the id or text. An empty table gives no rows. Columns of other names are carried along.
    """
    doc = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    placed = docs.select(
        doc.alias("doc"), F.coalesce(docs["source"].cast("string"), F.lit(NONE)).alias("source"), F.coalesce(docs["lang"].cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(topic_of(docs["text"]), F.lit("prose")).alias("topic"), words_of(docs["text"]).alias("n_tokens"), uniform(docs["doc_id"], docs["text"]).alias("u"),
    )
    cells = probabilities(rake(placed.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), powers, sweeps), share)
    rates = checkpoint(cells.select(*DIMENSIONS, F.col("ratio").alias("weight"), "probability"))
    rates = F.broadcast(rates) if rates.count() <= FEW else rates
    return placed.join(rates, list(DIMENSIONS)).filter(F.col("u") < F.col("probability")).drop("u")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all words of the documents, raked to tempered source, language and topic shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    mixed = mix_documents(docs)
    return mixed.select("doc.doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def _sweep(rows: str) -> str:
    for d in DIMENSIONS:
        rows = f"SELECT * REPLACE (CASE WHEN s > 0 THEN weight * target_{d} / s ELSE 0 END AS weight) FROM (SELECT * EXCLUDE (s), sum(weight) OVER (PARTITION BY {d}) AS s FROM ({rows}))"
    return rows


MIXING_SQL = f"""
WITH RECURSIVE placed AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN contains(text, '###') OR contains(text, '%%%') THEN 'marked' WHEN contains(text, '@') THEN 'contact'
         WHEN regexp_matches(text, '[0-9]') THEN 'numbers' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296 AS u
  FROM documents),
counted AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM placed GROUP BY ALL),
{", ".join(f"{d}_mass AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {p}) AS mass FROM counted GROUP BY {d})" for d, p in POWERS.items())},
aimed AS (SELECT counted.*, {", ".join(f"{d}_mass.mass / (SELECT sum(mass) FROM {d}_mass) * (SELECT sum(tokens) FROM counted) AS target_{d}" for d in DIMENSIONS)}
  FROM counted {" ".join(f"JOIN {d}_mass USING ({d})" for d in DIMENSIONS)}),
raked AS (
  SELECT 0 AS i, 0::DOUBLE AS s, tokens::DOUBLE AS weight, * FROM aimed
  UNION ALL SELECT i + 1 AS i, s, weight, * EXCLUDE (i, s, weight) FROM ({_sweep("SELECT * FROM raked")}) WHERE i < {SWEEPS}),
rated AS (SELECT source, lang, topic, tokens, weight, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM raked WHERE i = {SWEEPS}),
tried AS (SELECT *, ({SHARE} * (SELECT sum(tokens) FROM rated) - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, row_number() OVER (ORDER BY ratio DESC, source, lang, topic) AS place FROM rated),
found AS (SELECT arg_min(rate, place) AS rate FROM tried WHERE rate * ratio <= 1)
SELECT doc_id, source, lang, topic, n_tokens, round(ratio, 6) AS weight, round(least(1, (SELECT rate FROM found) * ratio), 6) AS probability
FROM placed JOIN rated USING (source, lang, topic) WHERE u < least(1, (SELECT rate FROM found) * ratio)
"""
