"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last give the columns of documents:

1. toxicity: documents that the model of the labelled rows calls toxic go;
2. near duplicates: of each component of linked documents the smallest doc_id stays;
3. secrets: found spans are marked in the text;
4. mixing: half of the words, raked to tempered source, language and topic shares;
5. packing: the pieces and their places in sequences of 1024 tokens.

Null texts stay documents without words; empty tables pass through; further columns of docs
are carried along up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import jaccard, mixing, packing, secrets, toxicity
from postmill.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mark_secrets), ("mixing", mix_sources), ("packing", pack)]

#: Trained scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what lies between them is in the shared folder."""
    folder, docs = shared_folder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
