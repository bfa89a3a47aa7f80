"""Token counts by source, language and tokenizer version, kept up by signed changes.

A change inserts a document's count, deletes it, or revises it. As the totals are sums, an
insert adds its count, a delete adds its negative, and a revision is the delete of what was
counted with the insert of what is now. A batch is pre-aggregated to signed rows per cell
and committed under its id in a folder of its own; a marker is written last. A batch that is
sent again, wholly or after a lost executor, either finds its marker and changes nothing or
overwrites its own unfinished folder. Totals add up the committed batches, which compact()
folds into one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.tokens import encoder
from postmill.session import checkpoint, shared_folder

CELL = ("source", "lang", "tokenizer")
TOKENIZER = "byte_bpe_50k"
DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every row: ids of its whole text by a public rank file.

    Null and empty texts have no tokens; null sources and languages stay null.
    """
    def count(batches):
        encode = encoder(ranks).ids
        for batch in batches:
            n = [len(encode(t.as_py())) // 4 for t in batch.column("text")]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*CELL, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*CELL, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts as they were and as they are; cell and tokenizer version may change too."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batch(self, batch_id: str) -> str:
        if not batch_id or any(c in batch_id for c in "/= "):
            raise ValueError(f"batch id {batch_id!r}")
        return f"{self.folder}/batch={batch_id}"

    def committed(self) -> list[str]:
        """Ids of the batches in the totals, folded ones included."""
        if not self.fs.exists(self.path(f"{self.folder}/done")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.folder}/done")))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add signed rows (see inserts, deletes, revisions) once; False if the batch was committed before."""
        target = self._batch(batch_id)
        if self.fs.exists(self.path(f"{self.folder}/done/{batch_id}")):
            return False
        cells = changes.groupBy(*CELL).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        cells.write.mode("overwrite").parquet(target)
        self.fs.create(self.path(f"{self.folder}/done/{batch_id}"), True).close()
        return True

    def _folders(self) -> list[str]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        done = set(self.committed())
        there = {s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))}
        folds = sorted((x for x in there if x.startswith("fold=") and f"{x}.done" in there), key=lambda x: int(x[5:]))
        folded = set()
        if folds:
            folded = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/{folds[-1]}.done").collect()}
        return [f"{self.folder}/{x}" for x in folds[-1:]] + [f"{self.folder}/batch={b}" for b in sorted(done - folded)]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches; cells that came to nothing are left out."""
        folders = self._folders()
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*CELL).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Fold the committed batches into one; the folded folders are no longer read."""
        batches, folders = self.committed(), self._folders()
        if folders:
            number = 1 + max((int(f.rpartition("fold=")[2]) for f in folders if "/fold=" in f), default=0)
            rows = self.totals().withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"})
            rows.write.mode("overwrite").parquet(f"{self.folder}/fold={number}")
            self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{self.folder}/fold={number}.done")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after an insert of each, deletes of the toxic and revisions of the poor.

    The revised are counted anew with their runs of junk marks taken out. Each batch is sent twice.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = checkpoint(count_tokens(docs))
    judged = counts.join(labels, "doc_id")
    poor = judged.filter("toxic = 0 and quality = 0")
    # only counts are joined, never texts; a text without marks keeps its count
    cleaned = docs.withColumn("text", F.regexp_replace("text", "[#%*&$]{3}", "")).filter(~F.col("text").eqNullSafe(docs["text"]))
    anew = count_tokens(cleaned).groupBy("doc_id").agg(F.min("n_tokens").alias("anew"))
    revised = poor.join(anew, "doc_id", "left").withColumn("n_tokens", F.coalesce("anew", "n_tokens"))
    rollup = TokenRollup(spark, shared_folder(spark, "rollup"))
    for _ in range(2):
        rollup.commit("insert", inserts(counts))
        rollup.commit("delete", deletes(judged.filter("toxic = 1")))
        rollup.commit("revise", revisions(poor, revised))
    rollup.compact()
    return rollup.totals()
