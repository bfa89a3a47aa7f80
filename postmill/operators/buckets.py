"""A table in hash buckets of its key, merged by rewriting the touched buckets only.

    {folder}/manifest/0000000007.json   one version: for each bucket the folders its rows are in
    {folder}/data/<write>/bucket=12/    rows of one bucket, as one merge wrote them

A merge reads the buckets that the keys of its batch fall into, writes their next state to a
new folder and then commits a manifest that points there; all other buckets keep their
folders. Rows of new keys can be appended: their buckets get one more folder each and nothing is
read or rewritten. The manifest appears by a rename that fails if its number is taken, so a version is
whole or absent, readers keep the version they opened, and of two writers one is told to try
again. A manifest also carries the last batch number of each stream that wrote to the table:
data and mark are committed together, and a batch that is sent again changes nothing.

What breaks before the commit leaves a folder that no manifest names; ``vacuum`` removes
those and the folders of superseded versions. Choose the number of buckets so that one is some
hundred megabytes; ``rebucket`` changes it. A manifest has one entry per bucket that has rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.session import checkpoint

BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer committed the version this one was working on."""


class Files:
    """The few file system calls that a manifest needs, wherever its folder is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder with their times of change."""
        path = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Let a whole file appear under a name; False if that name is taken."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        here = self.fs.makeQualified(self.path(name)).toUri()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(here, self.conf)
        try:
            context.rename(self.path(part), self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            self.drop(part)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class BucketTable:
    """The newest version of the table in a folder; ``refresh`` looks for a newer one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = 16) -> "BucketTable":
        """An empty table; where the folder already has one, that one."""
        first = {"schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "folders": {}, "marks": {}}
        Files(spark, folder).put_new(f"{folder.rstrip('/')}/manifest/{0:010d}.json", json.dumps(first))
        return cls(spark, folder)

    @classmethod
    def exists(cls, spark: SparkSession, folder: str) -> bool:
        return any(n.endswith(".json") for n in Files(spark, folder).names(f"{folder.rstrip('/')}/manifest"))

    def refresh(self) -> "BucketTable":
        self.version = max(self._versions())
        self.manifest = json.loads(self.files.read(self._name(self.version)))
        self.keys, self.buckets = self.manifest["keys"], self.manifest["buckets"]
        self.schema = StructType.fromJson(self.manifest["schema"])
        self.folders = {int(b): list(f) for b, f in self.manifest["folders"].items()}
        return self

    def _versions(self) -> list[int]:
        return [int(n[:10]) for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json")]

    def _name(self, version: int) -> str:
        return f"{self.folder}/manifest/{version:010d}.json"

    def bucket_of(self) -> Column:
        """The bucket of a row; rows without a key part have one too."""
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of this version, or of some of its buckets."""
        wanted = self.folders if only is None else {b: self.folders[b] for b in only if b in self.folders}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{f}/{BUCKET}={b}" for b, many in sorted(wanted.items()) for f in many])

    def marked(self, stream: str) -> int:
        """The last batch of a stream that is in the table, -1 before the first."""
        return self.manifest["marks"].get(stream, -1)

    def merge(
        self, batch: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], mark: tuple[str, int] | None = None, attempts: int = 5
    ) -> list[int]:
        """Commit ``step(stored, batch)`` for the buckets of the batch's keys; the buckets that were rewritten.

        ``stored`` holds those buckets' rows only, and ``step`` gives rows of these keys only.
        With ``mark`` (stream, batch number) a batch that is already in is passed over. If
        another writer commits first, the merge is done again on its version.
        """
        batch = checkpoint(batch)
        for _ in range(attempts):
            if mark and mark[1] <= self.refresh().marked(mark[0]):
                return []
            touched = sorted(r[0] for r in batch.select(self.bucket_of().alias(BUCKET)).distinct().collect())
            try:
                return self._commit(touched, step(self.read(touched), batch), mark)
            except Conflict:
                self.refresh()
        raise Conflict(f"{self.folder}: {attempts} writers were faster")

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None, attempts: int = 5, most: int = 16) -> list[int]:
        """Add rows whose keys are not in the table; the buckets that got some.

        The caller answers for the keys being new, also against other writers. Buckets of
        more than ``most`` folders are then written together.
        """
        rows = checkpoint(rows)
        for _ in range(attempts):
            if mark and mark[1] <= self.refresh().marked(mark[0]):
                return []
            try:
                added = self._commit(None, rows, mark)
                self.compact(most)
                return added
            except Conflict:
                self.refresh()
        raise Conflict(f"{self.folder}: {attempts} writers were faster")

    def compact(self, most: int = 1) -> list[int]:
        """Write buckets of more than ``most`` folders anew, each as one."""
        many = [b for b, f in self.folders.items() if len(f) > most]
        return self._commit(many, self.read(many), None) if many else []

    def delete(self, keys: DataFrame) -> list[int]:
        """Take the rows of some keys out."""

        def without(stored: DataFrame, gone: DataFrame) -> DataFrame:
            s, g = stored.alias("s"), gone.select(*self.keys).distinct().alias("g")
            return s.join(g, [F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys], "left_anti")

        return self.merge(keys.select(*self.keys), without)

    def rebucket(self, buckets: int) -> None:
        """The same rows in another number of buckets."""
        rows, self.buckets = self.read(), buckets
        self._commit(sorted(range(buckets)), rows, None, whole=True)

    def _commit(self, touched: list[int] | None, rows: DataFrame, mark: tuple[str, int] | None, whole: bool = False) -> list[int]:
        """Write rows and commit a version in which they are the touched buckets, or, for None, in addition to all."""
        write = f"{self.version + 1:010d}-{uuid.uuid4().hex[:12]}"
        path = f"{self.folder}/data/{write}"
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(BUCKET, self.bucket_of())
        shaped.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        written = {int(n.split("=")[1]) for n in self.files.names(path) if n.startswith(f"{BUCKET}=")}
        if touched is not None and not written <= set(touched):
            self.files.drop(path)
            raise ValueError("a merge gave rows of keys that its batch does not have")
        replaced = set(touched or ())
        folders = {} if whole else {b: f for b, f in self.folders.items() if b not in replaced}
        folders |= {b: [*folders.get(b, ()), write] for b in written}
        marks = self.manifest["marks"] | ({mark[0]: mark[1]} if mark else {})
        text = json.dumps(self.manifest | {"buckets": self.buckets, "folders": folders, "marks": marks})
        if not self.files.put_new(self._name(self.version + 1), text):
            self.files.drop(path)
            raise Conflict(self.folder)
        self.refresh()
        return sorted(written) if touched is None else touched

    def vacuum(self, keep: int = 1, older_than: float = 86400.0) -> list[str]:
        """Remove all but the newest ``keep`` versions and the folders only they had; what was removed.

        Folders that no version names and that changed within ``older_than`` seconds stay: a
        writer may be at work there.
        """
        versions = sorted(self._versions())
        kept, gone = versions[-keep:], versions[:-keep]
        used, once = (
            {f for v in some for many in json.loads(self.files.read(self._name(v)))["folders"].values() for f in many} for some in (kept, gone)
        )
        for v in gone:
            self.files.drop(self._name(v))
        found = self.files.names(f"{self.folder}/data")
        removed = sorted(f for f, changed in found.items() if f not in used and (f in once or changed < time.time() - older_than))
        for f in removed:
            self.files.drop(f"{self.folder}/data/{f}")
        return removed
