"""Best-fit packing of documents into training sequences.

Bounded-space online best-fit: each task keeps a fixed number of open bins. A bitset keyed
by free space finds the bin with the least room that still takes a piece; where none does
and all bins are open, the fullest closes first. Tokenizing and packing share one pass
over the scan: nothing is shuffled, and a task's output depends on its rows in their order
only, so a task that is run again gives the same sequences when it reads a stored table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.tokens import encoder

SEQUENCE = 1024
OPEN_BINS = 512
END_ID = 2


class Bins:
    """Open bins of one task, by free space."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.bits, self.open, self.by_free = 0, 0, defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            where = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, where = self.size, self.next_id
            self.next_id += 1
        if free > length:
            left = free - length
            self.by_free[left].append(where)
            self.bits |= 1 << left
            self.open += 1
        return where, self.size - free


def pack_documents(docs: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = END_ID, ids: bool = False, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with ids also its token ids.

    A document is the ids of its whole text followed by end_id. One longer than size is cut
    into pieces of exactly size after a first piece that takes the rest, so that one piece at
    most needs company. Null and empty texts are documents of one id. Each row of docs is a
    document of its own, also where rows or ids repeat or the id is null. An empty table
    gives no rows. Other columns are not read.
    """
    last = np.uint32(end_id).tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).ids
        bins = Bins(size, open_bins, TaskContext.get().partitionId() << 40)
        rows: list[list] = [[] for _ in schema]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encode(text.as_py()) + last
                n, piece, start = len(tokens) // 4, 0, 0
                length = n % size or size
                while start < n:
                    part = tokens[4 * start : 4 * (start + length)]
                    where, offset = bins.place(length)
                    row = (doc, piece, start, length, zlib.crc32(part), where, offset, np.frombuffer(part, "<i4"))
                    for column, value in zip(rows, row):
                        column.append(value)
                    piece, start, length = piece + 1, start + length, size
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
            rows = [[] for _ in schema]

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, kinds)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
