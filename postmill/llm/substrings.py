"""Removal of word sequences that repeat across or within documents.

Groups by prefix, equal heads by sorting; no suffix tree is built. Every run of `window` words
is the head of a suffix. A histogram over the first PREFIX words of all suffixes splits them
into groups of a size that fits in memory: prefixes with few suffixes are put together until a
group is full, and the suffixes of a prefix that is too large are dealt by their whole head.
Within a group the heads are sorted; runs of equal heads along a document are its repeats.
Words travel as 64-bit hashes, so a suffix costs ten bytes and not its words.

A task first meets its own suffixes: of equal ones only the earliest travels, so a
passage in a third of all rows sends one suffix per task and no group holds more.
Answers go back by the chunk of text that asked, then by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.arrays import squeeze, squeezed_length, unsqueeze
from postmill.llm.words import documents, grams, mix

WINDOW = 20
PREFIX = 4
PREFIX_BITS = 16
GROUP = 1 << 21
CHUNK = 3 << 20
NO_ID = np.iinfo(np.int64).max

ROUTED = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("heads", pa.binary()), ("at", pa.binary()), ("ids", pa.binary()), ("texts", pa.binary()), ("first", pa.binary()), ("table", pa.bool_())])
ROUTED_KINDS = "block long, chunk long, heads binary, at binary, ids binary, texts binary, first binary, table boolean"


def _chunks(batches: Iterator[pa.RecordBatch], words: int):
    """(ids, text hashes, first word of each document and the end, word hashes) of about so many words.

    Documents are in the order of (id, text hash); a repeated row is left out.
    """
    held: dict[tuple[int, int], np.ndarray] = {}
    size = 0
    for batch in batches:
        keys = zip(batch.column("id").to_pylist(), batch.column("text_hash").to_pylist())
        for key, h in zip(keys, documents(batch, "text")):
            if key not in held:
                held[key] = h.copy()
                size += len(h)
            if size >= words:
                yield _chunk(held)
                held, size = {}, 0
    if held:
        yield _chunk(held)


def _chunk(held):
    keys = sorted(held)
    lengths = np.array([len(held[k]) for k in keys], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    return np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), first, np.concatenate([held[k] for k in keys])


def _suffixes(first: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Word positions at which a whole window begins."""
    inside = np.ones(max(0, len(h) - window + 1), bool)
    for start, end in zip(first[:-1], first[1:]):
        inside[max(start, end - window + 1) : end] = False
    return np.flatnonzero(inside)


def prefix_histogram(keyed: DataFrame, window: int) -> np.ndarray:
    """Suffixes by the scrambled hash of their first words; 2**PREFIX_BITS counts whatever the input."""

    def count(batches):
        total = np.zeros(1 << PREFIX_BITS, np.int64)
        for batch in batches:
            for h in documents(batch, "text"):
                if len(h) >= window:
                    heads = mix(grams(h, PREFIX)[: len(h) - window + 1]) >> np.uint64(64 - PREFIX_BITS)
                    total += np.bincount(heads.astype(np.int64), minlength=1 << PREFIX_BITS)
        (seen,) = total.nonzero()
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["prefix", "n"])

    out = np.zeros(1 << PREFIX_BITS, np.int64)
    for prefix, n in keyed.select("text").mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n")).collect():
        out[prefix] = n
    return out


def repeat_spans(keyed: DataFrame, window: int = WINDOW, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """id, text_hash and spans (pairs of int32: first word, word after the last) of what repeats an earlier place.

    keyed: id long, text_hash long, text string. Documents without such words have no row.
    """
    histogram = prefix_histogram(keyed, window)
    blocks = max(1, math.ceil(histogram.sum() / group))
    heavy = histogram > group // 8
    light = np.where(heavy, 0, histogram)
    block_of = (np.cumsum(light) - light) * blocks // max(1, light.sum())

    def route(batches):
        task = TaskContext.get().partitionId() << 32
        for number, (ids, texts, first, h) in enumerate(_chunks(batches, chunk)):
            at = _suffixes(first, h, window)
            whole = mix(grams(h, window))[at] if len(at) else np.zeros(0, np.uint64)
            order = np.argsort(whole, kind="stable")
            ordered = whole[order]
            earliest = np.ones(len(order), bool)
            earliest[1:] = ordered[1:] != ordered[:-1]
            repeats = np.sort(at[order[~earliest]]).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([{"block": blocks + ((task + number) & 0xFFFF), "chunk": task + number, "heads": None, "at": squeeze(repeats, True), "ids": squeeze(ids), "texts": squeeze(texts), "first": squeeze(first), "table": True}], ROUTED)
            order, ordered = order[earliest], ordered[earliest]
            where = at[order]
            prefix = (mix(grams(h, PREFIX)) >> np.uint64(64 - PREFIX_BITS))[where].astype(np.int64) if len(where) else where
            block = np.where(heavy[prefix], (mix(ordered) % np.uint64(blocks)).astype(np.int64), block_of[prefix])
            by_block = np.argsort(block, kind="stable")
            bounds = np.searchsorted(block[by_block], np.arange(blocks + 1))
            rows = []
            for b in np.flatnonzero(np.diff(bounds)):
                mine = by_block[bounds[b] : bounds[b + 1]]
                doc = np.unique(np.searchsorted(first, where[mine], side="right") - 1)
                rows.append({"block": int(b), "chunk": task + number, "heads": squeeze(ordered[mine], True), "at": squeeze(where[mine].astype(np.uint32)), "ids": squeeze(ids[doc]), "texts": squeeze(texts[doc]), "first": squeeze(first[doc]), "table": False})
                if len(rows) == 16:
                    yield pa.RecordBatch.from_pylist(rows, ROUTED)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ROUTED)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [r for r in rows if r["table"]]
        rows = [r for r in rows if not r["table"]]
        if rows:
            heads = np.concatenate([unsqueeze(r["heads"], np.uint64, True) for r in rows])
            sizes = [squeezed_length(r["at"]) for r in rows]
            bounds = np.cumsum([0, *sizes])
            order = np.argsort(heads, kind="stable")
            same = heads[order][1:] == heads[order][:-1]
            shared = np.zeros(len(order), bool)
            shared[1:] |= same
            shared[:-1] |= same
            picked = np.sort(order[shared])
            heads = heads[picked]
            keys = np.zeros((3, len(picked)), np.int64)  # id, text hash, position
            asked = np.zeros(len(picked), np.uint32)
            cuts = np.searchsorted(picked, bounds)
            for r, a, lo, hi in zip(rows, bounds, cuts[:-1], cuts[1:]):
                if hi > lo:
                    at = unsqueeze(r["at"], np.uint32)[picked[lo:hi] - a]
                    first = unsqueeze(r["first"], np.int64)
                    doc = np.searchsorted(first, at, side="right") - 1
                    keys[:, lo:hi] = unsqueeze(r["ids"], np.int64)[doc], unsqueeze(r["texts"], np.int64)[doc], at - first[doc]
                    asked[lo:hi] = at
            order = np.lexsort((keys[2], keys[1], keys[0], heads))
            heads, keys = heads[order], keys[:, order]
            begins = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else np.zeros(0, np.int64)
            earliest = np.repeat(begins, np.diff(np.append(begins, len(heads))))
            later = np.zeros(len(order), bool)
            later[order] = (keys != keys[:, earliest]).any(axis=0)
            for r, lo, hi in zip(rows, cuts[:-1], cuts[1:]):
                if later[lo:hi].any():
                    out.append({"block": r["block"], "chunk": r["chunk"], "at": squeeze(np.sort(asked[lo:hi][later[lo:hi]]), True), "table": False})
        return pa.Table.from_pylist(out, ROUTED)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["table"])
        first = unsqueeze(head["first"], np.int64)
        edges = np.zeros(first[-1] + 1, np.int32)
        for r in rows:
            at = unsqueeze(r["at"], np.uint32, True)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + np.uint32(window), -1)
        covered = np.cumsum(edges[:-1]) > 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
        lo, hi = change[::2], change[1::2]
        # no window crosses documents, but two neighbours' spans may touch
        cuts = first[1:-1][covered[first[1:-1] - 1] & covered[np.minimum(first[1:-1], len(covered) - 1)]] if len(covered) else first[:0]
        cuts = cuts[(cuts > 0) & (cuts < first[-1])]
        cuts = np.unique(cuts)
        lo, hi = np.union1d(lo, cuts), np.union1d(hi, cuts)
        doc = np.searchsorted(first, lo, side="right") - 1
        ids, texts = unsqueeze(head["ids"], np.int64), unsqueeze(head["texts"], np.int64)
        docs, begins = np.unique(doc, return_index=True)
        spans = (np.stack([lo, hi], 1) - first[doc][:, None]).astype(np.int32)
        parts = [p.tobytes() for p in np.split(spans, begins[1:])] if len(docs) else []
        return pa.table([pa.array(ids[docs]), pa.array(texts[docs]), pa.array(parts, pa.binary())], ["id", "text_hash", "spans"])

    routed = keyed.mapInArrow(route, ROUTED_KINDS)
    # about one group to a partition, so that what a task reads does not grow with the input
    met = routed.repartition(2 * blocks, "block").groupBy("block").applyInArrow(meet, ROUTED_KINDS)
    spans = met.groupBy("chunk").applyInArrow(gather, "id long, text_hash long, spans binary")
    return spans.groupBy("id", "text_hash").agg(F.first("spans").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one blank), removed (array of spans of words).

    A word goes if a window of consecutive words that covers it begins earlier too: in a
    smaller doc_id, or earlier in the same document. Windows are judged on the input. Null
    and empty texts have no words. Rows without an id come after all others. Rows that share
    an id are ordered by a hash of their texts; rows that repeat wholly are one document, and
    each gets that document's answer. An empty table gives no rows; other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    spans = repeat_spans(keyed.select("id", "text_hash", "text"), window, group, chunk)

    def keep(batches):
        for batch in batches:
            out = []
            for doc, text, raw in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                words = (text.as_py() or "").encode().split()
                cut = np.frombuffer(raw.as_py() or b"", np.int32).reshape(-1, 2).tolist()
                kept, at = [], 0
                for lo, hi in cut:
                    kept += words[at:lo]
                    at = hi
                kept = kept + words[at:] if cut else words
                out.append((doc.as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"first": a, "end": b} for a, b in cut]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, KEPT.types)], schema=KEPT)

    return keyed.join(spans, ["id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(keep, "doc_id long, n_words long, n_removed long, text string, removed array<struct<first:int,end:int>>")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep once windows of 20 words that begin earlier too are gone."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
