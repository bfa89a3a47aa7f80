"""Links between documents whose 5-word shingles overlap, and their components.

The overlaps are the product of the sparse document by shingle incidence with its
transpose, taken in blocks. Equal sets are one row of the matrix. Size-derived bounds
discard pairs three times. First over blocks of columns: of n shingles of a linked set at
most n - ceil(0.75 n) are not shared, so a set with more unshared ones among the columns
counted links with nothing. Then the other sets post their rarest columns, as many as that
bound asks for, and neighbours in size of a posting list whose sizes allow a link form
candidate clusters; that takes one edge per posting and never the pairs of a group. Last,
within a cluster, one block of rows is multiplied by another: overlap counts accumulate over
all shared shingles, pairs below the overlap their sizes ask for are dropped, and a spanning
forest of the links remains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.arrays import roots, squeeze, unsqueeze
from postmill.llm.graph import connected
from postmill.llm.words import documents, grams, mix
from postmill.session import checkpoint

SHINGLE = 5
PERCENT = 75
#: Shingles with smaller hashes are the counted columns, for all but small sets.
LOW = np.uint64(int(0.45 * 2**64))
#: A set that counts low columns only has so many in common with each set it links with.
SPARE = 4
CHUNK = 3 << 20
POSTINGS = 1 << 20
ROWS = 512
DENSE = 48


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of a document's word hashes; fewer words than k make one."""
    return np.unique(mix(grams(h, min(k, len(h))))) if len(h) else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    return int(np.add.reduce(mix(s + np.uint64(len(s)))).astype(np.int64)) if len(s) else 0


def _gathered(batches: Iterator[pa.RecordBatch], k: int, size: int):
    """Distinct non-empty sets of about so many shingles together, as {fingerprint: set}."""
    held, total = {}, 0
    for batch in batches:
        for h in documents(batch, "text", fold_case=True):
            s = shingles(h, k)
            if len(s) and (key := set_id(s)) not in held:
                held[key] = s
                total += len(s)
            if total >= size:
                yield held
                held, total = {}, 0
    if held:
        yield held


def sampled(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(columns of a sorted set that are counted, twice the number of low ones plus 1 if all are counted).

    The columns are those of low hashes. At most n - ceil(percent n / 100) shingles of a linked
    set are not the other's; where the low hashes are too few for that to say much, all count.
    """
    unshared = len(s) - (percent * len(s) + 99) // 100
    low = s[: np.searchsorted(s, LOW)]
    return (low, 2 * len(low)) if len(low) >= unshared + SPARE else (s, 2 * len(low) + 1)


SINGLES = "block long, chunk long, tokens binary, counts binary, owners binary, table boolean, nodes binary, sizes binary, counted binary, many binary, of binary"


def shared_columns(texts: DataFrame, k: int, percent: int, blocks: int) -> DataFrame:
    """Per chunk of sets its counted columns that other sets have too, with the number of chunk-wise sets that have them.

    One row per chunk has the sets (nodes, sizes) and the columns that several of them share
    (many, of); the other rows answer its columns: tokens, counts, owners.
    """
    def ask(batches):
        task = TaskContext.get().partitionId() << 32
        for number, held in enumerate(_gathered(batches, k, CHUNK)):
            sets, counted = zip(*(sampled(s, percent) for s in held.values()))
            token = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            n = np.diff(np.append(begins, len(token)))
            several = np.repeat(n > 1, n)
            chunk = task + number
            sizes = np.array([len(s) for s in held.values()], np.int64)
            table = {"nodes": squeeze(np.array(list(held), np.int64)), "sizes": squeeze(sizes), "counted": squeeze(np.array(counted, np.int64))}
            yield _row(SINGLES, block=blocks + (chunk & 0xFFFF), chunk=chunk, table=True, many=squeeze(token[several], True), of=squeeze(owner[several]), **table)
            token, owner = token[begins], owner[begins]
            for b, mine in _by_block(token, blocks):
                yield _row(SINGLES, block=b, chunk=chunk, table=False, tokens=squeeze(token[mine], True), counts=squeeze(n[mine]), owners=squeeze(owner[mine]))

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [_row(SINGLES, **r) for r in rows if r["table"]]
        rows = [r for r in rows if not r["table"]]
        if rows:
            parts = [unsqueeze(r["tokens"], np.uint64, True) for r in rows]
            token = np.concatenate(parts)
            n = np.concatenate([unsqueeze(r["counts"], np.int64) for r in rows])
            _, inverse = np.unique(token, return_inverse=True)
            total = np.bincount(inverse, n).astype(np.int64)[inverse]
            bounds = np.cumsum([0, *map(len, parts)])
            for r, part, lo, hi in zip(rows, parts, bounds[:-1], bounds[1:]):
                if (shared := total[lo:hi] > 1).any():
                    owners = unsqueeze(r["owners"], np.int64)
                    out.append(_row(SINGLES, block=r["block"], chunk=r["chunk"], table=False, tokens=squeeze(part[shared], True), counts=squeeze(total[lo:hi][shared]), owners=squeeze(owners[shared])))
        return pa.Table.from_batches(out)

    # about one block to a partition, so that what a task reads does not grow with the input
    return texts.mapInArrow(ask, SINGLES).repartition(2 * blocks, "block").groupBy("block").applyInArrow(answer, SINGLES)


def _row(kinds: str, **values) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in kinds.split(", ")]
    return pa.record_batch([pa.array([values.get(name)], types[kind]) for name, kind in fields], [name for name, _ in fields])


def _by_block(token: np.ndarray, blocks: int):
    """(block, slice) of the blocks of equal ranges that sorted columns fall into."""
    bounds = np.searchsorted(token, np.arange(1, blocks, dtype=np.uint64) * np.uint64((2**64 - 1) // blocks)) if blocks > 1 else []
    bounds = [0, *bounds, len(token)]
    return [(b, slice(lo, hi)) for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])) if hi > lo]


def _chain(token: np.ndarray, node: np.ndarray, size: np.ndarray, percent: int):
    """(ids, root of each) by the edges between neighbours in size of each posting list."""
    linked = np.flatnonzero((token[1:] == token[:-1]) & (node[1:] != node[:-1]) & (100 * size[:-1] >= percent * size[1:]))
    ids, place = np.unique(node, return_inverse=True)
    return ids, roots(len(ids), place[linked], place[linked + 1])


POSTED = "block long, tokens binary, nodes binary, sizes binary, ids binary, roots binary"


def candidate_edges(texts: DataFrame, k: int, percent: int, blocks: int) -> DataFrame:
    """a, b: fingerprints of sets in one candidate cluster, as forests.

    A set of which too few counted columns are shared at all links with nothing and is out.
    The others post the columns among which a linked set must have one in common: the first
    unshared + 1 of their counted columns, rarest first. A set that counts all columns meets
    one that counts the low ones by its shared low columns but the SPARE - 1 last, whether or
    not its other columns are shared. Neighbours in size of a posting list
    are joined where their sizes allow a link; any pair of the list that does lies on such a
    chain. A chunk joins its own sets and posts one set of each size.
    """

    def post(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["table"])
        nodes, sizes, counted = (unsqueeze(head[c], np.int64) for c in ("nodes", "sizes", "counted"))
        many, of = unsqueeze(head["many"], np.uint64, True), unsqueeze(head["of"], np.int64)
        rows = [r for r in rows if not r["table"]]
        token = np.concatenate([many[:0], *(unsqueeze(r["tokens"], np.uint64, True) for r in rows)])
        count, owner = (np.concatenate([of[:0], *(unsqueeze(r[c], np.int64) for r in rows)]) for c in ("counts", "owners"))
        order = np.argsort(token)
        token, count, owner = token[order], count[order], owner[order]
        # a column that several sets of this chunk have is answered once
        single = ~np.isin(token, many)
        frequency = count[np.searchsorted(token, many)] if len(many) else of[:0]
        token, count, owner = np.concatenate([token[single], many]), np.concatenate([count[single], frequency]), np.concatenate([owner[single], of])
        order = np.lexsort((token, count, owner))
        token, owner = token[order], owner[order]
        at = np.searchsorted(owner, np.arange(len(nodes) + 1))
        posted, by = [many[:0]], [of[:0]]
        for i in np.flatnonzero(np.diff(at)):
            mine, unshared = token[at[i] : at[i + 1]], int(sizes[i]) - (percent * int(sizes[i]) + 99) // 100
            low, all_columns = int(counted[i]) >> 1, counted[i] & 1
            columns = int(sizes[i]) if all_columns else low
            # what a set that counts low columns only has in common with this one shows among the low ones alone
            parts = [own[: len(own) - SPARE + 1] for own in [mine[mine < LOW]] if all_columns and len(own) >= SPARE]
            if len(mine) >= columns - unshared:
                parts.append(mine[: unshared + 1 - (columns - len(mine))])
            if not parts:
                continue
            mine = np.unique(np.concatenate(parts))
            posted.append(mine)
            by.append(np.full(len(mine), i))
        token, owner = np.concatenate(posted), np.concatenate(by)
        order = np.lexsort((nodes[owner], sizes[owner], token))
        token, owner = token[order], owner[order]
        ids, root = _chain(token, nodes[owner], sizes[owner], percent)
        out = [_row(POSTED, block=int(head["chunk"]) % blocks, ids=squeeze(ids), roots=squeeze(ids[root]))]
        first = np.append(True, (token[1:] != token[:-1]) | (np.diff(sizes[owner]) != 0))[: len(token)]
        token, owner = token[first], owner[first]
        for b, mine in _by_block(token, blocks):
            out.append(_row(POSTED, block=b, tokens=squeeze(token[mine], True), nodes=squeeze(nodes[owner[mine]]), sizes=squeeze(sizes[owner[mine]])))
        return pa.Table.from_batches(out)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        edges = [(unsqueeze(r["ids"], np.int64), unsqueeze(r["roots"], np.int64)) for r in rows if r["ids"]]
        rows = [r for r in rows if r["tokens"]]
        if rows:
            token = np.concatenate([unsqueeze(r["tokens"], np.uint64, True) for r in rows])
            node, size = (np.concatenate([unsqueeze(r[c], np.int64) for r in rows]) for c in ("nodes", "sizes"))
            order = np.lexsort((node, size, token))
            ids, root = _chain(token[order], node[order], size[order], percent)
            edges.append((ids, ids[root]))
        a, b = (np.concatenate([e[i] for e in edges]) for i in range(2))
        return pa.table([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    answered = shared_columns(texts, k, percent, blocks)
    return answered.groupBy("chunk").applyInArrow(post, POSTED).groupBy("block").applyInArrow(meet, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs: columns in few rows pair by pair, the others as a dense product."""
    m = len(sets)
    column = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    begins = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    width = np.diff(np.append(begins, len(column)))
    out = np.zeros(m * m, np.int32)
    few = np.repeat((width > 1) & (width <= DENSE), width)
    c, r = column[few], row[few]
    for step in range(1, DENSE):
        same = c[step:] == c[:-step]
        if not same.any():
            break
        out += np.bincount(r[:-step][same] * m + r[step:][same], minlength=m * m).astype(np.int32)
    out = out.reshape(m, m)
    wide = np.flatnonzero(width > DENSE)
    for at in range(0, len(wide), 2048):
        part = np.zeros((m, min(2048, len(wide) - at)), np.float32)
        for j, w in enumerate(wide[at : at + 2048]):
            part[row[begins[w] : begins[w] + width[w]], j] = 1
        out += (part @ part.T).astype(np.int32)
    return out


def link_forest(candidates: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links. candidates: bucket, i, j, node, shingles."""

    def product(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        packed = table.column("shingles")
        sets = [unsqueeze(packed[int(k)].as_py(), np.uint64, True) for k in first]
        n = np.array([len(s) for s in sets], np.int64)
        both = overlaps(sets).astype(np.int64)
        possible = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
        a, b = np.nonzero(np.triu(possible & ((100 + percent) * both >= percent * np.add.outer(n, n)), 1))
        root = roots(len(nodes), a, b)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    return candidates.groupBy("bucket", "i", "j").applyInArrow(product, "a long, b long")


def _placed(docs: DataFrame, k: int, percent: int, rows: int, postings: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and root (null without words) of every row of docs; linked rows share a root."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def sign(batches):
        for batch in batches:
            sets = [shingles(h, k) for h in documents(batch, "text", fold_case=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], ["doc_id", "text_hash", "n_shingles", "node"])

    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = checkpoint(hashed.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, node long"))
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    clusters = connected(candidate_edges(texts.select("text"), k, percent, max(1, math.ceil(total / 2 / postings))))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"))
    # a set is spelled from its row with the smallest id; one whose rows have no ids, by the hash of a text
    owners = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    wanted = clusters.join(sizes, "root").join(owners, "node").select("doc_id", "text_hash", "node", "root", "m")

    def spell(batches):
        for batch in batches:
            for i, h in enumerate(documents(batch, "text", fold_case=True)):
                s = shingles(h, k)
                if set_id(s) == batch.column("node")[i].as_py():
                    yield pa.record_batch([*(batch.column(c).slice(i, 1) for c in ("node", "root", "m")), pa.array([squeeze(s, True)])], ["node", "root", "m", "shingles"])

    kept = ("text", "node", "root", "m")
    with_id = texts.filter("doc_id is not null").join(wanted.drop("text_hash"), "doc_id").select(*kept)
    without = hashed.filter("doc_id is null").join(wanted.filter("doc_id is null").drop("doc_id"), "text_hash")
    without = without.groupBy("node", "root", "m").agg(F.min("text").alias("text")).select(*kept)
    spelled = with_id.unionByName(without).mapInArrow(spell, "node long, root long, m long, shingles binary")
    # small clusters go together, a large one as pairs of blocks of rows
    blocks = F.ceil(F.col("m") / rows)
    salt = F.pmod(F.xxhash64("node"), blocks)
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda t: (t != salt) | (blocks == 1))).alias("other")
    total = F.pmod(F.xxhash64("root"), F.lit(max(1, math.ceil(clusters.count() / rows))).cast("long"))
    paired = spelled.select("node", "shingles", F.when(blocks == 1, total).otherwise(-1 - F.abs("root")).alias("bucket"), salt.alias("s"), other)
    forest = link_forest(paired.select("bucket", F.least("s", "other").alias("i"), F.greatest("s", "other").alias("j"), "node", "shingles"), percent)
    components = connected(forest)
    return signed.join(components, "node", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("root"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, postings: int = POSTINGS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs.

    Two documents link when 100 * shared >= percent * united distinct shingles of k words
    (A-Z lower-cased). Texts with fewer words are one shingle; null, empty and blank texts
    are linked with nothing and are their own component. Equal sets are linked, so repeated
    rows and ties share a component. A row without an id takes part; its component_id is the
    smallest id there is, or null. An empty table gives no rows; other columns are not read.
    """
    placed = _placed(docs, k, percent, rows, postings)
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but of each component only the row of the smallest doc_id, then text hash.

    Rows without an id come last. Rows of one id whose texts do not link all stay. Texts
    without words link with nothing; of those that share an id and the text one stays.
    """
    placed = _placed(docs, SHINGLE, PERCENT, ROWS, POSTINGS).filter("root is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = placed.groupBy("root").agg(F.min(place).alias("first"))
    copies = placed.join(first, "root").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash").distinct()
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    left = keyed.join(copies.toDF("__a", "__b"), F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__text") == F.col("__b")), "left_anti")
    alone = F.col("__id").isNull() & ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \x09-\x0D]")
    return left.filter(~alone).dropDuplicates(["__id", "__text"]).unionByName(left.filter(alone)).select(docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by five-word shingles at a similarity of 0.75."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
