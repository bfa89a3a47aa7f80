"""Collapsing repeats: two-key greedy dedupe, final-address dedupe, near copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions import places, urls
from postmill.functions import text as tx
from postmill.plans.skew import mark_first
from postmill.session import checkpoint

SLOTS = 1 << 20  # counters of token frequencies
BITS = 1024  # of the sketch of a token set
SMALL = 300_000  # rows of a table of ids that is sent to every task
MEET = 256  # sets of a block
BUCKET = 1024  # sets of one bucket, or of a part of it, that are paired in one task
PAIRS = 4096  # candidates that a task checks at once, and those of its last pair of blocks


def posting_keys(postings: DataFrame) -> DataFrame:
    """Add ``canonical_url``, ``fingerprint`` and ``source_rank`` (0 for an employer's own board)."""
    return postings.withColumns(
        {
            "canonical_url": urls.canonicalize_url(F.col("url")),
            "fingerprint": places.duplicate_key(F.col("company_name"), F.col("title"), F.col("location")),
            "source_rank": F.when(F.col("source").isin(fixed.FIRST_PARTY_SOURCES), 0).otherwise(1),
        }
    )


def _first_two(pairs: DataFrame, key: str, side: str) -> DataFrame:
    """The two earliest ranks of each value of a key; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("_part", key).orderBy("_rank")
    top = pairs.select("_part", key, "_rank", F.row_number().over(order).alias("_n")).filter("_n <= 2")
    return top.groupBy("_part", key).agg(F.min("_rank").alias(f"_first_{side}"), F.max(F.when(F.col("_n") == 2, F.col("_rank"))).alias(f"_second_{side}"))


def _roots(forest: DataFrame) -> DataFrame:
    """Pointer doubling: _part, _rank, _root and whether an odd number of edges lies between.

    ``forest`` has one edge (_part, _rank, _root) per row that has one; a path of N edges
    takes log2(N) joins.
    """
    state = forest.withColumn("_odd", F.lit(True))
    while True:
        up = state.select("_part", F.col("_rank").alias("_root"), F.col("_root").alias("_up"), F.col("_odd").alias("_up_odd"))
        moved = F.col("_up").isNotNull()
        step = state.join(up, ["_part", "_root"], "left").select(
            "_part", "_rank", F.coalesce("_up", "_root").alias("_root"),
            (F.col("_odd") != F.coalesce("_up_odd", F.lit(False))).alias("_odd"), moved.alias("_moved"),
        )
        step = checkpoint(step)
        if step.filter("_moved").isEmpty():
            return state
        state = step.drop("_moved")


def dedupe_two_key(
    df: DataFrame,
    key_a: str,
    key_b: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Keep a row iff neither of its keys belongs to a row kept before it.

    Adds ``drop_reason``: NULL on kept rows, 'duplicate' on the others.
    ``order_by`` must be a total order (within ``partition_by``).

    This is the sequential greedy result, computed in parallel rounds. In a round a
    row that comes first under both its keys is kept. A row with one undecided
    earlier neighbour is kept iff that one is not: such rows form a forest, whose
    chains of any length are settled by pointer doubling. Then every row sharing a
    key with a kept one is dropped, and the rest, rows that wait for two or more,
    go to the next round. Rows with the same pair of keys are collapsed before the
    first round, so a large group of copies costs one row. A row without a key
    shares that key with no other row; a NULL in ``partition_by`` is a value.
    """
    part, given = list(partition_by), df.columns
    rank = F.struct(*[F.col(c) for c in order_by])
    alone = F.concat(F.lit("-"), F.to_json(rank))
    df = df.withColumns({f"_key_{k}": F.coalesce(F.concat(F.lit("+"), F.col(k).cast("string")), alone) for k in (key_a, key_b)})
    df = df.withColumn("_part", F.to_json(F.struct(*part)) if part else F.lit(""))
    key_a, key_b = f"_key_{key_a}", f"_key_{key_b}"
    open_pairs = checkpoint(df.groupBy("_part", key_a, key_b).agg(F.min(rank).alias("_rank")))
    node, kept_rounds = ["_part", "_rank"], []
    while not open_pairs.isEmpty():
        seen = open_pairs.join(_first_two(open_pairs, key_a, "a"), ["_part", key_a]).join(_first_two(open_pairs, key_b, "b"), ["_part", key_b])
        place = {s: F.when(F.col("_rank") == F.col(f"_first_{s}"), 0).when(F.col("_rank") == F.col(f"_second_{s}"), 1).otherwise(2) for s in "ab"}
        before = F.when(place["a"] == 1, F.col("_first_a")).when(place["b"] == 1, F.col("_first_b"))
        marked = checkpoint(seen.select(*node, key_a, key_b, (place["a"] + place["b"]).alias("_earlier"), before.alias("_root")))
        first, waiting = marked.filter("_earlier = 0"), marked.filter("_earlier = 1")
        rooted = _roots(waiting.select(*node, "_root")).filter("not _odd")
        settled = rooted.join(first.select("_part", F.col("_rank").alias("_root")), ["_part", "_root"], "left_semi")
        kept = first.unionByName(waiting.join(settled.select(*node), node, "left_semi")).select(*node, key_a, key_b)
        kept = checkpoint(kept)
        kept_rounds.append(kept)
        open_pairs = checkpoint(
            open_pairs.join(kept.select("_part", key_a), ["_part", key_a], "left_anti").join(
                kept.select("_part", key_b), ["_part", key_b], "left_anti"
            )
        )
    if not kept_rounds:
        return df.select(*given, F.lit(None).cast("string").alias("drop_reason"))
    winners = kept_rounds[0]
    for more in kept_rounds[1:]:
        winners = winners.unionByName(more)
    # a rank names one row, so the keys of all rows need not be formed and moved again
    winners = winners.select(*node, F.lit(True).alias("_kept"))
    marked = df.withColumn("_rank", rank).join(winners, node, "left")
    reason = F.when(F.col("_kept"), F.lit(None).cast("string")).otherwise(F.lit("duplicate"))
    return marked.select(*given, reason.alias("drop_reason"))


def dedupe_final_url(validated: DataFrame, partition_by: Sequence[str] = ("query_id",)) -> DataFrame:
    """First posting per final address, best score first; adds ``drop_reason``.

    A withheld posting still claims its address: the address is settled before
    the status is looked at. Reasons: 'duplicate', then 'rejected'.
    """
    final = urls.canonicalize_url(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("canonical_url")))
    keyed = validated.withColumns({"final_key": final, "_worse": -F.col("score")})
    flagged = mark_first(keyed, [*partition_by, "final_key"], ["_worse", "ord"], "_first").drop("_worse")
    reason = F.when(~F.col("_first"), F.lit("duplicate")).when(
        ~F.col("status").isin(fixed.DISPLAYABLE_STATUSES), F.lit("rejected")
    )
    return flagged.withColumn("drop_reason", reason).drop("_first")


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table of ids, sent to every task where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _token_sets(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(distinct token sets: id, toks; pairs of each further row of a set with its smallest id).

    Tokens are 64-bit hashes. Rows with one and the same set cost one row each and take
    no part in what follows. Only ids and digests of sets are shuffled, never the sets.
    """
    sets = df.select(F.col(id_col).alias("id"), F.sort_array(F.transform(tx.token_set(F.col(text)), lambda t: F.xxhash64(t))).alias("toks")).filter(
        (F.size("toks") > 0) & F.col("id").isNotNull()
    )
    sets = checkpoint(sets.withColumn("set_key", F.unhex(F.sha2(F.to_json("toks"), 256))))
    first = sets.groupBy("set_key").agg(F.min("id").alias("id_a"))
    copies = checkpoint(sets.select("set_key", F.col("id").alias("id_b")).join(first, "set_key").filter("id_b <> id_a"))
    groups = sets.join(_small(copies.select(F.col("id_b").alias("id"), "set_key")), ["id", "set_key"], "left_anti")
    return groups, copies.select("id_a", "id_b", F.lit(1.0).alias("jaccard"))


def _sketches(groups: DataFrame) -> DataFrame:
    """id, n and ``bits``: for each of ``BITS`` bits whether an odd number of the set's tokens falls on it."""
    kind = groups.schema["id"].dataType.simpleString()

    def sketched(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists = batch.column("toks")
                sizes = pc.list_value_length(lists).to_numpy()
                cell = np.repeat(np.arange(len(sizes)) * BITS, sizes) + ((lists.flatten().to_numpy() >> 32) % BITS)
                odd = np.packbits((np.bincount(cell, minlength=len(sizes) * BITS) & 1).astype(np.uint8)).view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (BITS // 64)), pa.array(odd))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes.astype(np.int32)), bits], ["id", "n", "bits"])

    return groups.select("id", "toks").mapInArrow(sketched, f"id {kind}, n int, bits array<bigint>")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()


def _placed(candidates: DataFrame) -> DataFrame:
    """Candidates with ``meet``, the pair of blocks that their ids are in, and ``task``, where such pairs are checked.

    Ids go by their smallest candidate partner, which the members of a cluster share, so a
    block holds some ``MEET`` sets of one cluster or several small clusters.
    """
    both = candidates.unionByName(candidates.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    led = checkpoint(both.groupBy(F.col("id_a").alias("id")).agg(F.least(F.min("id_b"), F.first("id_a")).alias("lead")))
    wide = led.groupBy("lead").agg(F.count("*").alias("sets")).filter(F.col("sets") > MEET)
    shared = max(1, led.count() // MEET)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("sets") / MEET))
    block = F.when(F.col("sets").isNull(), F.pmod(F.xxhash64("lead"), F.lit(shared))).otherwise(F.xxhash64("lead", part))
    blocks = _small(checkpoint(led.join(wide, "lead", "left").select("id", block.alias("block"))))
    side = {s: blocks.select(F.col("id").alias(f"id_{s}"), F.col("block").alias(f"block_{s}")) for s in "ab"}
    tasks = max(1, candidates.count() // PAIRS)
    meet = F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    met = candidates.join(side["a"], "id_a").join(side["b"], "id_b").select("id_a", "id_b", meet.alias("meet"))
    return met.withColumn("task", F.pmod(F.xxhash64("meet"), F.lit(tasks)).cast("int"))


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens shared by sets ``a[i]`` and ``b[i]``: by a product of all sets where their pairs are many, else pair by pair."""
    if len(a) < 4 * len(sets) or len(sets) > 4 * MEET:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, width = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = width > 1
    place = np.cumsum(common) - 1
    row, column = row[common[column]], place[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(common.sum()), 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[row[lo:hi], column[lo:hi] - start] = 1
        shared += has @ has.T
    return shared[a, b].astype(np.int64)


def _together(pairs: DataFrame, sets: DataFrame, check, schema: str) -> DataFrame:
    """Each task's pairs with its sets, a set once however many of the task's pairs ask for it.

    ``check`` has (pairs, sets, place of each pair's first set, of its second) as Arrow tables
    and arrays, and gives a table.
    """
    asked = pairs.select(F.col("task").alias("at"), F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    brought = asked.join(sets, "id")

    def checked(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        place = pa.table([theirs.column("id"), pa.array(np.arange(len(theirs)))], ["id", "at"])
        for s in "ab":  # an id that names several sets stands for each of them
            mine = mine.join(place.rename_columns([f"id_{s}", f"at_{s}"]), f"id_{s}", join_type="inner")
        mine = mine.sort_by("meet").combine_chunks()
        out = check(mine, theirs.combine_chunks(), mine.column("at_a").to_numpy(), mine.column("at_b").to_numpy())
        once = pc.count_distinct(place.column("id")).as_py() == len(place)
        return out if once else out.group_by(out.column_names).aggregate([])

    return pairs.groupBy("task").cogroup(brought.groupBy("at")).applyInArrow(checked, schema)


def _checked(candidates: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Candidates (id_a, id_b) with their exact Jaccard, where it is high enough.

    Two sets differ by as many tokens at least as their sketches differ by bits; only pairs
    that this leaves in doubt bring their sets together. Candidates are checked by pairs of
    blocks of sets, so a set moves once for each block that it meets and not for each pair.
    """
    kind = groups.schema["id"].dataType.simpleString()
    pairs = _placed(checkpoint(candidates))

    def close(mine, theirs, a, b):
        bits = theirs.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        n, keep = theirs.column("n").to_numpy(), []
        for start in range(0, len(a), 65536):
            i, j = a[start : start + 65536], b[start : start + 65536]
            both = n[i].astype(np.int64) + n[j]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            keep.append((both - apart) / 2 >= threshold / (1 + threshold) * both - 1e-6)
        return mine.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep]))).select(["id_a", "id_b"])

    def near(mine, theirs, a, b):
        lists = theirs.column("toks").combine_chunks()
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        toks, shared = lists.flatten().to_numpy(), [np.zeros(0, np.int64)]
        firsts = np.flatnonzero(np.append(True, np.diff(meet := mine.column("meet").to_numpy()) != 0)[: len(meet)])
        for lo, hi in zip(firsts, np.append(firsts[1:], len(meet))):
            used, place = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
            shared.append(_overlaps([toks[ends[k] : ends[k + 1]] for k in used], place[: hi - lo], place[hi - lo :]))
        n, both = np.diff(ends), np.concatenate(shared)
        ratio = both / np.maximum(n[a] + n[b] - both, 1)
        out = pa.table([mine.column("id_a"), mine.column("id_b"), pa.array(ratio)], ["id_a", "id_b", "jaccard"])
        return out.filter(pa.array(ratio >= threshold))

    ids = _small(checkpoint(_named(pairs)))
    sketches = _sketches(groups.join(ids, "id", "left_semi"))
    # fewer pairs, so other clusters and blocks
    doubtful = checkpoint(_together(pairs, sketches, close, f"id_a {kind}, id_b {kind}"))
    ids = _small(checkpoint(_named(doubtful)))
    return _together(_placed(doubtful), groups.join(ids, "id", "left_semi").select("id", "toks"), near, f"id_a {kind}, id_b {kind}, jaccard double")


def _rarity(groups: DataFrame) -> np.ndarray:
    """How many tokens of all sets fall into each of ``SLOTS`` slots: never less than a token's own frequency."""
    slots = groups.select(F.explode("toks").alias("tok")).select(F.pmod("tok", F.lit(SLOTS)).alias("slot"))
    told = slots.groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[told["slot"].to_numpy()] = told["n"].to_numpy()
    return counts


def _prefixes(groups: DataFrame, least_shared: float, rarity) -> DataFrame:
    """id, n, at, tok and ``freq``: the rarest tokens of each set that some partner must share.

    A partner shares ``least_shared`` of the set at least. The order of tokens is that of their
    slots' counts (then of the tokens), the same for all sets; ``at`` is the place in it. Tokens
    alone in their slot have no partner and are left out.
    """
    kind = groups.schema["id"].dataType.simpleString()

    def ranked(batches):
        counts = rarity.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists = batch.column("toks")
                toks, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((toks, freq := counts[toks % SLOTS], row))
                at = np.arange(len(toks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = sizes - np.ceil(sizes * least_shared - 1e-9).astype(np.int64) + 1
                taken = (at < keep[row]) & (freq[order] > 1)
                place, chosen = row[taken], order[taken]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(place)), *map(pa.array, (sizes[place].astype(np.int32), at[taken].astype(np.int32), toks[chosen], freq[chosen]))],
                    ["id", "n", "at", "tok", "freq"],
                )

    return groups.select("id", "toks").mapInArrow(ranked, f"id {kind}, n int, at int, tok long, freq long")


def near_duplicate_pairs(df: DataFrame, id_col: str, text: str, threshold: float = 0.8, hot: int = 2000) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose token sets have a Jaccard of at least ``threshold``.

    Exact, by prefix filtering. Of two sets this similar the smaller one (by size, then id)
    shares ``2 * threshold / (1 + threshold)`` of its tokens at least and the larger one
    ``threshold``, so they meet under one of the rarest tokens that remain of each: the
    smaller set's are posted, the larger one's look them up. Both are kept by bands of sizes,
    so that only sets of like size meet; a posting list of more than ``hot`` sets is dealt
    over as many tasks as it has such parts. The places of the first token that a pair shares
    must leave room for the overlap that their sizes ask for. Rarity is read from a fixed
    number of counters, so no token is shuffled but those of prefixes. Rows with one and the
    same token set are first collapsed to their smallest id; each copy is paired with that id
    once (Jaccard 1), so a large group of copies costs one row per copy.
    """
    groups, copies = _token_sets(df, id_col, text)
    rarity = df.sparkSession.sparkContext.broadcast(_rarity(groups))
    posted, asked = (_prefixes(groups, share, rarity) for share in (2 * threshold / (1 + threshold), threshold))
    # sizes of one band are within the threshold of each other, so a larger partner is in its partner's band or the next
    steps = F.log(F.col("n")) / F.lit(-math.log(threshold))
    posted = posted.withColumn("home", F.explode(F.sequence(F.floor(steps + 1e-9), F.floor(steps + 1 + 1e-6))))
    asked = asked.withColumn("home", F.floor(steps + 1e-9))
    # a list is no longer than its token's slot
    lists = posted.filter(F.col("freq") > hot).groupBy("tok", "home").agg(F.count("*").alias("sets")).filter(F.col("sets") > hot)
    lists = _small(checkpoint(lists.select("tok", "home", F.ceil(F.col("sets") / F.lit(hot)).cast("int").alias("parts"))))
    parts = F.coalesce("parts", F.lit(1))
    # what travels is one number for token, band and part: sets that meet under it by chance are compared like any others
    a = posted.join(lists, ["tok", "home"], "left").select(
        F.xxhash64("tok", "home", F.pmod(F.xxhash64("id"), parts).cast("int")).alias("key"), F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a")
    )
    b = asked.join(lists, ["tok", "home"], "left").select(
        "tok", "home", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")
    )
    b = b.select(F.xxhash64("tok", "home", "part").alias("key"), "id_b", "n_b", "at_b")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    near_size = F.col("n_a") >= F.col("n_b") * threshold - F.lit(1e-6)
    # the first token a pair shares leaves this much for the overlap, and its sizes need that much
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-6)
    met = a.join(b, "key").filter(smaller & (F.col("id_a") != F.col("id_b")) & near_size & (room >= needed))
    candidates = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    return _checked(candidates, groups, threshold).unionByName(copies)


def minhash_bands(groups: DataFrame, bands: int, rows: int) -> DataFrame:
    """id and ``keys``: for each band the hash of its ``rows`` min-hashes of the set's tokens.

    The minima combine before the shuffle, so a set of any size costs one row of numbers a task.
    """
    tokens = groups.select("id", F.explode("toks").alias("tok"))
    minima = [F.min(F.xxhash64("tok", F.lit(i))).alias(f"m{i}") for i in range(bands * rows)]
    signed = tokens.groupBy("id").agg(*minima)
    return signed.select("id", F.array(*[F.xxhash64(*[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)]).alias("keys"))


def _bucket_pairs(signed: DataFrame) -> DataFrame:
    """id_a, id_b: every two sets that share a bucket of some band, once.

    A bucket of more than ``BUCKET`` sets is dealt into parts, and two parts meet in a task; a pair
    that shares an earlier band is left to that one.
    """
    kind = signed.schema["id"].dataType.simpleString()
    levels = signed.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = checkpoint(levels.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1"))
    small = levels.join(sizes.filter(F.col("members") <= BUCKET), ["band", "key"]).groupBy("band", "key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = small.select("ids", F.posexplode("ids").alias("at", "id_a")).select("id_a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("id_b"))

    parts = F.ceil(F.col("members") / BUCKET).cast("int")
    large = levels.join(sizes.filter(F.col("members") > BUCKET), ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    large = large.select("id", "band", "key", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).join(signed, "id")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, part = (table.column(c).to_numpy() for c in ("id", "part"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        band, low = table.column("band")[0].as_py(), pc.min(pc.min_element_wise(table.column("part"), table.column("other"))).as_py()
        mine = np.flatnonzero(part == low)
        theirs = np.flatnonzero(part != low) if (part != low).any() else mine
        earlier = np.zeros((len(mine), len(theirs)), bool)
        for b in range(band):
            earlier |= keys[mine, b][:, None] == keys[theirs, b]
        i, j = np.nonzero(~earlier)
        x, y = ids[mine[i]], ids[theirs[j]]
        once = x < y if theirs is mine else np.ones(len(x), bool)
        return pa.table([pa.array(np.minimum(x, y)[once]), pa.array(np.maximum(x, y)[once])], ["id_a", "id_b"])

    met = large.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    met = met.groupBy("band", "key", "i", "j").applyInArrow(meet, f"id_a {kind}, id_b {kind}")
    return pairs.unionByName(met).distinct()


def near_duplicates_minhash(
    df: DataFrame, id_col: str, text: str, threshold: float = 0.8, bands: int = 20, rows: int = 4, full: int | None = None
) -> DataFrame:
    """Links (id_a < id_b, jaccard) between rows with near token sets, by banded min-hash signatures.

    Approximate: a pair of Jaccard s shares a band with probability 1 - (1 - s^rows)^bands
    (0.9999 at 0.8 with the defaults); every link given is checked exactly. All members of a
    bucket are compared with each other, whatever its size. Copies of one set are linked with
    its smallest id.

    With ``full``, a bucket of more sets than that is split by the keys of its members' next
    band, and what is still too large by the band after that; in addition each of its members
    is compared with its smallest. Clusters of near copies then come out as stars, and links
    between their other members are left out.
    """
    groups, copies = _token_sets(df, id_col, text)
    signed = checkpoint(minhash_bands(groups, bands, rows))
    candidates = _bucket_pairs(signed) if full is None else _bucket_stars(signed, bands, full)
    return _checked(candidates, groups, threshold).unionByName(copies)


def _bucket_stars(signed: DataFrame, bands: int, full: int) -> DataFrame:
    """id_a, id_b of sets that share a bucket, at most ``full`` for each set and bucket."""

    def key(extra: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda b: F.struct(b.alias("band"), F.xxhash64(*[F.get("keys", F.pmod(b + F.lit(i), F.lit(bands))) for i in range(extra + 1)]).alias("key")),
        )

    # the bucket of each band at three depths, split only where the one before was too large
    levels = signed.select("id", F.explode(F.arrays_zip(key(0).alias("x"), key(1).alias("y"), key(2).alias("z"))).alias("k"))
    levels = levels.select("id", "k.x.band", F.col("k.x.key").alias("k0"), F.col("k.y.key").alias("k1"), F.col("k.z.key").alias("k2"))
    links, open_rows = [], levels
    for depth in range(3):
        name = f"k{depth}"
        sizes = open_rows.groupBy("band", name).agg(F.count("*").alias("members"), F.min("id").alias("least")).filter("members > 1")
        bucketed = open_rows.join(sizes, ["band", name])
        links.append(bucketed.filter((F.col("members") > full) & (F.col("id") != F.col("least"))).select(F.col("least").alias("id_a"), F.col("id").alias("id_b")))
        small = bucketed.filter(F.col("members") <= full).groupBy("band", name).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        pairs = small.select("ids", F.posexplode("ids").alias("at", "id_a")).select("id_a", F.explode(F.slice("ids", F.col("at") + 2, F.lit(full))).alias("id_b"))
        links.append(pairs)
        open_rows = bucketed.filter(F.col("members") > full).select(*levels.columns)
    candidates = links[0]
    for more in links[1:]:
        candidates = candidates.unionByName(more)
    return candidates.distinct()
