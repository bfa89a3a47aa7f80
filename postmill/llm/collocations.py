"""Phrase collocations per language, counted by weighted acyclic automata.

1. Tasks turn their documents into windows of up to four words, one from each word on, which
   end where their piece ends. The sorted windows of a few million words make an automaton
   whose states carry the counts of all phrases of one to four words.
2. Each is cut by prefix ranges (places in the order of word sequences, taken from a sample of
   the windows so that ranges are of a size; their number grows with the input) and sent to
   its ranges. A range unites what it gets and adds the counts. A prefix in many windows
   spans several ranges: the first and the last path of a range give all their states, and a
   sum by phrase completes them. What a range holds is bounded by its distinct windows.
3. Parts of candidates are looked up by composing, range by range, an automaton of the wanted
   parts with the automaton of the counts; containment and scores are joins on exact counts.

No word is hashed: labels are the words' bytes. Counts are whole at every size; the sample
moves range borders only.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.automata import DEPTH, END, Automaton
from postmill.session import checkpoint

LEAST = 30
SHARE = 80
TOP = 2000
#: Words of a shard's automaton, windows of a range, and the sample that places the ranges.
CHUNK = 2_000_000
RANGE = 1_000_000
SAMPLED_DOCS = 10_000
SAMPLED = 65_536
STRIDE = 64
STRETCH = 1 << 20
#: A-Z to a-z, tab to blank, what ends a piece to a line feed.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
SHARDS = "lang string, range int, words binary, arrays array<binary>"
SHARDS_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("words", pa.binary()), ("arrays", pa.list_(pa.binary()))])


class _Numbers(dict):
    """Words in the order of their first sight; 0 is the empty string between two blanks, 1 the end of a piece."""

    def __init__(self, words=()):
        super().__init__({b"": 0, b"\n": 1})
        for word in words:
            self[word]  # noqa: B018

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Windows:
    """The windows of a language's texts, kept until they are taken."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, text: bytes):
        """Adds a text; stops after each stretch of it, so that the windows can be taken in between."""
        data = text.translate(FOLD).replace(b"\n", b" \n ")
        at = 0
        while at < len(data):
            to = data.find(b" ", at + STRETCH)
            to = len(data) if to < 0 else to
            words = data[at:to].split(b" ")
            self._put(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
            at = to
            yield
        self._put(np.ones(1, np.uint32))

    def _put(self, ids: np.ndarray):
        ids = ids[ids != 0]
        self.parts.append(ids)
        self.size += len(ids)

    def take(self, last: bool) -> tuple[list[bytes], np.ndarray]:
        """(sorted words, windows as numbers of these); the last three words wait for what follows, unless nothing does."""
        ids = np.concatenate([*self.parts, np.ones(DEPTH - 1 if last else 0, np.uint32)]) if self.parts else np.ones(DEPTH - 1, np.uint32)
        known = list(self.numbers)
        order = sorted(range(2, len(known)), key=known.__getitem__)
        rank = np.zeros(len(known), np.uint32)
        rank[order] = np.arange(1, len(order) + 1)
        n = max(0, len(ids) - DEPTH + 1)
        columns = [rank[ids[:n]]]
        for d in range(1, DEPTH):
            column = rank[ids[d : n + d]]
            column[columns[-1] == 0] = 0
            columns.append(column)
        windows = np.stack(columns)[:, columns[0] != 0]
        tail = [known[i] for i in ids[n:]]
        self.__init__()
        self.numbers = _Numbers(tail)
        self._put(np.array([self.numbers[w] for w in tail], np.uint32))
        return [END, *(known[i] for i in order)], windows


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _texts(batches):
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if text.is_valid:
                yield lang, text.as_buffer().to_pybytes()


def range_cuts(rows: DataFrame, size: int) -> dict[str, list[tuple[bytes, ...]]]:
    """lang -> where its second, third, ... range begins; at most SAMPLED windows reach the driver."""
    total = rows.count()
    if not total:
        return {}
    share = min(1.0, SAMPLED_DOCS / total)

    def pick(batches):
        kept: dict[str, Windows] = {}
        out = []
        for lang, text in _texts(batches):
            own = kept.setdefault(lang, Windows())
            for _ in own.add(text):
                words, windows = own.take(False)
                out += [(lang, [words[i] for i in w]) for w in windows[:, len(out) % STRIDE :: STRIDE].T]
        yield pa.record_batch([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.list_(pa.binary()))], ["lang", "window"])

    picked = checkpoint(rows.sample(share, seed=11).mapInArrow(pick, "lang string, window array<binary>"))
    windows = picked.count() * STRIDE / share
    few = picked.orderBy(F.xxhash64("lang", F.array_join(F.transform("window", F.hex), " "))).limit(SAMPLED).collect()
    samples: dict[str, list] = {}
    for lang, window in few:
        samples.setdefault(lang, []).append(tuple(bytes(w) for w in window))
    step = max(1, int(len(few) / max(1.0, windows / size)))
    return {lang: sorted(set(sorted(found)[step::step])) for lang, found in samples.items()}


def shard_automata(rows: DataFrame, cuts: dict[str, list[tuple[bytes, ...]]], chunk: int = CHUNK) -> DataFrame:
    """lang, range, words, arrays: the automata of each task's documents, by prefix range."""

    def build(batches):
        held: dict[str, Windows] = {}

        def packed(last):
            for lang, own in held.items():
                for number, part in Automaton.of(*own.take(last)).ranges(cuts.get(lang, [])):
                    words, arrays = part.pack()
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "range": number, "words": words, "arrays": arrays}], SHARDS_ARROW)

        for lang, text in _texts(batches):
            for _ in held.setdefault(lang, Windows()).add(text):
                if sum(w.size for w in held.values()) >= chunk:
                    yield from packed(False)
        yield from packed(True)

    return rows.mapInArrow(build, SHARDS)


def phrase_counts(shards: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of every phrase of one to four words with f >= least; the empty phrase has the number of words."""

    def unite(table: pa.Table) -> pa.Table:
        parts = [Automaton.unpack(w.as_py(), a.as_py()) for w, a in zip(table.column("words"), table.column("arrays"))]
        whole = Automaton.union(parts)
        paths, phrases, counts = whole.paths(), [b""], [int(whole.weights.sum())]
        for d in range(DEPTH):
            weight = whole.state_weights(d)
            kept = (weight >= least) & (whole.labels[d] != 0)
            kept[[0, -1]] = whole.labels[d][[0, -1]] != 0
            for column, w in zip(paths[: d + 1, whole.firsts[d][kept]].T, weight[kept].tolist()):
                phrases.append(b" ".join([whole.words[i] for i in column]))
                counts.append(w)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "f": pa.array(counts, pa.int64())})

    found = shards.groupBy("lang", "range").applyInArrow(unite, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def look_up(counts: DataFrame, asked: DataFrame, cuts: dict[str, list[tuple[bytes, ...]]]) -> DataFrame:
    """lang, phrase, f of every distinct asked phrase, by composition within its prefix range."""

    def ranged(df):
        def number(batches):
            for batch in batches:
                out = []
                for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                    words = phrase.encode().split(b" ")
                    out.append(bisect_right(cuts.get(lang, []), (*words, *[END] * (DEPTH - len(words)))))
                yield batch.append_column("range", pa.array(out, pa.int32()))

        return df.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", range int").groupBy("lang", "range")

    def phrases(table):
        return table.column("phrase").cast(pa.binary()).to_pylist()

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = Automaton.of_phrases(phrases(right), np.ones(right.num_rows, np.int64))
        f = Automaton.of_phrases(phrases(left), left.column("f").to_numpy()).compose(wanted)
        names = [b" ".join([wanted.words[i] for i in column if i]) for column in wanted.paths().T]
        lang = right.column("lang")[0].as_py() if right.num_rows else None
        return pa.table({"lang": pa.array([lang] * len(names), pa.string()), "phrase": pa.array(names, pa.binary()).cast(pa.string()), "f": pa.array(f, pa.int64())})

    return ranged(counts.filter("phrase <> ''").select("lang", "phrase", "f")).cogroup(ranged(asked.select("lang", "phrase").distinct())).applyInArrow(compose, "lang string, phrase string, f long")


def mine_collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, chunk: int = CHUNK, size: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to four words of each language.

    Pieces end at . , ; : ! ? and line ends; words lie between blanks and tabs; A-Z count as
    a-z. Null texts are empty, a null lang is `und`; rows count as often as they are there; an
    empty table or one without frequent phrases gives no rows; other columns are not read.
    Scores are exact quotients in decimals: 2,000,000 a over l + r at the cut that gives the
    least, the first of equals. Phrases inside a longer candidate of `share` hundredths of
    their count or more are left out. Equal scores rank by a, then by the bytes of the phrase.
    """
    rows = _rows(docs)
    cuts = range_cuts(rows, size)
    counts = checkpoint(phrase_counts(shard_automata(rows, cuts, chunk), least))
    words = F.split("phrase", " ", -1)
    found = counts.filter(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))

    def part(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    cut = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    answers = checkpoint(look_up(counts, cut.select("lang", F.explode(F.array("head", "tail")).alias("phrase")), cuts))
    heads, tails = (answers.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("head", "l"), ("tail", "r")))
    # decimals: the product passes 64 bits where counts are large, and the quotient is whole
    exact = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", exact)
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    longest = found.filter(F.size("w") > 2).select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hundred = F.lit(100).cast("decimal(5,0)")
    kept = worst.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (hundred * F.col("longer").cast("decimal(20,0)") < F.lit(share).cast("decimal(5,0)") * F.col("a").cast("decimal(20,0)")))
    best = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    sizes = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "s.l", "s.r", "n", "s.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all documents."""
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
    FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
spans AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM starts),
f AS MATERIALIZED (
    SELECT lang, phrase, k, count(*) AS f
    FROM (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM spans)
    GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
    FROM cut c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_spans AS (
    SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM cand))),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_spans GROUP BY ALL),
kept AS (
    SELECT w.* FROM worst w LEFT JOIN longest g ON g.lang = w.lang AND g.phrase = w.phrase
    WHERE g.longer IS NULL OR CAST(100 AS HUGEINT) * g.longer < CAST(80 AS HUGEINT) * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN sizes s ON s.lang = k.lang
QUALIFY rank <= 2000
"""
