"""Language of a text by sparse multinomial logistic regression on character n-grams.

Features. A text is lower-cased; letters and their marks stay, everything between them is one
blank. Its runs of one to three characters (a blank only at an end) are counted in 2**BITS
hashed buckets; a bucket's value is (1 + ln count) times its inverse document frequency, and
the values of a text have length one.

Learning. Follow-the-regularised-leader, coordinate by coordinate, with an elastic net: the
first penalty leaves most weights exactly zero. At most SAMPLE documents, spread evenly over
at most LANGS languages (the most frequent ones), are learned from, EPOCHS times in hashed
order, in one task whose state has a fixed size; intercepts then move by the log ratio of
each language's share of all documents to its share of the sample.

Calibration. One temperature, which gives the least log loss on a fifth of the sample that was
not learned from.

Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import functools
import math
import pickle
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.words import mix
from postmill.session import checkpoint

SAMPLE = 12_000
LANGS = 400
BITS = 16
EPOCHS = 3
ALPHA = 2.0
BETA = 0.2
L1 = 0.02
L2 = 0.002
CALIBRATION = 5
STRETCH = 1 << 20
NONE = "und"
SEEDS = mix(np.arange(1, 4, dtype=np.uint64))


@functools.cache
def kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark, 0 else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def letters(text: str) -> np.ndarray | None:
    """Code points of a lower-cased text with one 0 for all between its words; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    if not (kind == 2).any():
        return None
    codes = np.concatenate([[0], np.where(kind > 0, codes, 0), [0]]).astype(np.uint64)
    kept = codes != 0
    kept[:-1] |= codes[1:] != 0
    return np.append(codes[kept], np.uint64(0))


def buckets(codes: np.ndarray) -> np.ndarray:
    """Bucket of each run of one to three characters that has a blank at an end at most."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    a, b, c = a[inner], b[inner], c[inner]
    two = b << np.uint64(21)
    keys = [b ^ SEEDS[0], (a | two) ^ SEEDS[1], ((b | c << np.uint64(21)) ^ SEEDS[1])[c == 0], (a | two | c << np.uint64(42)) ^ SEEDS[2]]
    return (mix(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a whole text, worked through stretch by stretch; None without a letter."""
    codes = letters(text) if text else None
    if codes is None:
        return None
    total = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(codes) - 2, STRETCH):
        total += np.bincount(buckets(codes[at : at + STRETCH + 2]), minlength=len(total))
    found = np.flatnonzero(total)
    return found, total[found]


def values(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[found]
    return x / math.sqrt(float(x @ x))


class Leader:
    """Follow-the-regularised-leader for softmax; the last row is the intercept, which no penalty holds."""

    def __init__(self, size: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size + 1, classes), np.float32)
        self.n = np.zeros((size + 1, classes), np.float32)

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        free = (rows == len(self.z) - 1)[:, None]
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + l2), 0.0)

    def learn(self, found: np.ndarray, x: np.ndarray, y: int) -> None:
        rows, x = np.append(found, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(rows)
        error = softmax(x @ w)
        error[y] -= 1
        g = x[:, None] * error
        n = self.n[rows]
        more = n + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits that gives the least weighted log loss, by golden sections of its logarithm.

    One part in n + 1 of each of n labels is dealt over all classes, so that rows without an
    error don't call for boundless certainty.
    """
    if not len(truth):
        return 1.0
    doubt = 1 / (len(truth) + 1)

    def loss(t):
        scaled = logits / math.exp(t)
        top = scaled.max(1)
        whole = top + np.log(np.exp(scaled - top[:, None]).sum(1))
        return float(weight @ (whole - (1 - doubt) * scaled[np.arange(len(truth)), truth] - doubt * scaled.mean(1)))

    low, high, ratio = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > 1e-4:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return math.exp((low + high) / 2)


@dataclass
class Model:
    """Languages in order, inverse document frequencies, weights by bucket, intercepts, temperature."""

    langs: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    used: np.ndarray | None = None
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None
    temperature: float = 1.0

    def __post_init__(self):
        self.place = None

    def logits(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.place is None:
            self.place = np.full(1 << BITS, len(self.used), np.int64)
            self.place[self.used] = np.arange(len(self.used))
            self.table = np.vstack([self.weights, np.zeros((1, len(self.langs)), self.weights.dtype)])
        return x @ self.table[self.place[found]] + self.offsets

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.langs else None
        if counts is None:
            return NONE, 0.0
        p = softmax(self.logits(counts[0], values(*counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3


def sampled(docs: DataFrame, sample: int, langs: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(lang, part, text of the sample; language -> documents and sampled documents to learn from)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 1))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    each = max(1, sample // max(1, len(sizes)))
    keys = rows.filter(F.col("lang").isin([r.lang for r in sizes])).groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = keys.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select("lang", "doc_id")
    # few has `sample` rows at most; copies of a row count once
    texts = rows.join(F.broadcast(few), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return texts, {r.lang: (r.n, min(r.n, each)) for r in sizes}


def fit(docs: DataFrame, sample: int = SAMPLE, langs: int = LANGS) -> Model:
    """A model of the texts and languages of rows outside the held-out fold; without any it finds nothing."""
    texts, sizes = sampled(docs, sample, langs)
    if not sizes:
        return Model()
    names = sorted(sizes)

    def count(batches):
        for batch in batches:
            rows = [(i, lang, gram_counts(text.as_py())) for i, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"))]
            rows = [(i, lang, c[0].astype(np.uint16).tobytes(), c[1].astype(np.uint32).tobytes()) for i, lang, c in rows if c]
            ids, own, found, counts = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "found", "counts"])

    def learn(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("found").to_pylist(), batch.column("counts").to_pylist())
        rows = [(i, names.index(lang), np.frombuffer(f, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32)) for i, lang, f, c in rows]
        yield pa.record_batch([pa.array([pickle.dumps(train(rows, names, sizes))], pa.binary())], ["model"])

    grams = texts.mapInArrow(count, "doc_id long, lang string, found binary, counts binary")
    return pickle.loads(checkpoint(grams.repartition(1).mapInArrow(learn, "model binary")).first().model)


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], names: list[str], sizes: dict[str, tuple[int, int]]) -> Model:
    """From (doc_id, language number, buckets, counts) of the sample."""
    place = mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    order = sorted(range(len(rows)), key=lambda j: (int(place[j]), rows[j][1]))
    apart = [j for j in order if int(place[j]) % CALIBRATION == 0]
    taught = [j for j in order if int(place[j]) % CALIBRATION] or apart
    if not taught:
        return Model()
    texts = np.zeros(1 << BITS)
    for j in taught:
        texts[rows[j][2]] += 1
    idf = np.log((len(taught) + 1) / (texts + 1)) + 1
    leader = Leader(1 << BITS, len(names))
    for _ in range(EPOCHS):
        for j in taught:
            leader.learn(rows[j][2], values(rows[j][2], rows[j][3], idf), rows[j][1])
    weights = leader.weights(np.arange((1 << BITS) + 1))
    used = np.flatnonzero(weights[:-1].any(1))
    share = np.array([math.log(sizes[n][0] / sizes[n][1]) for n in names])
    model = Model(names, idf, used, weights[used].astype(np.float32), weights[-1] + share)
    if apart:
        logits = np.stack([model.logits(rows[j][2], values(rows[j][2], rows[j][3], idf)) for j in apart])
        truth = np.array([rows[j][1] for j in apart])
        model.temperature = temperature(logits, truth, np.exp(share)[truth])
    model.__post_init__()
    return model


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Texts that are null or without a letter are `und` with score 0, as are all where the model
    learned no language; any other text gets a learned language, by its whole length. A row
    without an id is not held out (and never learned from). Repeated rows are scored each; an
    empty table gives no rows; other columns, lang among them, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def score(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs, fit(docs))
