"""Toxic passages by maximum-scoring segments of token log-odds.

Learning. Tokens are whole words and word beginnings (stems), counted in toxic and in
other labelled texts. Each gets the log-odds ratio of the two classes under Dirichlet priors
in proportion to its overall frequency, and the ratio's standard error; tokens of TEXTS
toxic texts or more that stand out by SIGMAS become the model. All other words score the (negative) log-odds of the rest.

Scanning. One linear pass over a text's scored words keeps its maximal-scoring segments.
Under clean text the best segment of n words exceeds x with probability 1 - exp(-K n e^-x),
the extreme-value law of log-odds segments; K is calibrated on the clean labelled texts. A
segment is significant where the expected number of its like is below EXPECTED, and a
document's evidence is the sum of -ln(expected number) over these. A logistic curve over the
evidence, fitted on the labelled texts, gives the probability.

The model is fitted on at most SAMPLE labelled rows (those of the smallest hashed ids) and
holds at most TOKENS tokens, whatever the input; scoring reads every whole text in one pass
without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.words import documents, grams, mix
from postmill.session import checkpoint

SAMPLE = 40_000
TOKENS = 20_000
STEMS = range(3, 9)
#: Words and texts of prior evidence, dealt out by frequency; a token gets LEAST at least.
PRIOR_WORDS = 500.0
PRIOR_TEXTS = 20.0
LEAST = 1.0
TEXTS = 4
SIGMAS = 2.9
STRONG = 1.5
SAME = 0.95
EXPECTED = 0.01
SHINGLE = 5
WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    """A word's beginnings and, ending with a blank, the word itself."""
    return [word[:k] for k in STEMS if k <= len(word)] + [word + " "]


@dataclass
class Model:
    """Scores of tokens and of all other words, the extreme-value constant and the logistic curve."""

    tokens: dict[str, float] = field(default_factory=dict)
    other: float = -1e-3
    k: float = 1e-3
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self.found = None

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each word that a token matches, by the highest score."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for token, score in self.tokens.items():
                self.found.add_word(token.rstrip(" "), ())
            for token, score in self.tokens.items():
                word = token.rstrip(" ")
                self.found.add_word(word, (*self.found.get(word), (len(word), token[-1] == " ", score)))
            if self.tokens:
                self.found.make_automaton()
        if not self.tokens:
            return []
        best: dict[int, tuple[int, float]] = {}
        for end, kinds in self.found.iter(text):
            for length, whole, score in kinds:
                start = end + 1 - length
                if start and text[start - 1].isalpha() or whole and text[end + 1 : end + 2].isalpha():
                    continue
                if score > best.get(start, (0, -math.inf))[1]:
                    best[start] = (end + 1, score)
        return [(a, b, s) for a, (b, s) in sorted(best.items())]

    def segments(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of the maximal-scoring segments, in one pass; characters, end exclusive.

        The words between two hits score alike, so a stretch of them is one negative item.
        """
        text = (text or "").lower()
        # start, end, sum before, sum after, and the nearest earlier segment with a smaller sum before
        stack: list[list] = []
        total, at = 0.0, 0
        for start, end, score in self.hits(text):
            total += self.other * max(0, len(text[at:start].split()))
            if score <= 0:
                total, at = total + score, end
                continue
            item = [start, end, total, total + score]
            total, at = total + score, end
            j = len(stack) - 1
            while True:
                # what a link passes over was passed over once before, so all walks together are linear
                while j >= 0 and stack[j][2] >= item[2]:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= item[3]:
                    stack.append([*item, j])
                    break
                item, link = [stack[j][0], item[1], stack[j][2], item[3]], stack[j][4]
                del stack[j:]
                j = link
        return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]

    def significant(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, -ln of the expected number) of the significant segments."""
        found = self.segments(text)
        n = len((text or "").split()) if found else 0
        judged = [(a, b, s - math.log(self.k * max(1, n))) for a, b, s in found]
        return [x for x in judged if x[2] > -math.log(EXPECTED)]

    def score(self, evidence: float) -> float:
        x = self.offset + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic: texts of at most `sample` labelled rows. A doc_id labelled both ways counts as toxic.

    Of texts with the same smallest shingle hash, which are copies or near copies, one stays,
    so that a copied text doesn't make its rare words look toxic.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    learned = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    few = learned.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id")

    def sign(batches):
        for batch in batches:
            least = [int(mix(grams(h, min(SHINGLE, len(h)))).min() >> np.uint64(1)) if len(h) else 0 for h in documents(batch, "text", fold_case=True)]
            yield pa.record_batch([batch.column("text"), batch.column("toxic"), pa.array(least, pa.int64())], ["text", "toxic", "same"])

    signed = texts.select("text", "toxic").mapInArrow(sign, "text string, toxic int, same long")
    return signed.groupBy("same", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _counts(rows: DataFrame, keep: set[str] | None) -> DataFrame:
    """token, n, texts over rows' texts, of the tokens to keep; and the numbers of words and texts as the empty token."""

    def count(batches):
        known: dict[str, tuple] = {}
        total, texts = Counter(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                own, seen = Counter(WORD.findall((text.as_py() or "").lower())), set()
                for word, n in own.items():
                    if word not in known:
                        known[word] = tuple(t for t in tokens_of(word) if keep is None or t in keep)
                    for t in known[word]:
                        total[t] += n
                        seen.add(t)
                texts.update(seen)
                total[""] += own.total()
                texts[""] += 1
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([texts[t] for t in total], pa.int64())], ["token", "n", "texts"])

    return rows.select("text").mapInArrow(count, "token string, n long, texts long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def log_odds(y1: float, n1: float, y0: float, n0: float, prior: float) -> tuple[float, float]:
    """Log-odds ratio under Dirichlet priors, and its number of standard errors."""
    a = max(prior * (y0 + y1) / (n0 + n1), LEAST)
    delta = math.log((y1 + a) / max(1, n1 + prior - y1 - a)) - math.log((y0 + a) / max(1, n0 + prior - y0 - a))
    return delta, delta / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows outside the held-out fold; without both classes it finds nothing."""
    rows = checkpoint(labelled(docs, labels, sample))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        rate = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return Model(offset=math.log(rate / (1 - rate)))
    often = F.desc(F.col("token") == ""), F.desc("texts"), "token"
    toxic = {r.token: (r.n, r.texts) for r in _counts(rows.filter("toxic = 1"), None).filter(f"texts >= {TEXTS} or token = ''").orderBy(*often).limit(4 * TOKENS + 1).collect()}
    clean = {r.token: (r.n, r.texts) for r in _counts(rows.filter("toxic = 0"), set(toxic)).collect()}
    (n1, t1), (n0, t0) = toxic.pop("", (0, 0)), clean.pop("")
    found = {}
    for token, (y1, d1) in toxic.items():
        y0, d0 = clean.get(token, (0, 0))
        # how sure: by texts, for one text may repeat a word; how strong: by words
        (_, z), (delta, _) = log_odds(d1, t1, d0, t0, PRIOR_TEXTS), log_odds(y1, n1, y0, n0, PRIOR_WORDS)
        if z > SIGMAS and delta > STRONG:
            found[token] = (z, delta, y1, y0)
    # of beginnings that stand for the same words the longest stays; then, what a stem of it does as surely adds nothing
    same = {t[:k] for t, v in found.items() for k in STEMS if k < len(t) and found.get(t[:k], (0, 0, math.inf))[2] * SAME <= v[2]}
    best = {t: v for t, v in found.items() if t not in same}
    best = {t: v for t, v in best.items() if not any(best.get(t[:k], (0,))[0] >= v[0] for k in STEMS if k < len(t))}
    top = sorted(best, key=lambda t: (-best[t][0], t))[:TOKENS]
    model = Model({t: best[t][1] for t in top})
    rest1, rest0 = (max(1, n - sum(best[t][i] for t in top)) for n, i in ((n1, 2), (n0, 3)))
    model.other = min(-1e-4, math.log(rest1 / max(1, n1)) - math.log(rest0 / max(1, n0)))
    return calibrate(model, rows)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """The extreme-value constant from the clean texts, then the logistic curve from all."""
    floor = min(model.tokens.values(), default=1.0)

    def measure(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                t = text.as_py() or ""
                out.append((max((s for _, _, s in model.segments(t)), default=0.0) >= floor, len(t.split())))
            yield pa.record_batch([pa.array([a for a, _ in out], pa.bool_()), pa.array([b for _, b in out], pa.int64())], ["over", "n"])

    clean = rows.filter("toxic = 0").select("text").mapInArrow(measure, "over boolean, n long").agg(F.sum(F.col("over").cast("long")), F.sum("n")).first()
    model.k = min(1.0, (clean[0] + 0.5) / max(1, clean[1]) * math.exp(floor))

    def weigh(batches):
        for batch in batches:
            x = [round(math.log1p(sum(s for _, _, s in model.significant(t.as_py()))), 2) for t in batch.column("text")]
            yield pa.record_batch([pa.array(x, pa.float64()), batch.column("toxic")], ["x", "toxic"])

    # x is rounded, so the table of its values is small
    points = rows.select("text", "toxic").mapInArrow(weigh, "x double, toxic int").groupBy("x", "toxic").count().collect()
    x, y, n = (np.array([p[i] for p in points], float) for i in range(3))
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-2])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * np.maximum(p * (1 - p), 1e-9))[:, None]) + ridge, design.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    model.offset, model.slope = float(beta[0]), float(max(0.0, beta[1]))
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (array of start, end, evidence) of every row of docs.

    start and end are code points of the text, end exclusive (of its lower-cased form where
    that has another length). Null and empty texts have no passages and the score of no
    evidence. A row without an id is not held out. Repeated rows are scored each; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    passages = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def scan(batches):
        for batch in batches:
            found = [model.significant(t.as_py()) for t in batch.column("text")]
            score = [model.score(sum(s for _, _, s in f)) for f in found]
            spans = pa.array([[{"start": a, "end": b, "evidence": s} for a, b, s in f] for f in found], passages)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), spans], ["doc_id", "held_out", "score", "predicted", "passages"])

    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:int,end:int,evidence:double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text the model does not call toxic."""

    def keep(batches):
        for batch in batches:
            clean = [model.score(sum(s for _, _, s in model.significant(t.as_py()))) < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
