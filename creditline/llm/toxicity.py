"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct lower-cased words and the prefixes of 3 to 7
letters of longer words.  With x the sum, over the distinct words that carry a
feature, of the bit length of their number of occurrences, the model is ``P(grade > k) = sigmoid(w . x - threshold_k)``: all
grades share the weights w, and the thresholds ascend.  As w . x is a sum over
distinct words, a task remembers each word's share and a whole text of any
length costs one look-up a word; features without evidence weigh nothing, so
that length alone never adds up to toxicity.

The model is fitted on a bounded sample of labelled rows (MAX_LABELLED, those
with the smallest hash of their id); every document is scored.  Labels are
binary, so the grade of a toxic example is taken from its number of distinct
telling words (words with a selected feature): 1 below GRADE_WORDS[0], 2 below
GRADE_WORDS[1], else 3.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import CACHE_WORDS, small_batches, stored, tidy
from creditline.llm.decontam import plain, words_of

MAX_LABELLED = 12_000
#: Features counted in the sample; of them at most MAX_FEATURES get a weight.
MAX_CANDIDATES = 30_000
MAX_FEATURES = 4_096
MIN_DOCS = 5
MIN_CHI2 = 30.0
MIN_LIFT = 4.0
GRADE_WORDS = (3, 6)
REJECT = 0.5
RESULT = "doc_id bigint, severity double, p_toxic double, grade int, toxic boolean"


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in range(3, min(8, len(word))))]


def select(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Features that mark toxic texts, the strongest first: chi-squared and lift
    above their bounds, from their numbers of toxic (a of n1) and clean (b of n0) texts."""
    if not n1 or not n0 or not len(a):
        return np.empty(0, np.int64)
    a, b = a.astype(float), b.astype(float)
    c, d, n = n1 - a, n0 - b, n1 + n0
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * n0, 1e-9)
    lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    ok = np.flatnonzero((chi2 >= MIN_CHI2) & (lift >= MIN_LIFT))
    return ok[np.argsort(-chi2[ok], kind="stable")][:MAX_FEATURES]


def fit(x: list[np.ndarray], grade: np.ndarray, n_features: int, n_grades: int = 4,
        steps: int = 2000, rate: float = 0.05, ridge: float = 2e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by full-batch Adam on the log-likelihood.

    ``x[i]`` lists the features of row i with repeats."""
    n = len(x)
    row = np.repeat(np.arange(n), [len(r) for r in x])
    col = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    # parameters: weights, first threshold, logs of the gaps between thresholds
    p = np.concatenate([np.zeros(n_features), [2.0], np.zeros(n_grades - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(z / 2))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])

    for step in range(1, steps + 1):
        w, theta = p[:n_features], thresholds(p)
        s = np.bincount(row, w[col], minlength=n)
        above = np.concatenate([np.ones((n, 1)), sigmoid(s[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        hi, lo = above[at, grade], above[at, grade + 1]
        like = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        ds = -(slope_hi - slope_lo) / n
        dtheta = np.zeros(n_grades + 1)
        np.add.at(dtheta, grade, slope_hi / n)
        np.add.at(dtheta, grade + 1, -slope_lo / n)
        dtheta = dtheta[1:-1]
        g = np.empty_like(p)
        g[:n_features] = np.bincount(col, ds[row], minlength=n_features) + ridge * w
        g[n_features] = dtheta.sum()
        g[n_features + 1 :] = np.cumsum(dtheta[::-1])[::-1][1:] * np.exp(p[n_features + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], thresholds(p)


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, for each threshold k."""
        return 0.5 * (1 + np.tanh((score[:, None] - self.thresholds[None, :]) / 2))


class _WordScores(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        v = self[word] = self.model.word(word.decode("utf-8", "surrogatepass"))
        return v

    def of(self, text: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        words = plain(text).split()
        telling = sorted(w for w in set(words) if self[w])
        return float(sum(self[w] * words.count(w).bit_length() for w in telling))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` rows of labels(doc_id, toxic) that have a document.

    Rows with a null id or label are not used; of an id's several labels the
    largest counts, of its several texts the least.  Without toxic or without clean examples nothing is toxic."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(texts.select((F.col("toxic") > 0).alias("toxic"), "doc_id", "text"), "labelled")

    @tidy
    def list_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                found = {f for w in set(words_of(text)) for f in features(w)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["feature"])

    counts = sample.where("toxic").select("text").mapInArrow(list_features, "feature string").groupBy("feature").count()
    rows = counts.where(F.col("count") >= MIN_DOCS).orderBy(F.desc("count"), "feature").limit(MAX_CANDIDATES).collect()
    candidates = {r["feature"]: i for i, r in enumerate(rows)}

    @tidy
    def count_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(candidates), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                found = {f for w in set(words_of(text)) for f in features(w)}
                n[[candidates[f] for f in found if f in candidates]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["feature", "n"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean = np.zeros(len(rows), np.int64)
    for r in sample.where("not toxic").select("text").mapInArrow(count_clean, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        clean[r["feature"]] = r["n"]
    chosen = select(np.array([r["count"] for r in rows]), clean, sizes.get(True, 0), sizes.get(False, 0))
    if not len(chosen):
        return Model({}, np.array([1.0, 2.0, 3.0]))
    names = [rows[c]["feature"] for c in chosen]
    number = {f: i for i, f in enumerate(names)}

    @tidy
    def list_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, telling = [], []
            for t in b.column(1).to_pylist():
                found = [([number[f] for f in features(w) if f in number], n) for w, n in sorted(Counter(words_of(t)).items())]
                at.append([f for fs, n in found for f in fs * n.bit_length()])
                telling.append(sum(bool(fs) for fs, _ in found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(telling, pa.int32())],
                names=["toxic", "doc_id", "at", "telling"])

    found = sample.select("toxic", "text", "doc_id").mapInArrow(list_numbers, "toxic boolean, doc_id bigint, at array<int>, telling int")
    table = found.toArrow().sort_by("doc_id")
    x = [np.array(r, np.int64) for r in table["at"].to_pylist()]
    grade = np.where(table["toxic"].to_numpy(), 1 + np.searchsorted(np.array(GRADE_WORDS), table["telling"].to_numpy(), "right"), 0)
    w, thresholds = fit(x, grade, len(names))
    return Model(dict(zip(names, map(float, w), strict=True)), thresholds)


def score(docs: DataFrame, model: Model, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, severity (expected grade, 0 to 3), p_toxic, grade (the
    likeliest), toxic (p_toxic >= ``reject``).

    Whole texts are scored; null and empty texts like any text without telling
    words.  Repeated rows are scored alike, a null id is kept, an empty table
    gives an empty result; columns other than id and text are not read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordScores(shared.value)
        for b in batches:
            s = np.array([words.of(t.as_py() or "") for t in b.column(1)], np.float64)
            above = shared.value.above(s)
            each = np.diff(-np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)),
                 pa.array(above[:, 0] >= reject)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return cols.mapInArrow(run, RESULT)


def reject_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``docs`` without the rows that the model fitted on ``labels`` finds toxic."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordScores(shared.value)
        for b in batches:
            s = np.array([words.of(t.as_py() or "") for t in b.column(at)], np.float64)
            yield b.filter(pa.array(shared.value.above(s)[:, 0] < reject))

    return docs.mapInArrow(run, docs.schema)
