"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network with temperature-calibrated probabilities.

Tokens are lower-cased words, runs of punctuation, and a shape mark for words
not in lower case; each has one of BUCKETS rows by hash.  Random indexing gives
every token a sparse ternary index vector (NONZERO of DIM places are +1 or -1,
by rule from its bucket) and a context vector: the sum of the index vectors of
the tokens up to REACH places away, over all documents.  The context matrix has
a fixed size (BUCKETS x DIM, 4 MB), whatever the corpus.  A document is the mean
and deviation of its tokens' unit context vectors, its length and its share of
distinct tokens.

Labels are read from at most MAX_LABELLED rows of the training folds; a fifth of
them, by hash, fits the temperature only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import CACHE_WORDS, stored

BUCKETS = 16_384
DIM = 32
NONZERO = 4
REACH = 2
SLICES = 64
HIDDEN = 32
MAX_LABELLED = 20_000
FEATURES = 2 * DIM + 3
RESULT = "doc_id bigint, score double"
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """White-space separated piece of text -> bucket numbers of its tokens, as 16-bit integers."""

    def __missing__(self, piece: str) -> bytes:
        out = []
        for t in _TOKEN.findall(piece):
            low = t.lower()
            out.append(low)
            if low != t:
                out.append("<upper>" if t.upper() == t and len(t) > 1 else "<capital>" if t[1:] == low[1:] else "<mixed>")
        v = self[piece] = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in out], np.uint16).tobytes()
        return v

    def of(self, text: str) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.uint16)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero components of each bucket's index vector."""
    rng = np.random.default_rng(7)
    places = rng.random((BUCKETS, DIM)).argsort(axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], (BUCKETS, NONZERO))


def add_contexts(total: np.ndarray, docs: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> None:
    """Add the documents' contexts to ``total`` (BUCKETS * DIM)."""
    gap = np.full(REACH, -1, np.int64)
    ids = np.concatenate([x for d in docs for x in (d.astype(np.int64), gap)])
    for reach in range(1, REACH + 1):
        a, b = ids[:-reach], ids[reach:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        for word, near in ((a, b), (b, a)):
            for s in range(NONZERO):
                flat = np.bincount(word * DIM + places[near, s], signs[near, s], minlength=len(total))
                total += flat.astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS x DIM) context vectors of the whole corpus, of unit length."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, known, todo, size = np.zeros(BUCKETS * DIM, np.int64), Buckets(), [], 0
        for b in batches:
            for t in b.column(0):
                todo.append(known.of(t.as_py() or ""))
                size += len(todo[-1])
                if size > 1_000_000:
                    add_contexts(total, todo, places, signs)
                    todo, size = [], 0
        if todo:
            add_contexts(total, todo, places, signs)
        parts = total.astype("<i8").reshape(SLICES, -1)
        at = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[i].tobytes() for i in at], pa.binary())],
                                         names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(x, "<i8")
                total[i] = total[i] + v if i in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                         names=["slice", "sums"])

    kind = "slice int, sums binary"
    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(gather, kind).repartition("slice").mapInArrow(add, kind)
    out = np.zeros((SLICES, BUCKETS * DIM // SLICES))
    for r in sums.toArrow().to_pylist():
        out[r["slice"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(BUCKETS, DIM)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of a document; zeros for one without tokens."""
    out = np.zeros(FEATURES, np.float32)
    if len(ids):
        n, total, square = len(ids), np.zeros(DIM), np.zeros(DIM)
        for i in range(0, n, 65_536):
            x = vectors[ids[i : i + 65_536]]
            total += x.sum(axis=0, dtype=np.float64)
            square += np.einsum("ij,ij->j", x, x, dtype=np.float64)
        mean = total / n
        out[:DIM] = mean
        out[DIM : 2 * DIM] = np.sqrt(np.maximum(square / n - mean**2, 0))
        distinct = int((np.bincount(ids, minlength=BUCKETS) > 0).sum())
        out[2 * DIM :] = np.log1p(n) / 10, distinct / n, np.log1p(distinct) / 10
    return out


@dataclass
class Network:
    """Two layers on standardised features; ``logit`` before the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(self.logit(x) / self.temperature / 2))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Network fitted by Adam on the rows outside ``calibrate``, its temperature on those inside."""
    rng = np.random.default_rng(11)
    fx, fy = x[~calibrate], y[~calibrate].astype(float)
    if len(fy) == 0 or fy.min() == fy.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    mean, scale = fx.mean(axis=0), fx.std(axis=0) + 1e-6
    z = (fx - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 128):
            at = order[i : i + 128]
            h = np.tanh(z[at] @ p[0] + p[1])
            e = (0.5 * (1 + np.tanh((h @ p[2] + p[3]) / 2)) - fy[at]) / len(at)
            back = e[:, None] * p[2][None, :] * (1 - h**2)
            g = [z[at].T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
            step += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if calibrate.any():
        logit, cy = net.logit(x[calibrate]), y[calibrate]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        loss = [np.logaddexp(0, np.where(cy == 1, -1, 1) * logit / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, train_on: Column, max_labelled: int = MAX_LABELLED,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1, higher: label 1 likelier).

    The network is fitted on labels(doc_id, quality) of the ids for which
    ``train_on`` (an expression of doc_id) holds.  Rows with a null id or label
    are not used; of an id's several labels their majority counts (ties: 1),
    and an id of several texts is one example.
    Null texts are empty; empty texts get the score of no tokens.  With labels
    of one value, or none, all scores are the labels' smoothed share of ones.
    Repeated rows are scored alike, null ids are kept, an empty table gives an
    empty result; other columns are not read."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets()
        for b in batches:
            x = [pool(known.of(t.as_py() or ""), vectors.value).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    table = stored(cols.mapInArrow(featurise, "doc_id bigint, x binary"), "features")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train_on)
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    examples = table.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    rows = examples.toArrow().sort_by([("doc_id", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    y = rows["quality"].to_numpy()
    fold = np.array([xxhash.xxh64_intdigest(str(i)) % 5 for i in rows["doc_id"].to_pylist()], np.int64)
    net = spark.sparkContext.broadcast(fit(x, y, fold == 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.value.score(x.astype(np.float64)))], names=["doc_id", "score"])

    return table.mapInArrow(score, RESULT)
