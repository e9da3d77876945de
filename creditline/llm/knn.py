"""Exact top-k search by inner product: a Voronoi kNN join.

With M the largest norm of the data, a data vector x gets one more coordinate,
sqrt(M^2 - |x|^2), and a query one of zero.  Then |q - x|^2 = |q|^2 + M^2 - 2 q.x:
the nearest vectors are those of the highest inner product.

1. PIVOTS vectors cut the space into Voronoi cells; every data vector goes to
   the cell of its nearest pivot.
2. A cell's summary is its size, its smallest and largest distance to the pivot,
   and its k + 1 smallest distances.  Summaries bound the distance of each
   query's (k + 1)-th neighbour from above (one more, for the query itself is
   data too) and its distance to any member of a cell from below.
3. Queries of neighbouring cells form groups of about ``block`` queries.  A
   group's bounds are those of its queries; a data vector is sent to the groups
   whose bound it may fall within, and to no other.
4. (group, block of a cell) is one task's work: at most ``block`` queries and
   about ``block`` vectors, a matrix product.  The groups' best are merged.

Cells are cut into blocks by hash, so neither a cell that holds a third of all
vectors nor bounds that prune nothing bring many vectors into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.llm.common import stored

PIVOTS = 32
BLOCK = 4096
RESULT = "query_id bigint, query_row bigint, vec_id bigint, vec_row bigint, score bigint"


def quantise(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, row, query, v, norm2, top): components floor(scale * x) as 32-bit integers."""
    cols = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out, norm2, top = [], [], [], []
            for i, v in enumerate(b.column(3)):
                values = v.values
                if values.null_count:
                    continue
                x = np.floor(scale * values.to_numpy(zero_copy_only=False))
                if not np.isfinite(x).all():
                    continue
                if len(x) and np.abs(x).max() >= 2**31:
                    raise ValueError(f"a component of vector {b.column(0)[i]} leaves the range of scores")
                keep.append(i)
                out.append(x.astype("<i4").tobytes())
                norm2.append(float(x @ x))
                top.append(float(np.abs(x).max(initial=0)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(out, pa.binary()),
                 pa.array(norm2, pa.float64()), pa.array(top, pa.float64())],
                names=["vec_id", "row", "query", "v", "norm2", "top"])

    return stored(cols.mapInArrow(run, "vec_id bigint, row bigint, query boolean, v binary, norm2 double, top double"), "vectors")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of 64-bit floats, shorter vectors filled up with zeros."""
    raw = [x for x in column.to_pylist()]
    if all(len(x) == 4 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dim).astype(np.float64)
    return np.frombuffer(b"".join(x.ljust(4 * dim, b"\0") for x in raw), "<i4").reshape(len(raw), dim).astype(np.float64)


class Space:
    """Pivots and the distances to them, shared with all tasks (PIVOTS vectors)."""

    def __init__(self, pivots: np.ndarray, pivot_norm2: np.ndarray, m2: float, k: int, dim: int):
        self.p, self.m2, self.k, self.dim = pivots, m2, k, dim
        self.p_last = np.sqrt(np.maximum(m2 - pivot_norm2, 0))
        self.slack = 1e-6 * (np.sqrt(m2) + 1)

    def of_data(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.m2 - norm2, 0))
        return np.sqrt(np.maximum(2 * self.m2 - 2 * (x @ self.p.T + last[:, None] * self.p_last[None, :]), 0))

    def of_queries(self, q: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm2[:, None] + self.m2 - 2 * (q @ self.p.T), 0))

    def summarise(self, cells: dict[int, tuple[int, float, float, list[float]]]) -> None:
        n = len(self.p)
        self.size = np.array([cells[j][0] if j in cells else 0 for j in range(n)])
        self.lo = np.array([cells[j][1] if j in cells else np.inf for j in range(n)])
        self.hi = np.array([cells[j][2] if j in cells else -np.inf for j in range(n)])
        near = [(j, d) for j in range(n) if j in cells for d in cells[j][3]]
        self.near_cell = np.array([j for j, _ in near], np.int64)
        self.near = np.array([d for _, d in near])

    def bound(self, d: np.ndarray) -> np.ndarray:
        """Upper bound of each query's (k + 1)-th smallest distance, from its distances to the pivots."""
        if len(self.near) <= self.k:
            return np.full(len(d), np.inf)
        upper = d[:, self.near_cell] + self.near[None, :]
        return np.partition(upper, self.k, axis=1)[:, self.k] + self.slack

    def needs(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(queries x cells) whether a cell can hold a vector within the bound."""
        low = np.maximum(np.maximum(d - self.hi[None, :], self.lo[None, :] - d), 0)
        return (self.size > 0)[None, :] & (low <= bound[:, None] + self.slack)


def _groups(queries: dict[int, int], pivots: np.ndarray, block: int) -> tuple[list[int], list[int]]:
    """(first group, number of groups) of each cell's queries: near cells share a group of
    about ``block`` queries, a cell of more queries gets several of its own."""
    n = len(pivots)
    order, left = [], set(range(n))
    at = 0
    while left:
        left.discard(at)
        order.append(at)
        if left:
            rest = sorted(left)
            at = rest[int(np.argmin(((pivots[rest] - pivots[at]) ** 2).sum(axis=1)))]
    first, parts, group, used = [0] * n, [1] * n, 0, 0
    for j in order:
        m = queries.get(j, 0)
        if m > block:
            group += used > 0
            first[j], parts[j], used = group, -(-m // block), 0
            group += parts[j]
            continue
        if used + m > block:
            group, used = group + 1, 0
        first[j], used = group, used + m
    return first, parts


def voronoi_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vec_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of each query with every row but its own.

    Rows (query_id, rank from 1, vec_id, score), ties to the smaller vec_id; all
    other rows if there are fewer than k.  Vectors that are null or hold a null
    or non-finite component, and rows with a null id, take no part.  A row that
    repeats another's id or vector is a candidate of its own, and as a query has
    a ranking of its own under the same query_id.  A shorter vector counts as
    filled up with zeros.  Without queries, or on an empty table, the result is
    empty.  Other columns are not read."""
    spark = vectors.sparkSession
    table = quantise(vectors, is_query, scale, id_col, vec_col)
    about = table.agg(F.max("norm2"), F.max(F.length("v")), F.max("top")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if about[0] is None:
        return spark.createDataFrame([], empty)
    m2, dim, top = float(about[0]), int(about[1]) // 4, float(about[2])
    if top * top * max(dim, 1) >= 2**62:
        raise ValueError("scores leave the range of a long")
    exact = top * top * max(dim, 1) < 2**53
    chosen = table.select("v", "norm2", "row").orderBy(F.xxhash64("row"), "row").limit(pivots).toArrow()
    space = Space(_matrix(chosen["v"], dim), chosen["norm2"].to_numpy(), m2, k, dim)
    shared = spark.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                c = b.slice(i, 4096)
                x, norm2 = _matrix(c.column(3), s.dim), c.column(4).to_numpy()
                d = s.of_data(x, norm2)
                cell = d.argmin(axis=1)
                home = s.of_queries(x, norm2).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(c.column(j) for j in range(5)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]),
                     pa.array(home.astype(np.int32))],
                    names=["vec_id", "row", "query", "v", "norm2", "cell", "dist", "home"])

    cells = stored(table.drop("top").mapInArrow(
        assign, "vec_id bigint, row bigint, query boolean, v binary, norm2 double, cell int, dist double, home int"), "cells")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            cell, dist = b.column(0).to_numpy(), b.column(1).to_numpy()
            for j in np.unique(cell).tolist():
                d = np.concatenate([best.get(j, np.empty(0)), dist[cell == j]])
                best[j] = np.sort(d)[: k + 1]
        rows = [(j, float(d)) for j, ds in best.items() for d in ds]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())],
                                         names=["cell", "dist"])

    nth = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    near = cells.select("cell", "dist").mapInArrow(smallest, "cell int, dist double").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    near_of: dict[int, list[float]] = {}
    for r in near.select("cell", "dist").collect():
        near_of.setdefault(r["cell"], []).append(r["dist"])
    sums = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    space.summarise({r["cell"]: (r["n"], r["lo"], r["hi"], near_of[r["cell"]]) for r in sums})
    homes = {r["home"]: r["count"] for r in cells.where("query").groupBy("home").count().collect()}
    if not homes:
        return spark.createDataFrame([], empty)
    first, parts = _groups(homes, space.p, block)
    blocks = [max(1, -(-int(n) // block)) for n in space.size]
    shared = spark.sparkContext.broadcast(space)

    def pick(values: list[int], by: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(by) + 1)

    salt = F.xxhash64("row", F.lit(7))
    keys = ("group", "cell", "block")
    queries = cells.where("query").select(
        "vec_id", "row", "v", "norm2", (pick(first, "home") + F.pmod(salt, pick(parts, "home")).cast("int")).alias("group"))

    def demand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            d = s.of_queries(_matrix(b.column(1), s.dim), b.column(2).to_numpy())
            bound = s.bound(d)
            q, j = np.nonzero(s.needs(d, bound))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(q)), pa.array(j.astype(np.int32)), pa.array(bound[q]), pa.array(d[q, j])],
                names=["group", "cell", "bound", "d"])

    needed = queries.select("group", "v", "norm2").mapInArrow(demand, "group int, cell int, bound double, d double")
    needed = stored(needed.groupBy("group", "cell").agg(F.max("bound").alias("bound"), F.min("d").alias("near"), F.max("d").alias("far")), "needed")
    within = F.greatest(F.col("near") - F.col("dist"), F.col("dist") - F.col("far")) <= F.col("bound") + F.lit(space.slack)
    data = cells.select("vec_id", "row", "v", "cell", "dist").join(needed, "cell").where(within).select(
        "group", "cell", F.pmod(salt, pick(blocks, "cell")).cast("int").alias("block"), "vec_id", "row", "v")
    asked = queries.join(needed.select("group", "cell"), "group").select(
        "group", "cell", F.explode(F.sequence(F.lit(0), pick(blocks, "cell") - 1)).alias("block"),
        F.col("vec_id").alias("q_id"), F.col("row").alias("q_row"), F.col("v").alias("q"))
    asked = asked.toDF(*(f"ask_{c}" for c in keys), "q_id", "q_row", "q")

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_id", "query_row", "vec_id", "vec_row", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 5, names=names)
        x = x.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        a, b = _matrix(q["q"], dim), _matrix(x["v"], dim)
        scores = a @ b.T if exact else (a.astype(np.int64) @ b.astype(np.int64).T)
        rows, q_rows = x["row"].to_numpy(), q["q_row"].to_numpy()
        left, right = [], []
        for i in range(len(scores)):
            s = scores[i]
            others = np.flatnonzero(rows != q_rows[i])
            if len(others) > k:
                least = np.partition(s[others], len(others) - k)[len(others) - k]
                others = others[s[others] >= least]
            best = others[np.argsort(-s[others], kind="stable")[:k]]
            left.append(np.full(len(best), i))
            right.append(best)
        i, j = np.concatenate(left), np.concatenate(right)
        return pa.Table.from_arrays(
            [q["q_id"].combine_chunks().take(pa.array(i)), pa.array(q_rows[i]), x["vec_id"].combine_chunks().take(pa.array(j)),
             pa.array(rows[j]), pa.array(scores[i, j].astype(np.int64))], names=names)

    found = asked.groupBy(*(f"ask_{c}" for c in keys)).cogroup(data.groupBy(*keys)).applyInArrow(solve, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
