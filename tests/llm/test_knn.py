import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditline.llm import queries
from creditline.llm.knn import voronoi_topk

VECTORS = "vec_id bigint, embedding array<double>, cell string, row string, dist string, score string, v string"


def brute(rows, is_query, k):
    """Rows (query_id, rank, vec_id, score) by definition, for rows of ids and vectors."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if is_query(i):
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(good) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, mod=3, **kw):
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x", "x") for i, v in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in voronoi_topk(df, F.col("vec_id") % mod == 0, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"pivots": 3, "block": 7}, {"pivots": 1, "block": 50, "k": 2}])
def test_against_brute_force(spark, kw):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 6)) * 3
    rows = [(i, (centres[i % 4] + rng.normal(size=6) * 0.1).tolist()) for i in range(90)]
    rows += [(200 + i, [1.0, -0.5, 0.25, 0.0, 0.0, 2.0]) for i in range(40)]  # a third are copies
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6),
             (None, [1.0] * 6), (306, []), (309, [0.5, 0.5]), (312, [0.0] * 6)]
    assert run(spark, rows, **kw) == brute(rows, lambda i: i % 3 == 0, kw.get("k", 5))


def test_pruning_replicates_only_what_is_needed(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 3)) * 100
    rows = [(i, (centres[i % 6] + rng.normal(size=3)).tolist()) for i in range(300)]
    assert run(spark, rows, mod=30, pivots=12, block=16) == brute(rows, lambda i: i % 30 == 0, 5)


def test_few_rows_repeated_ids_and_empty(spark):
    rows = [(3, [1.0, 2.0]), (4, [0.5, 0.5]), (4, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)
    assert run(spark, [(3, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == [] and run(spark, []) == []
    twice = run(spark, [(3, [1.0]), (3, [1.0]), (5, [2.0])])
    assert twice == [(3, 1, 5, 131072)] * 2 + [(3, 2, 3, 65536)] * 2


def test_sql(spark):
    import duckdb
    from tests.conftest import MEDIUM

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{MEDIUM}/embeddings.parquet')")
    want = con.execute(queries.ORACLE["op7_topk"]).fetchall()
    assert sorted(tuple(r) for r in queries.op7_topk(spark, MEDIUM).collect()) == sorted(want)
