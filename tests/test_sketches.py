"""Sketches merge over any range; bootstrap draws are independent; DiD guards; the mart's ledger."""

import tempfile
import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditline.operators import geo, sketches
from creditline.streaming import streams


def test_reach_and_quantiles_merge_within_bounds(spark):
    ts = F.timestamp_seconds(F.col("id") * 20 + 1_704_067_200).cast("timestamp_ntz")
    t = spark.range(60_000).select(ts.alias("event_timestamp"), (F.col("id") % 7919).alias("user_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("channel"),
                                   ((F.col("id") * 7919) % 10007).cast("double").alias("v"))
    daily = sketches.reach_sketches(t)
    assert daily.count() == 28
    for a, b, n in ((None, None, 60_000), (date(2024, 1, 2), date(2024, 1, 3), 8640)):
        rows = t if a is None else t.where((F.to_date("event_timestamp") >= F.lit(a)) & (F.to_date("event_timestamp") <= F.lit(b)))
        exact = {r.channel: r.n for r in rows.groupBy("channel").agg(F.count_distinct("user_id").alias("n")).collect()}
        got = sketches.reach(daily, a, b).collect()
        assert sum(r.touches for r in got) == n
        assert all(abs(r.users - exact[r.channel]) <= 0.08 * exact[r.channel] for r in got)
    q = sketches.quantiles(sketches.quantile_sketches(t, "v", "event_timestamp"), [0.05, 0.5, 0.95]).first()
    values = sorted(r.v for r in t.select("v").collect())
    import bisect

    for rank, v in zip((0.05, 0.5, 0.95), q.quantiles):
        assert abs(bisect.bisect_right(values, v) / len(values) - rank) < 0.02
    assert sketches.quantiles(sketches.quantile_sketches(t.limit(0), "v", "event_timestamp"), [0.5]).count() == 0


def test_bootstrap_draws_are_independent(spark):
    """Differences between markets vary, and the spread of summed weights is that of independent draws."""
    m = spark.range(25).select(F.concat(F.lit("market"), "id").alias("dma_code")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(2000))))
    u = geo.bootstrap_uniform(F.col("rep"), F.col("dma_code"), 0, 42)
    rows = m.select("dma_code", "rep", u.alias("u"), geo.poisson1(u).alias("w"))
    by = {}
    for r in rows.collect():
        assert 0 < r.u < 1
        by.setdefault(r.dma_code, {})[r.rep] = (r.u, r.w)
    a, b = by["market0"], by["market1"]
    assert len({round(a[i][0] - b[i][0], 6) for i in a}) > 1900
    n = len(a)
    for x in range(0, 24, 5):
        us, vs = [by[f"market{x}"][i][0] for i in a], [by[f"market{x + 1}"][i][0] for i in a]
        r = 12 * sum((p - 0.5) * (q - 0.5) for p, q in zip(us, vs)) / n
        assert abs(r) < 0.1
    sums = [sum(by[k][i][1] for k in by) for i in a]
    mean = sum(sums) / n
    assert mean == pytest.approx(25, abs=0.5)
    assert (sum((s - mean) ** 2 for s in sums) / n) ** 0.5 == pytest.approx(5, abs=0.4)


def test_bootstrap_intervals_cover_the_true_lift(spark):
    """Of 60 experiments without any lift, most 95 % intervals hold zero."""
    import random

    rng, rows = random.Random(3), []
    for e in range(60):
        for i in range(30):
            n = rng.randint(800, 1200)
            rows.append((f"m{e}_{i}", "control" if i % 2 else "treatment", sum(rng.random() < 0.05 for _ in range(n)), 1.0, n, None, f"e{e}"))
    g = spark.createDataFrame(rows, "dma_code string, arm string, conversions long, revenue double, population long, conversion_rate double, key string")
    got = geo.bootstrap_lift(g, 300, by=["key"]).collect()
    held = sum(r.lift_ci_low_pct <= 0 <= r.lift_ci_high_pct for r in got)
    assert len(got) == 60 and 50 <= held <= 60


def test_did_with_zero_population_and_repeated_controls(spark):
    conv = spark.createDataFrame([(i, 1, datetime(2024, 1, d), Decimal("1.00"), m) for i, (d, m) in enumerate([(1, "a"), (5, "a"), (5, "a"), (1, "b"), (5, "b")])],
                                 "conversion_id long, user_id long, converted_at timestamp_ntz, order_value_usd decimal(18,2), dma_code string")
    ctrl = spark.createDataFrame([("a",), ("a",)], "dma_code string")
    once = spark.createDataFrame([("a",)], "dma_code string")
    pop = spark.createDataFrame([("a", 100), ("b", 50)], "dma_code string, population long")
    args = (date(2024, 1, 1), date(2024, 1, 4), date(2024, 1, 6))
    assert geo.difference_in_differences(conv, pop, ctrl, *args).collect() == geo.difference_in_differences(conv, pop, once, *args).collect()
    assert geo.pre_period_features(conv, pop, ctrl, *args[:2]).count() == 2
    none = spark.createDataFrame([("a", 0), ("b", 50)], "dma_code string, population long")
    r = geo.difference_in_differences(conv, none, once, *args).first()
    assert r.c_pre_rate_ppm is None and r.did_ppm is None and r.t_pre_rate_ppm is not None


def test_mart_ledger(spark):
    path = tempfile.mkdtemp(prefix="creditline-mart-", dir="/tmp") + "/mart"
    schema = "event_timestamp timestamp_ntz, channel string"

    def batch(n, day=1):
        return spark.createDataFrame([(datetime(2024, 1, day) if day else None, "c")] * n, schema)

    def total(day=1):
        rows = spark.read.parquet(path).where(F.col("day").eqNullSafe(F.lit(date(2024, 1, day) if day else None).cast("date")))
        return rows.agg(F.sum("touches")).first()[0]

    one, two = (streams.incremental_daily_mart(None, path, query_id=uuid.uuid4().hex) for _ in range(2))
    one(batch(2), 0)
    one(batch(2), 0)  # replayed
    assert total() == 2
    two(batch(5), 0)  # a new checkpoint counts its epochs from 0
    assert total() == 7
    one(batch(2), 0)  # the first query's epoch again, after the second wrote
    one(batch(1), 1)
    assert total() == 8
    one(batch(1, None), 2)
    one(batch(1, None), 3)  # touches without a time
    one(batch(1, None), 3)
    assert total(None) == 2 and total() == 8
