"""Prefix-sum attribution equals attribution over all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from creditline.operators.attribution import attribute, attribute_swept
from creditline.operators.journeys import eligible_pairs
from creditline.operators.sweep import order_credits

TOUCH = "event_id bigint, user_id bigint, event_timestamp timestamp_ntz, channel string, dma_code string"
ORDER = "conversion_id bigint, user_id bigint, converted_at timestamp_ntz, order_value_usd decimal(18,2)"
T0 = datetime(2024, 1, 1)


def _data(spark, seed, users=12, touches=300, orders=60, days=200, string_ids=False):
    rng = random.Random(seed)
    ts = [T0 + timedelta(days=rng.uniform(0, days)) for _ in range(40)]

    def when():
        return rng.choice(ts) if rng.random() < 0.3 else T0 + timedelta(seconds=rng.uniform(0, days * 86400))

    t = [(i, rng.choice([None, *range(users)]) if rng.random() < 0.8 else 0, None if rng.random() < 0.02 else when(),
          rng.choice(["Email", "Meta", "Google", None]), "x") for i in range(touches)]
    o = [(i, rng.randint(0, users + 2), when(), rng.randint(1, 50000) / 100) for i in range(orders)]
    td = spark.createDataFrame(t, TOUCH)
    if string_ids:
        td = td.withColumn("event_id", td.event_id.cast("string"))
    from decimal import Decimal

    od = spark.createDataFrame([(a, b, c, Decimal(str(v))) for a, b, c, v in o], ORDER)
    return td, od


def _table(df):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[d.pop("channel")] = d
    return out


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for c in a[k]:
            assert float(b[k][c]) == pytest.approx(float(a[k][c]), rel=1e-7, abs=1e-6), (k, c)


@pytest.mark.parametrize("lookback", [None, 7, 90])
@pytest.mark.parametrize("scope,anchor", [("conversion", "conversion"), ("user", "conversion"), ("user", "last_touch")])
@pytest.mark.parametrize("half_life,hours", [(7.0, 24.0), (0.01, 5.0)])
def test_swept_credits_equal_pair_credits(spark, lookback, scope, anchor, half_life, hours):
    t, o = _data(spark, len(scope) + (lookback or 0))
    want = attribute(eligible_pairs(t, o, lookback), scope=scope, anchor=anchor, half_life_days=half_life)
    got = attribute_swept(t, o, lookback, scope=scope, anchor=anchor, half_life_days=half_life, bucket_hours=hours)
    _same(_table(want), _table(got))


def test_string_ids_and_old_history(spark):
    t, o = _data(spark, 3, days=9000, string_ids=True)
    _same(_table(attribute(eligible_pairs(t, o, None))), _table(attribute_swept(t, o, None)))


def test_empty_inputs(spark):
    t, o = _data(spark, 4)
    assert attribute_swept(t.limit(0), o).count() == 0
    assert attribute_swept(t, o.limit(0)).count() == 0


def test_heavy_user_makes_no_pairs(spark):
    """A user of 200,000 touches and 400 orders: 80 million pairs, of which no plan node makes any."""
    from pyspark.sql import functions as F

    us = F.col("id") * 60
    t = spark.range(200_000).select(
        F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("user_id"), F.timestamp_seconds(us + 1_700_000_000).cast("timestamp_ntz").alias("event_timestamp"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("channel"), F.lit("x").alias("dma_code"))
    o = spark.range(400).select(F.col("id").alias("conversion_id"), F.lit(1).cast("bigint").alias("user_id"),
                                F.timestamp_seconds(F.col("id") * 30_000 + 1_700_000_001).cast("timestamp_ntz").alias("converted_at"),
                                F.lit(10).cast("decimal(18,2)").alias("order_value_usd"))
    rows = order_credits(t, o, None).collect()
    assert sum(r["n"] for r in rows) == sum(min(i * 500 + 1, 200_000) for i in range(400))
    plan = attribute_swept(t, o, None)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("event_timestamp" in x or "touchpoint_ts" in x for x in joins)


def _held_by_stage(df):
    """Sorts and aggregates of each stage of the plan, which one task holds."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    held, open_ = [0], []  # (depth, stage) of the operators above
    for x in plan.splitlines():
        name = x.lstrip(" :+-*(0123456789)")
        depth = len(x) - len(x.lstrip(" :+-"))
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        stage = open_[-1][1] if open_ else 0
        if name.startswith("Exchange"):
            held.append(0)
            stage = len(held) - 1
        elif name.startswith(("Sort ", "HashAggregate", "SortAggregate", "ObjectHashAggregate")):
            held[stage] += 1
        open_.append((depth, stage))
    return held


@pytest.mark.parametrize("lookback", [None, 7, 90])
def test_no_task_holds_all_steps(spark, lookback):
    """Touches that come partitioned by user don't put all steps into one stage."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t, o = _data(spark, 5)
        t = t.repartition(6, "user_id").dropDuplicates(["user_id", "event_timestamp", "channel"])
        held = _held_by_stage(attribute_swept(t, o, lookback))
        assert len(held) > 5 and 1 <= max(held) <= 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_start_before_the_first_bucket(spark):
    """Starts in the bucket of the first touch, in the one before it and long before; touches at both ends count."""
    from decimal import Decimal

    t = spark.createDataFrame([(i, 1, T0 + timedelta(days=10, hours=h), "Email", "x") for i, h in enumerate((1, 5, 30))]
                              + [(9, 1, T0 + timedelta(days=12), None, "x")], TOUCH)
    ends = [T0 + timedelta(days=10, hours=h) for h in (0, 1, 5, 23, 24, 30, 167, 168, 169, 173, 198, 199)]
    o = spark.createDataFrame([(i, 1, e, Decimal("10.00")) for i, e in enumerate(ends)], ORDER)
    got = {(r["conversion_id"], r["channel"]): r["n"] for r in order_credits(t, o, 7).collect()}
    at = [(r["event_timestamp"], r["channel"]) for r in t.collect()]
    want = {}
    for i, e in enumerate(ends):
        for when, channel in at:
            if e - timedelta(days=7) <= when <= e:
                want[i, channel] = want.get((i, channel), 0) + 1
    assert got == want
    for half_life in (7.0, 0.01):
        _same(_table(attribute(eligible_pairs(t, o, 7), half_life_days=half_life)), _table(attribute_swept(t, o, 7, half_life_days=half_life)))
