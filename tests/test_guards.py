"""Edge rows, time zones, plans and replays of the operators."""

import math
import os
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditline.functions.columns import days_between, order_key, trunc_second
from creditline.operators import budget, geo, quality, spend
from creditline.operators.attribution import attribute
from creditline.operators.journeys import dedup_touchpoints, eligible_pairs, journey_steps, near_duplicates_removed, unattributed_conversions
from creditline.plans.pipeline import Pipeline
from creditline.plans.registry import all_queries
from creditline.sources import raw
from creditline.sources.adapter import read_table
from tests.conftest import MEDIUM, SMALL

TOUCH = "event_id long, user_id long, event_timestamp timestamp_ntz, channel string, dma_code string"
CONV = "conversion_id long, user_id long, converted_at timestamp_ntz, order_value_usd decimal(18,2), dma_code string"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|single|round)", executed(df)))


def final_exchanges(df) -> int:
    """Exchanges that ran, without those that reuse another."""
    df.collect()
    final = executed(df).split("Initial Plan")[0]
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|single|round)", re.sub(r"ReusedExchange[^\n]*", "", final)))


# ---------------------------------------------------------------- sources ---

def test_appended_files_are_seen(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 3
    spark.range(4).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 7


def test_touches_read_the_events_once(spark):
    p = Pipeline(spark, SMALL)
    assert executed(p.touches).count("events.parquet") == 1
    assert executed(p.deduped).count("events.parquet") == 1
    assert executed(p.pairs(90)).count("events.parquet") == 2  # touches and orders


def test_csv_round_trip_and_layers(spark, tmp_path):
    from creditline.sources.schemas import RAW_SCHEMAS

    rows = Pipeline(spark, SMALL).inputs.raw_touchpoints.limit(40)
    cols = RAW_SCHEMAS["raw_user_touchpoints"].fieldNames() if "raw_user_touchpoints" in RAW_SCHEMAS else None
    name = next(iter(RAW_SCHEMAS))
    schema = RAW_SCHEMAS[name]
    data = spark.createDataFrame([tuple(None if i else "1" for i, _ in enumerate(schema.fields))], ",".join(f"{f.name} string" for f in schema.fields))
    raw.write_csv(data, str(tmp_path / "csv"))
    back = raw.read_raw(spark, str(tmp_path / "csv"), name)
    assert back.columns == schema.fieldNames() and back.count() == 1
    assert cols is None or cols
    raw.write_layer(rows.withColumn("day", F.col("timestamp").cast("date")), str(tmp_path / "layer"), ("day",))
    assert raw.read_raw(spark, str(tmp_path / "layer"), name, "parquet").count() == rows.count()
    with pytest.raises(ValueError):
        raw.read_raw(spark, "x", name, "orc")
    assert raw.register_layer(rows, "layer_view").count() == spark.table("layer_view").count()
    parsed = spark.createDataFrame([("2024-01-02 03:04:05", "02/01/2024")], "a string, b string").select(
        raw.parse_timestamp("a").alias("t"), raw.parse_date("b", "dd/MM/yyyy").alias("d")).first()
    assert parsed.t == datetime(2024, 1, 2, 3, 4, 5) and parsed.d == date(2024, 1, 2)


# ------------------------------------------------------------- time zones ---

def test_order_key_and_distances_ignore_the_session_zone(spark):
    # 02:30 does not exist in New York on this day; 01:30 exists twice in November
    times = [datetime(2024, 3, 10, 1, 59, 59, 999999), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 15),
             datetime(2024, 11, 3, 0, 30), datetime(2024, 11, 3, 1, 30), datetime(2024, 11, 3, 2, 30), datetime(1969, 12, 31, 23, 59, 59, 500000)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i long, t timestamp_ntz")
        got = {r.i: r for r in df.select("i", "t", order_key("t", "i").alias("k"), trunc_second("t").alias("s"),
                                         days_between(F.lit("2024-03-10").cast("timestamp_ntz"), "t").alias("d")).collect()}
        assert sorted(range(len(times)), key=lambda i: got[i].k) == sorted(range(len(times)), key=lambda i: times[i])
        for i, t in enumerate(times):
            assert got[i].s == t.replace(microsecond=0)
            assert got[i].d == pytest.approx((t - datetime(2024, 3, 10)).total_seconds() / 86400, abs=1e-12)
        touches = spark.createDataFrame([(1, 1, times[1], "A", "x"), (2, 1, times[2], "B", "x")], TOUCH)
        orders = spark.createDataFrame([(9, 1, times[2] + timedelta(hours=1), Decimal("10.00"), "x")], CONV)
        steps = {r.event_id: r for r in journey_steps(touches, orders).collect()}
        assert (steps[1].position, steps[2].position, steps[2].prev_channel) == (1, 2, "A")
        assert steps[2].hours_since_prev == 0.75
        credit = {r.channel: r for r in attribute(eligible_pairs(touches, orders)).collect()}
        assert credit["B"].last_touch_revenue == 10 and credit["A"].first_touch_revenue == 10
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# -------------------------------------------------------------- journeys ---

def test_near_duplicates_with_null_keys_across_buckets(spark):
    t = datetime(2024, 1, 1, 0, 59, 59, 600000)
    df = spark.createDataFrame([(1, None, t, "A"), (2, None, t + timedelta(milliseconds=800), "A"), (3, 5, t, None), (4, 5, t + timedelta(milliseconds=800), None)],
                               "event_id long, user_id long, event_timestamp timestamp_ntz, channel string")
    assert sorted(r.event_id for r in near_duplicates_removed(df).collect()) == [1, 3]


def test_journeys_of_a_hot_user_and_ties(spark):
    t0 = datetime(2024, 1, 1)
    touches = [(i, 1, t0 + timedelta(minutes=7 * (i // 2)), f"C{i % 5}", "x") for i in range(600)]
    orders = [(k, 1, t0 + timedelta(hours=9 * k), Decimal("1.00"), "x") for k in range(8)] + [(99, 2, t0, Decimal("1.00"), "x")]
    tdf, cdf = spark.createDataFrame(touches, TOUCH).repartition(5), spark.createDataFrame(orders, CONV)
    got = {(r.conversion_id, r.event_id): r for r in journey_steps(tdf, cdf, lookback_days=1, bucket_days=1).collect()}
    n = 0
    for cid, _, at, _, _ in orders[:-1]:
        mine = sorted((ts, e, ch) for e, _, ts, ch, _ in touches if at - timedelta(days=1) <= ts <= at)
        for i, (ts, e, _) in enumerate(mine):
            r = got[cid, e]
            n += 1
            assert (r.position, r.journey_touches) == (i + 1, len(mine))
            assert r.prev_channel == (mine[i - 1][2] if i else None)
            assert r.next_channel == (mine[i + 1][2] if i + 1 < len(mine) else None)
            assert r.hours_since_prev == (round((ts - mine[i - 1][0]).total_seconds() / 3600, 6) if i else None)
    assert n == len(got)


def test_unattributed_counts_orders_without_pairs(spark):
    p = Pipeline(spark, SMALL)
    pairs = p.pairs(7)
    assert unattributed_conversions(p.conversions, pairs).count() == p.conversions.count() - pairs.select("conversion_id").distinct().count()


# ------------------------------------------------------------ attribution ---

@pytest.mark.parametrize("scope", ["conversion", "user"])
@pytest.mark.parametrize("anchor", ["conversion", "last_touch"])
def test_old_touches_keep_the_order_value(spark, scope, anchor):
    t0 = datetime(2024, 3, 1)
    touches = [(i, 1, t0 - timedelta(days=30, hours=i), f"C{i % 2}", "x") for i in range(6)]
    orders = [(1, 1, t0, Decimal("100.00"), "x"), (2, 1, t0 + timedelta(days=20), Decimal("50.00"), "x")]
    pairs = eligible_pairs(spark.createDataFrame(touches, TOUCH), spark.createDataFrame(orders, CONV))
    got = {r.channel: r.time_decay_revenue for r in attribute(pairs, scope=scope, anchor=anchor, half_life_days=0.01).collect()}
    total = 150.0 if scope == "conversion" else sum(got.values())
    assert sum(got.values()) == pytest.approx(total) and total > 49
    assert got["C0"] > got["C1"] and got["C0"] == pytest.approx(total, rel=0.06)


@pytest.mark.parametrize("scope", ["conversion", "user"])
@pytest.mark.parametrize("anchor", ["conversion", "last_touch"])
def test_blocks_of_half_lives_change_nothing(spark, scope, anchor):
    pairs = Pipeline(spark, SMALL).pairs(90)
    one = {r.channel: r for r in attribute(pairs, scope=scope, anchor=anchor, max_age_days=90).collect()}
    blocks = {r.channel: r for r in attribute(pairs, scope=scope, anchor=anchor).collect()}
    for c, r in one.items():
        for k in r.asDict():
            a, b = r[k], blocks[c][k]
            assert a == b or (a is not None and b == pytest.approx(float(a), rel=1e-9))


def test_anchor_needs_no_more_exchanges(spark):
    p = Pipeline(spark, SMALL)
    assert exchanges(p.credits(scope="user", anchor="last_touch")) <= exchanges(p.credits(scope="user"))


@pytest.mark.parametrize("name, most", [("journey_lag_lead", 11), ("attribution_comparison", 10), ("time_decay_last_touch_anchor", 8),
                                        ("orphan_conversions", 7), ("distinct_channels", 6), ("near_duplicate_1s", 4)])
def test_plans_of_the_heavy_queries(spark, name, most):
    df = all_queries()[name](spark, SMALL)
    assert final_exchanges(df) <= most, final_exchanges(df)


# -------------------------------------------------------------------- geo ---

GROUPS = "dma_code string, arm string, conversions long, revenue_usd double, population long, conversion_rate double, key string"


def test_undefined_tests_are_null_for_their_key_only(spark):
    rows = [("a", "control", 10, 100.0, 100, 0.1, "ok"), ("b", "treatment", 30, 300.0, 100, 0.3, "ok"),
            ("a", "control", 10, 100.0, 0, None, "zero"), ("b", "treatment", 30, 300.0, 100, 0.3, "zero"),
            ("a", "control", 300, 100.0, 100, 3.0, "over"), ("b", "treatment", 30, 300.0, 100, 0.3, "over"),
            ("b", "treatment", 30, 300.0, 100, 0.3, "alone")]
    g = spark.createDataFrame(rows, GROUPS)
    z = {r.key: r for r in geo.two_proportion_z(g, by=["key"]).collect()}
    assert z["ok"].z_score == pytest.approx(3.536, abs=1e-3)
    assert all(z[k].z_score is None and z[k].p_value is None for k in ("zero", "over", "alone"))
    ci = {r.key: r for r in geo.lift_ci(g, by=["key"]).collect()}
    mde = {r.key: r for r in geo.minimum_detectable_effect(g, by=["key"]).collect()}
    assert ci["ok"].diff_ci_low_pct < 20 < ci["ok"].diff_ci_high_pct and mde["ok"].mde_abs_pct > 0
    for k in ("zero", "over", "alone"):
        assert ci[k].diff_ci_low_pct is None and mde[k].mde_abs_pct is None
    boot = {r.key: r for r in geo.bootstrap_lift(g, 50, by=["key"]).collect()}
    assert boot["ok"].replicates > 10 and boot["alone"].replicates == 0
    inc = {r.key: r for r in geo.geo_incrementality(g, spark.createDataFrame([("ok", 0.0)], "key string, treatment_spend_usd double"), by=["key"], on_zero="nan").collect()}
    assert math.isnan(inc["ok"].incremental_roas) and inc["alone"].expected_baseline_conversions is None


def test_empty_markets_for_every_key(spark):
    conv = spark.createDataFrame([(1, 1, datetime(2024, 1, 2), Decimal("1.00"), "a", "k1"), (2, 1, datetime(2024, 1, 2), Decimal("1.00"), "b", None)],
                                 CONV + ", key string")
    pop = spark.createDataFrame([("a", 10), ("b", 20), ("c", None)], "dma_code string, population long")
    ctrl = spark.createDataFrame([("b",)], "dma_code string")
    got = {(r.key, r.dma_code): (r.arm, r.conversions) for r in
           geo.geo_groups(conv, pop, ctrl, date(2024, 1, 1), date(2024, 1, 3), include_empty=True, by=["key"]).collect()}
    assert got == {("k1", "a"): ("treatment", 1), ("k1", "b"): ("control", 0), ("k1", "c"): ("treatment", 0),
                   (None, "a"): ("treatment", 0), (None, "b"): ("control", 1), (None, "c"): ("treatment", 0)}


def test_matched_markets_by_key_and_ties(spark):
    rows = [("c1", "control", 1.0, 1), ("c2", "control", 3.0, 1), ("t1", "treatment", 2.0, 1), ("t2", "treatment", 2.9, 1),
            ("c9", "control", 5.0, 2), ("t1", "treatment", 0.0, 2), ("t3", "treatment", 4.0, 3), ("t4", "treatment", None, 1)]
    f = spark.createDataFrame(rows, "dma_code string, arm string, pre_rate double, key int")
    got = {(r.key, r.treatment_dma): r.control_dma for r in geo.matched_markets(f, by=["key"]).collect()}
    assert got == {(1, "t1"): "c1", (1, "t2"): "c2", (2, "t1"): "c9", (3, "t3"): None}


def test_histogram_and_quartiles_by_key(spark):
    rows = [(f"m{i}", "control", 1, 1.0, 10, i / 100, "k") for i in range(9)] + [("x", "control", 1, 1.0, 10, 0.5, "one")]
    g = spark.createDataFrame(rows, GROUPS)
    h = geo.rate_histogram(g, by=["key"]).groupBy("key").agg(F.sum("dma_count").alias("n"), F.count("*").alias("bins")).collect()
    assert {(r.key, r.n, r.bins) for r in h} == {("k", 9, 8), ("one", 1, 8)}
    q = {r.key: r.median_rate for r in geo.rate_quartiles(g, by=["key"]).collect()}
    assert q == {"k": 0.04, "one": 0.5}


def test_poisson_weights_reach_the_tail(spark):
    cdf = geo._poisson1_cdf()
    assert len(cdf) > 12 and cdf[-1] + 1e-17 >= 1.0 - 2e-16
    us = [0.0, 0.3, 0.5, 0.95, 1 - 1e-9, 1 - 2e-16]
    got = [r.k for r in spark.createDataFrame([(u,) for u in us], "u double").select(geo.poisson1(F.col("u")).alias("k")).collect()]
    assert got[:3] == [0, 0, 1] and got[4] > 8 and got == sorted(got)


# ------------------------------------------------------- spend and budget ---

def test_gap_formula_uses_unique_converters(spark):
    orders = spark.createDataFrame([(i, i % 8200, datetime(2024, 1, 1), Decimal("1.00"), "x") for i in range(9100)], CONV)
    ads = spark.createDataFrame([("TikTok_Ads", Decimal("1.00"), 11_000)], "channel string, spend_usd decimal(18,2), platform_reported_conversions int")
    r = spend.attribution_gap(orders, ads).first()
    assert (r.unique_converters, r.warehouse_conversions, r.attribution_gap) == (8200, 9100, 2800)
    assert round(r.over_reporting_pct) == 34


def test_spend_reports_by_key(spark):
    ads = spark.createDataFrame([("a", "TikTok_Ads", Decimal("10.00"), 1, date(2024, 1, 1)), ("b", "TikTok_Ads", Decimal("20.00"), 3, date(2024, 1, 9))],
                                "key string, channel string, spend_usd decimal(18,2), platform_reported_conversions int, ad_date date")
    conv = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), Decimal("8.00"), "x", "a")], CONV + ", key string")
    assert {r.key: r.blended_actual_roas for r in spend.overview(conv, ads, by=["key"]).collect()} == {"a": 0.8, "b": None}
    credits = spark.createDataFrame([("a", "TikTok_Ads", 30.0)], "key string, channel string, time_decay_revenue double")
    roll = {(r.key, r.channel): r.roas for r in spend.blended_roas_rollup(ads, credits, by=["key"]).collect()}
    assert roll == {("a", "TikTok_Ads"): 3.0, ("a", "ALL"): 3.0, ("b", "TikTok_Ads"): 0.0, ("b", "ALL"): 0.0}
    assert {(r.key, r.week, r.blended_cac) for r in spend.weekly_blended_cac(ads, conv, by=["key"]).collect()} == {("a", "2024-01-01", 10.0), ("b", "2024-01-08", None)}
    gap = {r.key: r.attribution_gap for r in spend.attribution_gap(conv, ads, by=["key"]).collect()}
    assert gap == {"a": 0, "b": None}


def test_shift_beyond_the_budget_is_not_feasible(spark):
    alloc = spark.createDataFrame([("a", 50.0, 10.0, 10.0), ("b", 500.0, 10.0, 10.0)], "key string, Meta_Paid_Social double, Google_Paid_Search double, TikTok_Ads double")
    roas = budget.true_roas_row(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "key string, incremental_roas double"), by=["key"])
    got = {(r.key, r.channel): (r.feasible, r.sim_spend) for r in budget.reallocation(alloc, roas, 100.0, by=["key"]).collect()}
    assert got["a", "Meta_Paid_Social"] == (False, None) and got["a", "TikTok_Ads"] == (False, None)
    assert got["b", "Meta_Paid_Social"] == (True, 400.0) and got["b", "TikTok_Ads"] == (True, 60.0)
    grid = budget.scenario_grid(alloc, roas, n_steps=4, by=["key"])
    assert grid.count() == 2 * 5 * 3 * 3 and grid.filter("sim_spend < 0").count() == 0
    best = {r.key: r.shift_usd for r in budget.best_scenario(budget.scenario_summary(grid, by=["key"]), by=["key"]).collect()}
    assert best == {"a": 30.0, "b": 300.0}
    # a step count beyond the range of an int is no overflow
    big = spark.createDataFrame([(3e13, 1.0, 1.0)], "Meta_Paid_Social double, Google_Paid_Search double, TikTok_Ads double")
    one = budget.true_roas_row(spark.createDataFrame([(1.0,)], "incremental_roas double"))
    plan = budget.scenario_grid(big, one, step_usd=1e12)
    assert plan.count() == 19 * 9


def test_quality_checks_find_planted_faults(spark):
    rows = [(1, 1, "A"), (1, 2, "B"), (2, None, "Z"), (3, 4, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, channel string")
    assert [r.event_id for r in quality.check_not_null(df, ["user_id"]).collect()] == [2]
    assert [(r.event_id, r.occurrences) for r in quality.check_unique(df, ["event_id"]).collect()] == [(1, 2)]
    assert sorted(r.event_id for r in quality.check_accepted(df, "channel", ["A", "B"]).collect()) == [2, 3]
    counts = quality.null_counts(df).first()
    assert (counts["rows"], counts["null_user_id"], counts["null_channel"]) == (4, 1, 1)


# -------------------------------------------------------------- streaming ---

def test_replayed_epochs_are_counted_once(spark, tmp_path):
    from creditline.streaming.streams import incremental_daily_mart

    path = str(tmp_path / "mart")
    def batch(rows):
        return spark.createDataFrame([(datetime(2024, 1, d), c) for d, c in rows], "event_timestamp timestamp_ntz, channel string")

    upsert = incremental_daily_mart(None, path)
    upsert(batch([(1, "A")] * 5), 0)
    upsert(batch([(1, "A")] * 5), 0)
    upsert(batch([(1, "A"), (2, "B"), (1, "C")]), 1)
    upsert(batch([(1, "A"), (2, "B"), (1, "C")]), 1)

    def mart():
        return {(r.day, r.channel): r.touches for r in spark.read.parquet(path).collect()}

    want = {(date(2024, 1, 1), "A"): 6, (date(2024, 1, 2), "B"): 1, (date(2024, 1, 1), "C"): 1}
    assert mart() == want
    # a day that the failed attempt had not written yet is written by the replay
    upsert(batch([(3, "A")]), 2)
    upsert(batch([(3, "A"), (4, "A")]), 2)
    assert mart() == want | {(date(2024, 1, 3), "A"): 1, (date(2024, 1, 4), "A"): 1}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    for f in os.listdir(path):
        if f.startswith("day="):
            for part in os.listdir(os.path.join(path, f)):
                if part.endswith(".parquet"):
                    open(os.path.join(path, f, part), "wb").write(b"broken")
    with pytest.raises(Exception):
        upsert(batch([(1, "A")]), 3)


def test_dedup_keeps_the_smallest_id(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(3, 1, t, "A", "x"), (2, 1, t, "A", "y"), (9, 1, t, "B", "z")], TOUCH)
    assert sorted((r.event_id, r.dma_code) for r in dedup_touchpoints(df).collect()) == [(2, "y"), (9, "z")]
