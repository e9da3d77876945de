"""Hand-made edge rows (FIXTURES.md section 4)."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditline.functions.columns import canonical_channel, pg_initcap
from creditline.operators import geo
from creditline.operators.attribution import attribute, attribution_comparison
from creditline.operators.journeys import dedup_touchpoints, eligible_pairs, unattributed_conversions
from creditline.operators.staging import stage_touchpoints

TOUCH_SCHEMA = "event_id long, user_id long, event_timestamp timestamp_ntz, channel string, dma_code string"
CONV_SCHEMA = "conversion_id long, user_id long, converted_at timestamp_ntz, order_value_usd decimal(18,2), dma_code string"
C = datetime(2024, 3, 31, 12, 0, 0)


def touches(spark, rows):
    return spark.createDataFrame(rows, TOUCH_SCHEMA)


def convs(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(a, b, c, Decimal(str(d)), e) for a, b, c, d, e in rows], CONV_SCHEMA)


def test_lookback_boundaries(spark):
    t = touches(spark, [
        (1, 7, C, "Email_CRM", "M"),                              # at conversion: kept
        (2, 7, C - timedelta(days=90), "Email_CRM", "M"),         # exactly 90 d before: kept
        (3, 7, C - timedelta(days=90, seconds=1), "Email_CRM", "M"),
        (4, 7, C + timedelta(seconds=1), "Email_CRM", "M"),       # after: dropped
    ])
    c = convs(spark, [(100, 7, C, 10.0, "M")])
    for bucket in (1, 7, 30, 90):
        got = sorted(r.event_id for r in eligible_pairs(t, c, 90, bucket).collect())
        assert got == [1, 2], bucket


def test_dedup_keeps_smallest_id_after_canonicalisation(spark):
    ts = datetime(2024, 1, 1, 10, 0, 0)
    raw = spark.createDataFrame(
        [(3, 1, ts, "meta"), (1, 1, ts, "META "), (2, 1, ts, "facebook"), (4, 1, ts, "snapchat_ads")],
        "event_id long, user_id long, timestamp timestamp_ntz, channel string",
    ).withColumn("utm_source", F.lit(None).cast("string")).withColumn("utm_medium", F.lit("cpc")) \
     .withColumn("campaign_name", F.lit(None).cast("string")).withColumn("dma_code", F.lit(" X "))
    staged = stage_touchpoints(raw)
    out = sorted((r.event_id, r.channel, r.dma_code) for r in dedup_touchpoints(staged).collect())
    assert out == [(1, "Meta_Paid_Social", "X"), (4, "Snapchat_Ads", "X")]
    dropped = stage_touchpoints(raw, on_unknown="drop")
    assert sorted(r.channel for r in dropped.collect()) == ["Meta_Paid_Social"] * 3


def test_pg_initcap(spark):
    vals = ["snapchat_ads", "x-y z", "ABC", "tik tok", "a1b2_c", ""]
    df = spark.createDataFrame([(v,) for v in vals], "s string").select(pg_initcap("s").alias("o"))
    assert [r.o for r in df.collect()] == ["Snapchat_Ads", "X-Y Z", "Abc", "Tik Tok", "A1b2_C", ""]
    ch = spark.createDataFrame([(" Meta ",), ("Google Paid Search",), ("CRM",), (None,)], "c string")
    assert [r.o for r in ch.select(canonical_channel("c").alias("o")).collect()] == [
        "Meta_Paid_Social", "Google_Paid_Search", "Email_CRM", None]


def test_null_user_collapses_and_vanishes(spark):
    ts = datetime(2024, 3, 30)
    t = touches(spark, [(1, None, ts, "Email_CRM", "M"), (2, None, ts, "Email_CRM", "M")])
    d = dedup_touchpoints(t)
    assert d.count() == 1
    c = convs(spark, [(100, 7, C, 10.0, "M")])
    assert eligible_pairs(d, c).count() == 0


def _credits(spark, t_rows, c_rows, **kw):
    pairs = eligible_pairs(touches(spark, t_rows), convs(spark, c_rows))
    return {r.channel: r for r in attribute(pairs, **kw).collect()}


def test_scope_differs_with_two_orders(spark):
    d = lambda h: C - timedelta(hours=h)
    t_rows = [(1, 7, d(50), "A", "M"), (2, 7, d(30), "B", "M"), (3, 7, d(5), "C", "M")]
    c_rows = [(100, 7, d(20), 100.0, "M"), (101, 7, C, 50.0, "M")]
    conv = _credits(spark, t_rows, c_rows)
    user = _credits(spark, t_rows, c_rows, scope="user")
    assert float(conv["A"].first_touch_revenue) == 150.0
    assert float(user["A"].first_touch_revenue) == 100.0   # first pair of the user journey (order 100)
    assert sum(float(r.linear_revenue) for r in conv.values()) == pytest.approx(150.0)
    # user scope splits every pair's order value over all 5 pairs of the user: (2*100 + 3*50) / 5
    assert sum(float(r.linear_revenue) for r in user.values()) == pytest.approx(70.0)


def test_same_timestamp_tiebreak_on_event_id(spark):
    ts = C - timedelta(days=1)
    cr = _credits(spark, [(5, 7, ts, "B", "M"), (4, 7, ts, "A", "M")], [(100, 7, C, 10.0, "M")])
    assert float(cr["A"].first_touch_revenue) == 10.0
    assert float(cr["B"].last_touch_revenue) == 10.0
    assert float(cr["A"].position_based_revenue) == pytest.approx(5.0)


def test_orphan_conversion(spark):
    t = touches(spark, [(1, 7, C - timedelta(days=1), "A", "M")])
    c = convs(spark, [(100, 7, C, 10.0, "M"), (101, 8, C, 20.0, "M")])
    assert [r.conversion_id for r in unattributed_conversions(c, eligible_pairs(t, c)).collect()] == [101]


def test_zero_spend_and_organic_channel(spark):
    t = touches(spark, [(1, 7, C - timedelta(days=1), "Meta_Paid_Social", "M"), (2, 8, C - timedelta(days=2), "Email_CRM", "M")])
    c = convs(spark, [(100, 7, C, 10.0, "M"), (101, 8, C, 20.0, "M")])
    credits = attribute(eligible_pairs(t, c))
    spend = spark.createDataFrame(
        [(date(2024, 3, 1), "Meta_Paid_Social", "M", 0, 3)],
        "ad_date date, channel string, dma_code string, spend_usd int, platform_reported_conversions int",
    ).withColumn("spend_usd", F.col("spend_usd").cast("decimal(18,2)"))
    by_spend = {r.channel: r for r in attribution_comparison(credits, spend).collect()}
    assert set(by_spend) == {"Meta_Paid_Social"}
    assert by_spend["Meta_Paid_Social"].time_decay_roas is None
    assert by_spend["Meta_Paid_Social"].platform_reported_roas is None
    by_credit = {r.channel: r for r in attribution_comparison(credits, spend, keep="credit").collect()}
    assert set(by_credit) == {"Meta_Paid_Social", "Email_CRM"}
    assert by_credit["Email_CRM"].total_spend_usd is None and by_credit["Email_CRM"].linear_roas is None


def _groups(spark, rows):
    return spark.createDataFrame(rows, "dma_code string, arm string, conversions long, revenue_usd double, population long")


def test_window_end_midnight(spark):
    c = convs(spark, [(1, 1, datetime(2026, 6, 30, 12), 5.0, "A"), (2, 1, datetime(2026, 6, 1), 5.0, "A")])
    pop = spark.createDataFrame([("A", 100)], "dma_code string, population long")
    ctrl = spark.createDataFrame([("B",)], "dma_code string")
    strict = geo.geo_groups(c, pop, ctrl, date(2026, 6, 1), date(2026, 6, 30), end_inclusive_day=False).collect()
    full = geo.geo_groups(c, pop, ctrl, date(2026, 6, 1), date(2026, 6, 30)).collect()
    assert strict[0].conversions == 1 and full[0].conversions == 2
    empty = geo.geo_groups(c, pop.union(spark.createDataFrame([("B", 50)], pop.schema)), ctrl,
                           date(2026, 6, 1), date(2026, 6, 30)).collect()
    assert [r.dma_code for r in empty] == ["A"]          # market without window conversions drops out


def test_icac_infinite_when_no_lift(spark):
    g = _groups(spark, [("C", "control", 50, 500.0, 100), ("T", "treatment", 40, 400.0, 100)])
    s = spark.createDataFrame([(1000.0,)], "treatment_spend_usd double")
    r = geo.geo_incrementality(g, s).first()
    assert r.incremental_conversions == -10.0
    assert r.incremental_cac_usd == float("inf")
    assert r.incremental_lift_pct == -20.0 and r.organic_share_pct == 120.0


def test_z_null_when_pooled_above_one(spark):
    g = _groups(spark, [("C", "control", 150, 1.0, 100), ("T", "treatment", 140, 1.0, 100)])
    r = geo.two_proportion_z(g).first()
    assert r.z_score is None and r.p_value is None


def test_z_antisymmetric(spark):
    g = _groups(spark, [("C", "control", 30, 1.0, 1000), ("T", "treatment", 45, 1.0, 1200)])
    flipped = g.withColumn("arm", F.when(F.col("arm") == "control", "treatment").otherwise("control"))
    a, b = geo.two_proportion_z(g).first(), geo.two_proportion_z(flipped).first()
    assert a.z_score == -b.z_score and a.p_value == b.p_value


def test_reference_formula_identities(spark):
    # iCAC = 60,000 / 471 = 127.39 ; iROAS = 75,600 / 60,000 = 1.26 ; lift 471 / 8,420 = 5.6 %
    g = _groups(spark, [("C", "control", 842, 842.0 * 10, 10_000), ("T", "treatment", 8_891, 75_600.0 / 471 * 8_891, 100_000)])
    s = spark.createDataFrame([(60_000.0,)], "treatment_spend_usd double")
    r = geo.geo_incrementality(g, s).first()
    assert r.expected_baseline_conversions == 8420.0 and r.incremental_conversions == 471.0
    assert r.incremental_cac_usd == 127.39
    assert r.incremental_roas == 1.26
    assert r.incremental_lift_pct == 5.6
    row = spark.range(1).select(geo.overstatement(F.lit(11_000.0), F.lit(8_200.0), "true").alias("o")).first()
    assert round(row.o) == 34
