"""Spend-side reports: overview, attribution gap, daily spend, blended ROAS.

All outputs are aggregates of the spend and conversion tables; global numbers
are one-row aggregates combined with a one-row cross join (bounded by design).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.functions.columns import PAID_CHANNELS, PLATFORM_AOV, money, safe_ratio


def paid_spend(spend: DataFrame, channels: Sequence[str] = PAID_CHANNELS) -> DataFrame:
    """Paid-channel filter."""
    return spend.filter(F.col("channel").isin(*channels))


def overview(conversions: DataFrame, spend: DataFrame, platform_aov: float = PLATFORM_AOV, by: Sequence[str] = ()) -> DataFrame:
    """Headline numbers: spend, orders, claims, revenue, blended ROAS, overstatement."""
    s = paid_spend(spend).groupBy(*by).agg(
        F.sum("spend_usd").cast("double").alias("total_spend"),
        F.sum("platform_reported_conversions").cast("long").alias("total_platform_convs"),
    )
    c = conversions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_actual_convs"),
        F.sum("order_value_usd").cast("double").alias("total_revenue"),
    )
    j = s.join(c, list(by), "full_outer") if by else s.crossJoin(c)
    platform = safe_ratio(F.col("total_platform_convs") * F.lit(platform_aov), F.col("total_spend"))
    actual = safe_ratio(F.col("total_revenue"), F.col("total_spend"))
    return j.select(
        *by,
        F.round("total_spend", 2).alias("total_spend"),
        "total_actual_convs",
        "total_platform_convs",
        F.round("total_revenue", 2).alias("total_revenue"),
        F.round(platform, 2).alias("blended_platform_roas"),
        F.round(actual, 2).alias("blended_actual_roas"),
        F.round(safe_ratio((platform - actual) * 100.0, actual), 1).alias("overstatement_pct"),
    )


def platform_by_channel(spend: DataFrame, platform_aov: float = PLATFORM_AOV, by: Sequence[str] = ()) -> DataFrame:
    """Per paid channel: spend, claimed conversions and revenue, platform ROAS."""
    g = paid_spend(spend).groupBy(*by, "channel").agg(
        F.sum("spend_usd").alias("spend"),
        F.sum("platform_reported_conversions").cast("long").alias("platform_conversions"),
    )
    return g.select(
        *by,
        "channel",
        money(F.col("spend")).alias("spend"),
        "platform_conversions",
        (F.col("platform_conversions") * F.lit(platform_aov)).alias("platform_revenue"),
        F.round(safe_ratio(F.col("platform_conversions") * F.lit(platform_aov), F.col("spend")), 2).alias("platform_roas"),
    )


def attribution_gap(conversions: DataFrame, spend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Platform claims vs unique converters: gap and over-reporting rate.

    The order count is reported beside it; the gap's base is the people who converted."""
    claims = paid_spend(spend).groupBy(*by).agg(F.sum("platform_reported_conversions").cast("long").alias("platform_claimed_conversions"))
    per_user = conversions.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("_n"))
    actual = per_user.groupBy(*by).agg(
        F.sum("_n").alias("warehouse_conversions"), F.count("user_id").alias("unique_converters"))
    if not by:
        actual = actual.fillna(0)
    j = claims.join(actual, list(by), "left") if by else claims.crossJoin(actual)
    gap = F.col("platform_claimed_conversions") - F.col("unique_converters")
    return j.select(
        *by,
        "platform_claimed_conversions",
        "warehouse_conversions",
        "unique_converters",
        gap.alias("attribution_gap"),
        F.round(safe_ratio(gap * 100.0, F.col("unique_converters")), 1).alias("over_reporting_pct"),
    )


def platform_vs_attributed(
    spend: DataFrame, credits: DataFrame, model: str = "time_decay", platform_aov: float = PLATFORM_AOV, by: Sequence[str] = ()
) -> DataFrame:
    """Claimed revenue vs attributed revenue per paid channel."""
    p = platform_by_channel(spend, platform_aov, by)
    a = credits.select(*by, "channel", F.col(f"{model}_revenue").cast("double").alias("attributed_revenue"))
    return p.join(a, [*by, "channel"], "left").select(
        *by,
        "channel",
        F.col("platform_revenue").cast("double").alias("platform_revenue"),
        money(F.coalesce(F.col("attributed_revenue"), F.lit(0.0))).alias("attributed_revenue"),
        F.round(safe_ratio(F.col("platform_revenue"), F.col("attributed_revenue")), 2).alias("claimed_to_attributed"),
    )


def daily_spend(spend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Paid spend per (date, channel)."""
    return paid_spend(spend).groupBy(*by, "ad_date", "channel").agg(money(F.sum("spend_usd")).alias("daily_spend_usd"))


def blended_roas_rollup(spend: DataFrame, credits: DataFrame, model: str = "time_decay", by: Sequence[str] = ()) -> DataFrame:
    """Per-channel and blended (channel 'ALL') spend, revenue and ROAS.

    Blended ROAS = sum(revenue) / sum(spend) = spend-weighted mean of channel ROAS."""
    s = paid_spend(spend).groupBy(*by, "channel").agg(F.sum("spend_usd").cast("double").alias("spend"))
    r = credits.select(*by, "channel", F.col(f"{model}_revenue").cast("double").alias("revenue"))
    j = s.join(r, [*by, "channel"], "left").fillna({"revenue": 0.0})
    whole = [F.col(b) for b in by]
    g = j.groupingSets([[*whole, F.col("channel")], whole], *whole, F.col("channel")).agg(
        F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"), F.grouping_id().alias("_level"))
    return g.select(
        *by,
        F.when(F.col("_level") > 0, F.lit("ALL")).otherwise(F.col("channel")).alias("channel"),
        money(F.col("spend")).alias("spend"),
        money(F.col("revenue")).alias("attributed_revenue"),
        F.round(safe_ratio(F.col("revenue"), F.col("spend")), 2).alias("roas"),
    )


def week_of(ts: Column) -> Column:
    """Monday of a date or wall-clock timestamp, as a date; no time zone involved."""
    return F.trunc(ts.cast("date"), "week")


def weekly_blended_cac(spend: DataFrame, conversions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weekly blended CAC = paid spend / orders, weeks starting Monday."""
    keys = [*by, "week"]
    s = paid_spend(spend).groupBy(*by, week_of(F.col("ad_date")).alias("week")).agg(F.sum("spend_usd").cast("double").alias("spend"))
    c = conversions.groupBy(*by, week_of(F.col("converted_at")).alias("week")).agg(F.count(F.lit(1)).alias("conversions"))
    j = s.join(c, keys, "full_outer")
    return j.select(
        *by,
        F.date_format("week", "yyyy-MM-dd").alias("week"),
        money(F.coalesce(F.col("spend"), F.lit(0.0))).alias("spend"),
        F.coalesce(F.col("conversions"), F.lit(0)).cast("long").alias("conversions"),
        F.round(safe_ratio(F.col("spend"), F.col("conversions")), 2).alias("blended_cac"),
    )


def cohort_ltv(conversions: DataFrame) -> DataFrame:
    """Weekly acquisition cohorts: users, orders and cumulative revenue per week of life (I8).

    Cohort = week of a user's first order; the running sum is a window over the
    (cohort, age) aggregate, which is bounded by cohorts x ages, not by users."""
    first = conversions.groupBy("user_id").agg(F.min("converted_at").alias("_first"))
    c = conversions.join(first, "user_id").select(
        week_of(F.col("_first")).alias("cohort_week"),
        F.floor(F.datediff(F.col("converted_at"), F.col("_first")) / 7).cast("int").alias("age_weeks"),
        "user_id",
        "order_value_usd",
    )
    g = c.groupBy("cohort_week", "age_weeks").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_value_usd").cast("double").alias("revenue")
    )
    size = c.filter(F.col("age_weeks") == 0).groupBy("cohort_week").agg(F.countDistinct("user_id").alias("cohort_users"))
    w = Window.partitionBy("cohort_week").orderBy("age_weeks").rowsBetween(Window.unboundedPreceding, 0)
    out = g.join(size, "cohort_week").withColumn("cum_revenue", F.sum("revenue").over(w))
    return out.select(
        F.date_format("cohort_week", "yyyy-MM-dd").alias("cohort_week"),
        "age_weeks",
        F.col("cohort_users").cast("long").alias("cohort_users"),
        F.col("orders").cast("long").alias("orders"),
        money(F.col("revenue")).alias("revenue"),
        F.round(safe_ratio(F.col("cum_revenue"), F.col("cohort_users")), 2).alias("ltv_per_user"),
    )


def cac_payback(ltv: DataFrame, weekly_cac: DataFrame) -> DataFrame:
    """Weeks until a cohort's cumulative revenue per user covers its week's blended CAC (I8).

    ``ltv`` comes from ``cohort_ltv``, ``weekly_cac`` from ``weekly_blended_cac``.
    payback_weeks is NULL while the cohort has not paid back, or without a CAC."""
    cac = weekly_cac.select(F.col("week").alias("cohort_week"), "blended_cac")
    paid = F.when(F.col("ltv_per_user") >= F.col("blended_cac"), F.col("age_weeks"))
    return (
        ltv.join(cac, "cohort_week", "left").groupBy("cohort_week", "blended_cac", "cohort_users").agg(
            F.max_by("ltv_per_user", "age_weeks").alias("ltv_to_date"), F.min(paid).cast("int").alias("payback_weeks"))
        .select("cohort_week", "cohort_users", "blended_cac", "ltv_to_date", "payback_weeks")
    )
