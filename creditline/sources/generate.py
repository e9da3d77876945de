"""Seeded synthetic journeys as a Spark job.

Every random draw is a hash of (seed, id, salt), so results do not depend on
partitioning and the job scales with ``spark.range(n_users)``; touches come from
``explode(sequence(1, n))``, the spend grid from exploding dates and channels
per market (no cross join).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_CHANNELS = ("meta_paid_social", "google_paid_search", "tiktok_ads", "google_organic", "email_crm")
PAID = RAW_CHANNELS[:3]


@dataclass(frozen=True)
class Synthetic:
    touchpoints: DataFrame
    conversions: DataFrame
    ad_spend: DataFrame


def uniform(seed: int, salt: int, *cols: Column) -> Column:
    """Deterministic U[0, 1) from a 64-bit hash of (seed, salt, cols)."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *cols)
    return F.pmod(h, F.lit(1 << 31)).cast("double") / float(1 << 31)


def gen_journeys(
    spark: SparkSession,
    n_users: int,
    seed: int = 42,
    start: date = date(2026, 1, 1),
    days: int = 181,
    n_markets: int = 50,
    n_holdout: int = 10,
    pause_month: int = 6,
    dup_rate: float = 0.03,
    mix: tuple[float, float] = (0.20, 0.25),
) -> Synthetic:
    """Users are single-touch converters (mix[0]), multi-touch converters (mix[1])
    or browsers that never convert; Meta is paused in the first ``n_holdout``
    markets during ``pause_month`` (paused touches are re-routed to search)."""
    uid = F.col("id")
    users = spark.range(n_users).select(
        uid.alias("uid"),
        F.format_string("USR_%d", uid + 10_000).alias("user_id"),
        uniform(seed, 1, uid).alias("_u_type"),
        F.floor(uniform(seed, 2, uid) * n_markets).cast("int").alias("_m"),
        F.floor(uniform(seed, 3, uid) * (days - 10)).cast("int").alias("_day0"),
    )
    uid = F.col("uid")
    users = users.withColumn(
        "_type", F.when(F.col("_u_type") < mix[0], "single").when(F.col("_u_type") < mix[0] + mix[1], "multi").otherwise("browse")
    ).withColumn(
        "_n", F.when(F.col("_type") == "single", 1)
        .when(F.col("_type") == "multi", 2 + F.floor(uniform(seed, 4, uid) * 4).cast("int"))
        .otherwise(1 + F.floor(uniform(seed, 5, uid) * 3).cast("int"))
    ).withColumn("dma_code", F.format_string("DMA_%d", F.col("_m") + 100))

    t = users.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = [F.col("uid"), F.col("_k")]
    ts = (
        F.lit(start).cast("timestamp_ntz")
        + F.make_dt_interval(days=F.col("_day0") + F.col("_k") - 1)
        + F.make_dt_interval(secs=F.floor(uniform(seed, 6, *key) * 86_399).cast("decimal(10,0)"))
    )
    ch_idx = F.floor(uniform(seed, 7, *key) * len(RAW_CHANNELS)).cast("int")
    channel = F.element_at(F.array(*[F.lit(c) for c in RAW_CHANNELS]), ch_idx + 1)
    t = t.withColumn("timestamp", ts).withColumn("channel", channel)
    paused = (F.col("_m") < n_holdout) & (F.month("timestamp") == pause_month) & (F.col("channel") == "meta_paid_social")
    t = t.withColumn("channel", F.when(paused, F.lit("google_paid_search")).otherwise(F.col("channel")))
    touches = t.select(
        F.format_string("EVT_%d_%d", F.col("uid"), F.col("_k")).alias("event_id"),
        "user_id",
        "timestamp",
        "channel",
        F.when(uniform(seed, 8, *key) < 0.1, F.lit(None).cast("string")).otherwise(F.upper(F.split("channel", "_")[0])).alias("utm_source"),
        F.when(F.col("channel").isin(*PAID), "cpc").when(F.col("channel") == "email_crm", "email").otherwise("organic").alias("utm_medium"),
        F.when(uniform(seed, 9, *key) < 0.1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.date_format("timestamp", "MMM"), F.lit("_Promo"))).alias("campaign_name"),
        "dma_code",
        "_type",
    )
    dups = touches.filter((F.col("_type") == "multi") & (uniform(seed, 10, F.col("event_id")) < dup_rate)).withColumn(
        "event_id", F.concat(F.col("event_id"), F.lit("_dup"))
    )
    touchpoints = touches.unionByName(dups).drop("_type")

    buyers = users.filter(F.col("_type") != "browse")
    u1, u2 = uniform(seed, 11, F.col("uid")), uniform(seed, 12, F.col("uid"))
    z = F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * math.pi * u2)
    conversions = buyers.select(
        F.format_string("CNV_%d", F.col("uid")).alias("conversion_id"),
        "user_id",
        F.format_string("ORD_%d", F.col("uid") + 100_000).alias("order_id"),
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("_day0") + F.col("_n"), hours=F.lit(12))).alias("converted_at"),
        F.round(F.exp(F.lit(4.2) + F.lit(0.6) * z), 2).cast("decimal(18,2)").alias("order_value_usd"),
        "dma_code",
    )

    markets = spark.range(n_markets).select(F.col("id").cast("int").alias("_m"))
    grid = markets.select(
        "_m",
        F.explode(F.sequence(F.lit(start), F.lit(start + timedelta(days=days - 1)))).alias("date"),
    ).select("_m", "date", F.explode(F.array(*[F.lit(c) for c in PAID])).alias("channel"))
    gk = [F.col("_m"), F.col("date").cast("string"), F.col("channel")]
    spend_val = F.round(F.lit(50.0) + uniform(seed, 13, *gk) * 250.0, 2)
    paused_cell = (F.col("_m") < n_holdout) & (F.month("date") == pause_month) & (F.col("channel") == "meta_paid_social")
    spend = F.when(paused_cell, F.lit(0.0)).otherwise(spend_val)
    inflation = F.lit(1.25) + uniform(seed, 14, *gk) * 0.20
    ad_spend = grid.select(
        "date",
        "channel",
        F.format_string("DMA_%d", F.col("_m") + 100).alias("dma_code"),
        spend.cast("decimal(18,2)").alias("daily_spend_usd"),
        (spend / F.lit(40.0) * inflation).cast("int").alias("platform_reported_conversions"),
    )
    return Synthetic(touchpoints, conversions, ad_spend)
