"""Derive the marketing inputs from the driver's tables.

The driver supplies ``events``, ``customer`` and ``nation``; this adapter turns
them into raw touchpoints, raw conversions, raw ad spend, market population and
the holdout-market list.  Every query reads these lazily, so the work grows with
the tables.  The same definitions are written as DuckDB SQL in
``creditline.plans.oracle``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.functions.columns import trunc_second

# ---------------------------------------------------------------------------
# Fixed values of the adapter (shared with the oracle SQL).
# Raw channel spelling by k % 10 (two spellings per canonical channel).
RAW_CHANNELS: tuple[str, ...] = (
    "meta_paid_social", " Meta ", "google_paid_search", "Google Paid Search", "tiktok_ads",
    "TIK TOK", "google_organic", "Organic", "email_crm", "CRM",
)
# Raw paid-channel name on the spend feed by (k % 10) div 2, for k % 10 < 6.
RAW_SPEND_CHANNELS: tuple[str, ...] = ("meta_paid_social", "google_paid_search", "tiktok_ads")
# Holdout (control) markets: nations with n_nationkey below this value.
HOLDOUT_NATION_LIMIT = 5
# Experiment window (inclusive calendar days); the paused channel is k % 10 in (0, 1).
EXPERIMENT_START = date(2024, 1, 16)
EXPERIMENT_END = date(2024, 1, 30)
# Duplicate injection: rows with event_id % 33 = 0 are re-sent under event_id + 1e9.
DUP_MODULUS = 33
DUP_ID_OFFSET = 1_000_000_000
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class MarketingInputs:
    raw_touchpoints: DataFrame
    raw_conversions: DataFrame
    raw_ad_spend: DataFrame
    population: DataFrame
    holdout_markets: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; files are listed anew on every call."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _window_filter(ts: Column) -> Column:
    return (ts >= F.lit(EXPERIMENT_START)) & (ts < F.lit(EXPERIMENT_END + timedelta(days=1)))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    markets = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey"), F.col("n_nationkey"), F.col("n_name").alias("dma_code")
    )
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.join(markets, events.user_id == markets.c_custkey).select(
        "event_id", "ts", "user_id", "event_type",
        F.col("value").cast("decimal(18,2)").alias("v"),
        k.alias("k"),
        "dma_code", "n_nationkey",
    )


def _paused(df: DataFrame) -> Column:
    """Paid Meta touch in a holdout market inside the experiment window."""
    return F.coalesce(
        (F.col("n_nationkey") < HOLDOUT_NATION_LIMIT) & _window_filter(F.col("ts")) & (F.col("k") % 10).isin(0, 1),
        F.lit(False),
    )


def _case_by(index: Column, values: tuple[str, ...]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def raw_touchpoints(base: DataFrame) -> DataFrame:
    """Non-purchase events; re-sent copies come from the same scan (no second read)."""
    kk = F.col("k") % 10
    event_id = F.col("event_id")
    sent = F.when(event_id % DUP_MODULUS == 0, F.array(event_id, event_id + F.lit(DUP_ID_OFFSET))).otherwise(F.array(event_id))
    return base.filter((F.col("event_type") != "purchase") & ~_paused(base)).select(
        F.explode(sent).alias("event_id"),
        "user_id",
        trunc_second("ts").alias("timestamp"),
        _case_by(kk, RAW_CHANNELS).alias("channel"),
        F.when(F.col("k") % 4 == 0, F.upper("event_type"))
        .when(F.col("k") % 4 == 1, F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
        .when(F.col("k") % 4 == 2, F.col("event_type"))
        .alias("utm_source"),
        F.when(kk < 6, F.when(F.col("k") % 2 == 0, F.lit("CPC")).otherwise(F.lit("cpc ")))
        .when(kk < 8, F.lit("organic"))
        .otherwise(F.lit("Email"))
        .alias("utm_medium"),
        F.when(F.col("k") % 5 == 4, F.lit(None).cast("string"))
        .when(F.col("k") % 2 == 0, F.concat(F.lit("Jan_"), F.upper("event_type")))
        .otherwise(F.concat(F.lit(" jan_"), F.col("event_type")))
        .alias("campaign_name"),
        "dma_code",
    )


def raw_conversions(base: DataFrame) -> DataFrame:
    return base.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("conversion_id"),
        "user_id",
        F.concat(F.lit("ORD_"), F.col("event_id").cast("string")).alias("order_id"),
        F.col("ts").alias("converted_at"),
        F.col("v").alias("order_value_usd"),
        "dma_code",
    )


def raw_ad_spend(base: DataFrame) -> DataFrame:
    kk = F.col("k") % 10
    paused = _paused(base)
    return (
        base.filter((F.col("event_type") != "purchase") & (kk < 6))
        .groupBy(
            F.to_date("ts").alias("date"),
            _case_by(F.floor(kk / 2), RAW_SPEND_CHANNELS).alias("channel"),
            "dma_code",
        )
        .agg(
            F.sum(F.when(paused, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("v"))).cast("decimal(18,2)").alias("daily_spend_usd"),
            F.sum(F.when(paused, F.lit(0)).otherwise(F.lit(1))).cast("int").alias("platform_reported_conversions"),
        )
    )


def market_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select("c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("dma_code"))
        .agg(F.count(F.lit(1)).alias("population"))
    )


def holdout_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    return nation.filter(F.col("n_nationkey") < HOLDOUT_NATION_LIMIT).select(F.col("n_name").alias("dma_code"))


def marketing_inputs(spark: SparkSession, sf_dir: str) -> MarketingInputs:
    """Lazy input plans for one dataset directory (nothing is kept between calls)."""
    base = _base(spark, sf_dir)
    return MarketingInputs(
        raw_touchpoints=raw_touchpoints(base),
        raw_conversions=raw_conversions(base),
        raw_ad_spend=raw_ad_spend(base),
        population=market_population(spark, sf_dir),
        holdout_markets=holdout_markets(spark, sf_dir),
    )
