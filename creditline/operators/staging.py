"""Staging layer: typed, renamed, canonicalised inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.functions.columns import (
    CHANNEL_ALIASES,
    DISPLAY_NAMES,
    SPEND_ALIASES,
    canonical_channel,
    mapped_value,
    normalise_text,
)

def _ts(c: str):
    return F.col(c).cast("timestamp_ntz")


def stage_touchpoints(
    df: DataFrame,
    channel_map: Mapping[str, Sequence[str]] = CHANNEL_ALIASES,
    on_unknown: str = "initcap",
) -> DataFrame:
    """Typed touchpoints with normalised UTM fields and canonical channels.

    ``on_unknown='drop'`` removes channels outside the map (dashboard semantics).
    """
    out = df.select(
        F.col("event_id"),
        F.col("user_id"),
        _ts("timestamp").alias("event_timestamp"),
        normalise_text("utm_source").alias("utm_source"),
        normalise_text("utm_medium").alias("utm_medium"),
        normalise_text("campaign_name").alias("utm_campaign"),
        canonical_channel("channel", channel_map, on_unknown).alias("channel"),
        F.trim(F.col("dma_code")).alias("dma_code"),
    )
    if on_unknown == "drop":
        out = out.filter(F.col("channel").isNotNull())
    return out


def stage_touchpoints_display(df: DataFrame, display_names: Mapping[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Dashboard staging (B5): exact lookup of lower/strip(channel) to a display
    label; rows whose channel is not in the map are dropped.  The time column is
    named ``event_timestamp``, as the dedup and pair operators expect."""
    key = F.regexp_replace(F.lower(F.col("channel")), r"^\s+|\s+$", "")
    return (
        df.withColumn("channel", mapped_value(key, display_names))
        .filter(F.col("channel").isNotNull())
        .withColumn("timestamp", _ts("timestamp"))
        .withColumnRenamed("timestamp", "event_timestamp")
    )


def stage_conversions(df: DataFrame) -> DataFrame:
    """Typed conversions, trimmed market code."""
    return df.select(
        "conversion_id",
        "user_id",
        "order_id",
        _ts("converted_at").alias("converted_at"),
        F.col("order_value_usd").cast("decimal(18,2)").alias("order_value_usd"),
        F.trim(F.col("dma_code")).alias("dma_code"),
    )


def stage_spend(df: DataFrame) -> DataFrame:
    """Typed spend with canonical paid-channel names (B1)."""
    return df.select(
        F.col("date").cast("date").alias("ad_date"),
        canonical_channel("channel", SPEND_ALIASES, "initcap").alias("channel"),
        F.trim(F.col("dma_code")).alias("dma_code"),
        F.col("daily_spend_usd").cast("decimal(18,2)").alias("spend_usd"),
        F.col("platform_reported_conversions").cast("int").alias("platform_reported_conversions"),
    )


def fill_missing_utm(df: DataFrame, cols: Sequence[str] = ("utm_source", "utm_medium", "utm_campaign"), value: str = "(not set)") -> DataFrame:
    """Replace missing UTM values with a marker."""
    return df.fillna({c: value for c in cols})


def with_label(df: DataFrame, name: str, value: str) -> DataFrame:
    """Constant label column, e.g. arm or model name."""
    return df.withColumn(name, F.lit(value))
