"""Declared schemas of the raw inputs (no inference anywhere)."""

from pyspark.sql import types as T

RAW_TOUCHPOINTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("utm_source", T.StringType(), True),
    T.StructField("utm_medium", T.StringType(), True),
    T.StructField("campaign_name", T.StringType(), True),
    T.StructField("dma_code", T.StringType(), True),
])

RAW_CONVERSIONS = T.StructType([
    T.StructField("conversion_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("order_id", T.StringType(), True),
    T.StructField("converted_at", T.StringType(), False),
    T.StructField("order_value_usd", T.StringType(), False),
    T.StructField("dma_code", T.StringType(), True),
])

RAW_AD_SPEND = T.StructType([
    T.StructField("date", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("dma_code", T.StringType(), False),
    T.StructField("daily_spend_usd", T.StringType(), False),
    T.StructField("platform_reported_conversions", T.StringType(), False),
])

RAW_SCHEMAS = {
    "raw_user_touchpoints": RAW_TOUCHPOINTS,
    "raw_conversions": RAW_CONVERSIONS,
    "raw_ad_spend": RAW_AD_SPEND,
}

MONEY = T.DecimalType(18, 2)

STAGED_TOUCHPOINTS_COLUMNS = (
    "event_id", "user_id", "event_timestamp", "utm_source", "utm_medium", "utm_campaign", "channel", "dma_code",
)
STAGED_CONVERSIONS_COLUMNS = ("conversion_id", "user_id", "order_id", "converted_at", "order_value_usd", "dma_code")
STAGED_SPEND_COLUMNS = ("ad_date", "channel", "dma_code", "spend_usd", "platform_reported_conversions")
PAIR_COLUMNS = (
    "user_id", "event_id", "channel", "dma_code", "touchpoint_ts", "conversion_id", "conversion_ts", "order_value_usd",
)
