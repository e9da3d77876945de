"""Readers and writers for the raw and layered tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.sources.schemas import RAW_SCHEMAS


def read_raw(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """Scan one raw table with its declared schema.

    CSV is read as strings with ``FAILFAST`` and typed by the staging layer;
    Parquet keeps the file's own (already typed) schema.
    """
    if fmt == "csv":
        return (
            spark.read.schema(RAW_SCHEMAS[table])
            .option("header", True)
            .option("mode", "FAILFAST")
            .csv(path)
        )
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def parse_timestamp(c: Column | str, fmt: str | None = None) -> Column:
    """String -> TIMESTAMP_NTZ (A2)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_timestamp_ntz(col, F.lit(fmt)) if fmt else F.to_timestamp_ntz(col)


def parse_date(c: Column | str, fmt: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.to_date(col, fmt) if fmt else F.to_date(col)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header line (A4)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_layer(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Materialise a mart as Parquet (A3); touchpoints go partitioned by date."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def register_layer(df: DataFrame, name: str) -> DataFrame:
    """Staging / intermediate layers are lazy views (A3)."""
    df.createOrReplaceTempView(name)
    return df


def extract_completed_orders(orders: DataFrame, start: date, end: date) -> DataFrame:
    """Completed orders in the half-open range [start, end) with warehouse names (A5)."""
    return (
        orders.filter((F.col("status") == "COMPLETED") & (F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))
        .select(
            F.col("order_id").alias("conversion_id"),
            "user_id",
            F.col("created_at").alias("converted_at"),
            F.col("total_usd").alias("order_value_usd"),
            "dma_code",
        )
    )


def extract_sessions(events: DataFrame, first_shard: str, last_shard: str, event_name: str = "session_start") -> DataFrame:
    """Sessions from a nested, date-sharded event export.

    The shard column (``event_date`` as ``yyyyMMdd``) is a partition column, so the
    range filter prunes files; struct fields are read with dot access.
    """
    return (
        events.filter(F.col("event_date").between(first_shard, last_shard) & (F.col("event_name") == event_name))
        .select(
            F.col("user_pseudo_id").alias("user_id"),
            F.timestamp_micros("event_timestamp").alias("event_timestamp"),
            F.col("traffic_source.source").alias("utm_source"),
            F.col("traffic_source.medium").alias("utm_medium"),
            F.col("geo.metro").alias("dma_code"),
        )
    )


def extract_daily_spend(spend: DataFrame, start: date, end: date) -> DataFrame:
    """Daily spend between two dates inclusive, ordered."""
    return spend.filter(F.col("date").between(F.lit(start), F.lit(end))).orderBy("date", "channel", "dma_code")
