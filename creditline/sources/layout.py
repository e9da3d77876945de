"""Physical layout of the touch table (A3): partitioned by month, bucketed by user and time
bucket, so that the lookback join reads only the months it needs and does not shuffle touches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.functions.columns import LOOKBACK_DAYS
from creditline.operators.journeys import DEFAULT_BUCKET_DAYS, _day_bucket

MONTH = "event_month"
BUCKET = "time_bucket"


def write_touches(touches: DataFrame, table: str, n_buckets: int = 64, bucket_days: int = DEFAULT_BUCKET_DAYS, path: str | None = None) -> None:
    """Save staged touches as ``table``: partitions of a month (``yyyy-MM``, null times apart), in each ``n_buckets`` files by
    (user_id, time bucket), sorted by time.  ``path`` makes it an external table."""
    rows = touches.withColumns({
        MONTH: F.date_format("event_timestamp", "yyyy-MM"), BUCKET: _day_bucket(F.col("event_timestamp"), bucket_days)})
    # one task per month and bucket, so that a bucket is one file
    rows = rows.repartition(n_buckets, "user_id", BUCKET)
    w = rows.write.mode("overwrite").format("parquet").partitionBy(MONTH).bucketBy(n_buckets, "user_id", BUCKET).sortBy("event_timestamp")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def pairs_from_layout(
    spark: SparkSession,
    table: str,
    conversions: DataFrame,
    start: date,
    end: date,
    lookback_days: int = LOOKBACK_DAYS,
    bucket_days: int = DEFAULT_BUCKET_DAYS,
    touch_cols: Sequence[str] = ("channel", "dma_code"),
) -> DataFrame:
    """``eligible_pairs`` of the orders from ``start`` to ``end`` (days, inclusive) with the touches of ``table``.

    Only the months that the orders' lookbacks reach are scanned.  The join's keys are the table's buckets, so
    touches are read in place and only orders are shuffled."""
    conv = conversions.where((F.to_date("converted_at") >= F.lit(start)) & (F.to_date("converted_at") <= F.lit(end)))
    begin = F.col("conversion_ts") - F.make_dt_interval(days=F.lit(int(lookback_days)))
    c = conv.select(F.col("user_id").alias("_c_user"), "conversion_id", F.col("converted_at").alias("conversion_ts"), "order_value_usd")
    c = c.withColumn("_c_bucket", F.explode(F.sequence(_day_bucket(begin, bucket_days), _day_bucket(F.col("conversion_ts"), bucket_days))))
    first = start - timedelta(days=lookback_days)
    t = spark.table(table).where(F.col(MONTH).between(first.strftime("%Y-%m"), end.strftime("%Y-%m")))
    t = t.select("user_id", "event_id", *touch_cols, F.col("event_timestamp").alias("touchpoint_ts"), BUCKET)
    ts = F.col("touchpoint_ts")
    on = (F.col("user_id") == F.col("_c_user")) & (F.col(BUCKET) == F.col("_c_bucket")) & (ts <= F.col("conversion_ts")) & (ts >= begin)
    return t.hint("merge").join(c, on).select(
        "user_id", "event_id", *touch_cols, "touchpoint_ts", "conversion_id", "conversion_ts", "order_value_usd")
