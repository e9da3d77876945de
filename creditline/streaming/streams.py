"""Structured Streaming variants.

* N1 ``stream_dedup``: watermark + ``dropDuplicatesWithinWatermark``.  The
  survivor is the first row to *arrive*, not the smallest event_id as in the
  batch dedup: a stream cannot wait for a smaller id that may never come.
  ``stream_dedup_smallest`` waits instead: it gives the batch survivor once the
  watermark has passed the touch.
* N2 ``stream_pairs``: stream-stream inner join on user_id with the lookback
  range as the time constraint; both sides are watermarked so join state is
  bounded by the lookback (use the RocksDB state store at scale).
  ``stream_unattributed`` is its left outer counterpart (D8): orders without an
  eligible touch, once no touch of theirs can arrive any more.
* N3 ``campaign_monitor`` / ``user_sessions``: tumbling/sliding windows per
  channel and session windows per user, append mode.
* N4 ``incremental_daily_mart``: ``foreachBatch`` that re-aggregates only the
  days touched by each micro-batch and overwrites those day partitions.

Checkpoints live under the session's ``spark.checkpoint.dir`` (a shared folder
on a cluster); nothing is written to a machine-local temp folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from creditline.functions.columns import LOOKBACK_DAYS
from creditline.session import checkpoint_dir


def checkpoint_location(spark: SparkSession, name: str) -> str:
    root = checkpoint_dir(spark)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; streaming checkpoints need a shared folder")
    return f"{root.rstrip('/')}/streams/{name}"


def touch_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming file source of staged touchpoints (Parquet, explicit schema)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; staged tables carry TIMESTAMP_NTZ (UTC wall clock)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(
    touches: DataFrame,
    watermark: str = "1 hour",
    keys: Sequence[str] = ("user_id", "event_timestamp", "channel"),
    ts: str = "event_timestamp",
) -> DataFrame:
    """Drop re-sent touches within the watermark."""
    out = _event_time(touches, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))
    return out.withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def stream_dedup_smallest(
    touches: DataFrame,
    watermark: str = "1 hour",
    keys: Sequence[str] = ("user_id", "event_timestamp", "channel"),
    ts: str = "event_timestamp",
    order: str = "event_id",
) -> DataFrame:
    """One touch per duplicate key, the one with the smallest ``order``, as the batch dedup keeps.

    An aggregate in append mode: state holds one row per key, and a key is emitted, and its state
    dropped, when the watermark passes its time.  Copies that arrive within the watermark may come in any order.
    Touches without a time are never emitted."""
    if ts not in keys:
        raise ValueError("the event time must be one of the keys, as it ends their state")
    rest = [c for c in touches.columns if c not in keys and c != order]
    survivor = F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_s")
    out = _event_time(touches, ts).withWatermark(ts, watermark).groupBy(*keys).agg(survivor)
    return out.select(*[(F.col(ts).cast("timestamp_ntz").alias(ts) if c == ts else F.col(c) if c in keys else F.col(f"_s.{c}").alias(c)) for c in touches.columns])


def stream_unattributed(
    touches: DataFrame,
    conversions: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    touch_watermark: str | None = None,
    conversion_watermark: str = "1 day",
) -> DataFrame:
    """Orders without an eligible touch (D8 on a stream): a left outer stream-stream join whose unmatched
    rows come out once, when both watermarks rule out any touch of theirs.

    State is bounded by the lookback; at scale use the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    tw = touch_watermark or f"{lookback_days + 1} days"
    t = touches.select(F.col("user_id").alias("_t_user"), F.col("event_timestamp").cast("timestamp").alias("touchpoint_ts")).withWatermark("touchpoint_ts", tw)
    c = conversions.select("user_id", "conversion_id", F.col("converted_at").cast("timestamp").alias("conversion_ts"), "order_value_usd")
    c = c.withWatermark("conversion_ts", conversion_watermark)
    cond = (
        (F.col("user_id") == F.col("_t_user"))
        & (F.col("touchpoint_ts") <= F.col("conversion_ts"))
        & (F.col("touchpoint_ts") >= F.col("conversion_ts") - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    )
    return c.join(t, cond, "leftOuter").where("touchpoint_ts is null").select(
        "user_id", "conversion_id", F.col("conversion_ts").cast("timestamp_ntz").alias("conversion_ts"), "order_value_usd")


def stream_pairs(
    touches: DataFrame,
    conversions: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    touch_watermark: str | None = None,
    conversion_watermark: str = "1 day",
    dedup: bool = True,
) -> DataFrame:
    """Eligible (touch, order) pairs as a stream-stream join (N2), with the N1
    dedup applied under the same touch watermark (a stream may define only one).

    The touch watermark must cover the lookback, otherwise touches leave the
    state before the orders they could be credited to arrive."""
    tw = touch_watermark or f"{lookback_days + 1} days"
    t = touches.select(
        "user_id", "event_id", "channel", "dma_code", F.col("event_timestamp").cast("timestamp").alias("touchpoint_ts")
    ).withWatermark("touchpoint_ts", tw)
    if dedup:
        t = t.dropDuplicatesWithinWatermark(["user_id", "touchpoint_ts", "channel"])
    c = conversions.select(
        F.col("user_id").alias("_c_user"), "conversion_id", F.col("converted_at").cast("timestamp").alias("conversion_ts"),
        "order_value_usd",
    ).withWatermark("conversion_ts", conversion_watermark)
    cond = (
        (F.col("user_id") == F.col("_c_user"))
        & (F.col("touchpoint_ts") <= F.col("conversion_ts"))
        & (F.col("touchpoint_ts") >= F.col("conversion_ts") - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    )
    return t.join(c, cond).select(
        "user_id", "event_id", "channel", "dma_code", F.col("touchpoint_ts").cast("timestamp_ntz").alias("touchpoint_ts"),
        "conversion_id", F.col("conversion_ts").cast("timestamp_ntz").alias("conversion_ts"), "order_value_usd",
    )


def campaign_monitor(
    touches: DataFrame,
    window: str = "1 hour",
    slide: str | None = None,
    watermark: str = "2 hours",
    ts: str = "event_timestamp",
) -> DataFrame:
    """Touches and distinct users per channel per (tumbling or sliding) window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        _event_time(touches, ts).withWatermark(ts, watermark)
        .groupBy(w.alias("window"), "channel")
        .agg(F.count(F.lit(1)).alias("touches"), F.approx_count_distinct("user_id").alias("approx_users"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "channel", "touches", "approx_users")
    )


def revenue_monitor(
    orders: DataFrame,
    key: str = "channel",
    window: str = "1 hour",
    slide: str | None = None,
    watermark: str = "2 hours",
    ts: str = "converted_at",
    value: str = "order_value_usd",
) -> DataFrame:
    """Orders and revenue per ``key`` and (tumbling or sliding) window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        _event_time(orders, ts).withWatermark(ts, watermark)
        .groupBy(w.alias("window"), key)
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(value).alias("revenue_usd"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "orders", "revenue_usd")
    )


def user_sessions(touches: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours", ts: str = "event_timestamp") -> DataFrame:
    """Session windows per user: touches and distinct channels per session.

    The channel set of a session is bounded by the channel list."""
    return (
        _event_time(touches, ts).withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("session"), "user_id")
        .agg(F.count(F.lit(1)).alias("touches"), F.size(F.collect_set("channel")).cast("long").alias("channels"))
        .select("user_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "touches", "channels")
    )


def daily_channel_aggregate(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("event_timestamp").alias("day"), "channel").agg(F.count(F.lit(1)).alias("touches"))


MART = "channel string, touches bigint, epochs map<string,bigint>, day date"


def _mart(spark: SparkSession, path: str) -> DataFrame | None:
    """The mart so far; None if it is not there yet."""
    try:
        return spark.read.schema(MART).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def incremental_daily_mart(touches: DataFrame, mart_path: str, query_id: str | None = None):
    """``foreachBatch`` function for N4: per micro-batch, read the mart's rows of the
    affected days, add the batch, re-aggregate, and overwrite just those day
    partitions (dynamic partition overwrite).

    Every day partition carries a ledger: the last epoch of each query that changed it.  A replayed
    epoch skips the days that already have it, so a batch that failed half-way and runs
    again is counted once; a query with a new checkpoint is another query, whose epochs count from
    0 again.  ``query_id`` defaults to the running stream's.  Touches without a time are a day of their own.
    A read that fails fails the batch: only a mart that is not there yet starts empty."""

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        query = query_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        new = daily_channel_aggregate(batch).withColumn("epochs", F.create_map(F.lit(query), F.lit(epoch_id).cast("long")))
        mart = _mart(spark, mart_path)
        if mart is not None:
            days = new.select(F.col("day").alias("_day")).distinct()
            old = mart.join(days, F.col("day").eqNullSafe(F.col("_day")), "left_semi")
            # all rows of a day carry the same ledger
            ledger = old.groupBy(F.col("day").alias("_day")).agg(F.any_value("epochs").alias("ledger"))
            rows = old.unionByName(new).join(ledger, F.col("day").eqNullSafe(F.col("_day")), "left")
            known = F.coalesce(F.element_at("ledger", F.lit(query)), F.lit(-1))
            after = F.map_concat(F.map_filter(F.coalesce("ledger", F.expr("map()").cast("map<string,bigint>")), lambda q, e: q != F.lit(query)),
                                 F.create_map(F.lit(query), F.lit(epoch_id).cast("long")))
            new = rows.where(known < epoch_id).groupBy("day", "channel").agg(F.sum("touches").alias("touches"), F.any_value(after).alias("epochs"))
        # cut lineage to the old partitions before overwriting them
        new = new.select("channel", "touches", "epochs", "day").checkpoint(eager=True)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(mart_path)

    return upsert


def start(
    df: DataFrame,
    name: str,
    sink_path: str,
    mode: str = "append",
    fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Start a stream into a file sink with its checkpoint under spark.checkpoint.dir."""
    w = df.writeStream.queryName(name).outputMode(mode).format(fmt).option(
        "checkpointLocation", checkpoint_location(df.sparkSession, name)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink_path)


def start_foreach_batch(df: DataFrame, name: str, fn, available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.queryName(name).option("checkpointLocation", checkpoint_location(df.sparkSession, name)).foreachBatch(fn)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
