"""Touch deduplication and the causal lookback join.

Scale notes
-----------
* Dedup is an aggregate, not a window: copies of one touch collapse in the
  map-side partial aggregate, so even a group of copies holding a third of all
  rows never reaches one task whole.
* The touch -> order join is an equi-join on ``(user_id, time bucket)``:
  each order is exploded into the ``ceil(lookback / bucket) + 1`` buckets its
  window covers, each touch falls in exactly one bucket.  This bounds candidate
  fan-out to touches within ~one bucket of the window, and spreads a heavy
  user's history over many join keys (AQE skew-join splitting is the second
  line of defence).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.functions.columns import LOOKBACK_DAYS, days_between, wall_micros

DEFAULT_BUCKET_DAYS = 7


def dedup_touchpoints(
    df: DataFrame,
    keys: Sequence[str] = ("user_id", "event_timestamp", "channel"),
    order: str = "event_id",
) -> DataFrame:
    """Keep, per duplicate key, the row with the smallest ``order`` value (F1/F2).

    The survivor is deterministic (never a bare ``dropDuplicates``)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != order]
    survivor = F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_s")
    return df.groupBy(*keys).agg(survivor).select(
        *[F.col(f"_s.{c}").alias(c) if c not in keys else F.col(c) for c in df.columns]
    )


def _day_bucket(ts: Column, bucket_days: int) -> Column:
    return F.floor(F.unix_date(F.to_date(ts)) / F.lit(bucket_days)).cast("long")


def eligible_pairs(
    touches: DataFrame,
    conversions: DataFrame,
    lookback_days: int | None = LOOKBACK_DAYS,
    bucket_days: int = DEFAULT_BUCKET_DAYS,
    touch_cols: Sequence[str] = ("channel", "dma_code"),
) -> DataFrame:
    """Touch/order pairs with ``conv_ts - lookback <= touch_ts <= conv_ts``.

    ``lookback_days=None`` keeps the causal guard only (README variant)."""
    t = touches.select(
        "user_id", "event_id", *touch_cols, F.col("event_timestamp").alias("touchpoint_ts")
    )
    c = conversions.select(
        F.col("user_id").alias("_c_user"),
        "conversion_id",
        F.col("converted_at").alias("conversion_ts"),
        "order_value_usd",
    )
    causal = F.col("touchpoint_ts") <= F.col("conversion_ts")
    if lookback_days is None:
        joined = t.join(c, (F.col("user_id") == F.col("_c_user")) & causal)
    else:
        start = F.col("conversion_ts") - F.make_dt_interval(days=F.lit(int(lookback_days)))
        t = t.withColumn("_bucket", _day_bucket(F.col("touchpoint_ts"), bucket_days))
        c = c.withColumn(
            "_c_bucket",
            F.explode(F.sequence(_day_bucket(start, bucket_days), _day_bucket(F.col("conversion_ts"), bucket_days))),
        )
        joined = t.join(
            c,
            (F.col("user_id") == F.col("_c_user"))
            & (F.col("_bucket") == F.col("_c_bucket"))
            & causal
            & (F.col("touchpoint_ts") >= start),
        )
    return joined.select(
        "user_id", "event_id", *touch_cols, "touchpoint_ts", "conversion_id", "conversion_ts", "order_value_usd"
    )


def unattributed_conversions(conversions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Orders with no eligible touch (D8): anti join on the distinct conversion ids
    of the pairs, which the map-side aggregate reduces before any shuffle."""
    return conversions.join(pairs.select("conversion_id").distinct(), "conversion_id", "left_anti")


def near_duplicates_removed(
    df: DataFrame,
    within_seconds: float = 1.0,
    keys: Sequence[str] = ("user_id", "channel"),
    ts: str = "event_timestamp",
    order: str = "event_id",
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Drop a touch when the previous touch of the same ``keys`` (in (ts, order)
    order) lies at most ``within_seconds`` before it (F3).

    ``lag`` runs per (keys, time bucket) so one heavy key is split over many
    window partitions; the first touch of a bucket is compared with the last
    touch of the previous bucket through a per-bucket aggregate.
    ``bucket_seconds`` must be >= ``within_seconds``."""
    if bucket_seconds < within_seconds:
        raise ValueError("bucket_seconds must be >= within_seconds")
    keys = list(keys)
    micros = wall_micros(ts)
    b = F.floor(micros / F.lit(bucket_seconds * 1_000_000)).cast("long")
    x = df.withColumn("_b", b).withColumn("_us", micros)
    w = Window.partitionBy(*keys, "_b").orderBy("_us", order)
    x = x.withColumn("_prev_us", F.lag("_us").over(w))
    last_in_bucket = x.groupBy(*keys, "_b").agg(F.max("_us").alias("_bucket_last_us"))
    last_in_bucket = last_in_bucket.select(*[F.col(k).alias(f"_last_{k}") for k in keys], (F.col("_b") + 1).alias("_next_b"), "_bucket_last_us")
    same = F.col("_b") == F.col("_next_b")
    for k in keys:  # null keys are one group, in the window and here
        same = same & F.col(k).eqNullSafe(F.col(f"_last_{k}"))
    x = x.join(last_in_bucket, same, "left")
    prev = F.coalesce(F.col("_prev_us"), F.col("_bucket_last_us"))
    keep = prev.isNull() | ((F.col("_us") - prev) > F.lit(int(within_seconds * 1_000_000)))
    return x.filter(keep).select(*df.columns)


def touch_timeline(touches: DataFrame, bucket_hours: int = 1) -> DataFrame:
    """Touches with their place in the user's timeline: ``_rank`` and the previous
    and next touch's channel and time, in (time, event_id) order.

    ``lag``/``lead`` run per (user, time bucket).  Only one row per bucket goes
    through a per-user window that links buckets and adds up ranks; its rows are
    bounded by the hours of the data, not by the user's traffic."""
    x = touches.select(
        "user_id", "event_id", "channel", "event_timestamp",
        F.floor(wall_micros("event_timestamp") / F.lit(bucket_hours * 3_600_000_000)).cast("long").alias("_b"),
    )
    w = Window.partitionBy("user_id", "_b").orderBy("event_timestamp", "event_id")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("channel", F.col("event_timestamp").alias("ts"))
    x = x.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.lag(here).over(w).alias("_prev"),
        F.lead(here).over(w).alias("_next"),
        F.count(F.lit(1)).over(ends).alias("_cnt"),
        F.last(here).over(ends).alias("_last"),
    )
    heads = x.filter(F.col("_rn") == 1).select("user_id", "_b", "_cnt", F.struct("channel", F.col("event_timestamp").alias("ts")).alias("_first"), "_last")
    w_user = Window.partitionBy("user_id").orderBy("_b")
    heads = heads.select(
        F.col("user_id").alias("_user"), F.col("_b").alias("_bucket"),
        F.lag("_last").over(w_user).alias("_before"),
        F.lead("_first").over(w_user).alias("_after"),
        F.coalesce(F.sum("_cnt").over(w_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    y = x.drop("_last").join(heads, (F.col("user_id") == F.col("_user")) & (F.col("_b") == F.col("_bucket")))
    return y.select(
        "user_id", "event_id", "channel", "event_timestamp",
        (F.col("_off") + F.col("_rn")).alias("_rank"),
        F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_prev")).alias("_prev"),
        F.when(F.col("_rn") == F.col("_cnt"), F.col("_after")).otherwise(F.col("_next")).alias("_next"),
    )


def journey_steps(
    touches: DataFrame,
    conversions: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    bucket_days: int = DEFAULT_BUCKET_DAYS,
    bucket_hours: int = 1,
) -> DataFrame:
    """Per eligible pair: position in the order's journey, previous / next channel
    and hours since the previous touch (F11, F6).

    Neighbours and ranks belong to the user's timeline, so they are computed once
    per touch.  A pair's position is its rank less that of the first touch in the
    order's window; a neighbour outside the window is NULL."""
    line = touch_timeline(touches, bucket_hours)
    pairs = eligible_pairs(line, conversions, lookback_days, bucket_days, touch_cols=("channel", "_rank", "_prev", "_next"))
    spans = pairs.groupBy("conversion_id").agg(F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"))
    y = pairs.join(spans, "conversion_id")
    start = F.col("conversion_ts") - F.make_dt_interval(days=F.lit(int(lookback_days)))
    prev = F.when(F.col("_prev.ts") >= start, F.col("_prev"))
    following = F.when(F.col("_next.ts") <= F.col("conversion_ts"), F.col("_next"))
    return y.select(
        "conversion_id",
        "user_id",
        "event_id",
        "channel",
        "touchpoint_ts",
        (F.col("_rank") - F.col("_lo") + 1).cast("long").alias("position"),
        (F.col("_hi") - F.col("_lo") + 1).cast("long").alias("journey_touches"),
        prev["channel"].alias("prev_channel"),
        following["channel"].alias("next_channel"),
        F.round(days_between(prev["ts"], F.col("touchpoint_ts")) * 24.0, 6).alias("hours_since_prev"),
    )
