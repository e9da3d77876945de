"""Journey paths (F11): an order's channels in order, as data.

Touches are collected per (user, time bucket) once, not per order; a fragment is sorted by
itself.  An order meets the fragments of the buckets that its lookback covers, cuts the
two at its ends, and joins them in the buckets' order.  Fragments concatenate
associatively, so nothing sorts or windows a user's whole history, and only an order's own
path is ever in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditline.functions.columns import LOOKBACK_DAYS, money
from creditline.operators.journeys import _day_bucket

ARROW = " > "


def path_fragments(touches: DataFrame, bucket_days: int = 1, step: str = "channel") -> DataFrame:
    """user_id, bucket, steps: the bucket's touches (ts, event_id, step) in order.  Touches without a user or a time have none."""
    t = touches.where(F.col("user_id").isNotNull() & F.col("event_timestamp").isNotNull())
    one = F.struct(F.col("event_timestamp").alias("ts"), "event_id", F.col(step).alias("step"))
    return t.groupBy("user_id", _day_bucket(F.col("event_timestamp"), bucket_days).alias("bucket")).agg(F.sort_array(F.collect_list(one)).alias("steps"))


def journey_paths(touches: DataFrame, conversions: DataFrame, lookback_days: int = LOOKBACK_DAYS, bucket_days: int = 1, step: str = "channel") -> DataFrame:
    """conversion_id, user_id, order_value_usd, path (array of the steps in (time, event_id) order), touches, per order
    with an eligible touch; a null step is null in the array."""
    start = F.col("converted_at") - F.make_dt_interval(days=F.lit(int(lookback_days)))
    o = conversions.select("user_id", "conversion_id", "order_value_usd", F.col("converted_at").alias("_end"), start.alias("_start"))
    o = o.withColumn("bucket", F.explode(F.sequence(_day_bucket(F.col("_start"), bucket_days), _day_bucket(F.col("_end"), bucket_days))))
    both = o.join(path_fragments(touches, bucket_days, step), ["user_id", "bucket"])
    own = F.filter("steps", lambda s: (s["ts"] >= F.col("_start")) & (s["ts"] <= F.col("_end")))
    both = both.select("conversion_id", "user_id", "order_value_usd", "bucket", own.alias("steps")).where("size(steps) > 0")
    joined = both.groupBy("conversion_id", "user_id", "order_value_usd").agg(F.sort_array(F.collect_list(F.struct("bucket", "steps"))).alias("_f"))
    path = F.flatten(F.transform("_f", lambda f: F.transform(f["steps"], lambda s: s["step"])))
    return joined.select("conversion_id", "user_id", "order_value_usd", path.alias("path")).withColumn("touches", F.size("path").cast("long"))


def without_repeats(path: str) -> Column:
    """The path with runs of one step collapsed."""
    # a sequence from 1 to 0 would count down
    places = F.when(F.size(path) > 0, F.sequence(F.lit(1), F.size(path))).otherwise(F.array().cast("array<int>"))
    keep = F.filter(places, lambda i: (i == 1) | ~F.element_at(path, i).eqNullSafe(F.element_at(path, F.greatest(i - 1, F.lit(1)))))
    return F.transform(keep, lambda i: F.element_at(path, i))


def path_report(paths: DataFrame, collapse: bool = True) -> DataFrame:
    """Per distinct path (runs collapsed): conversions, revenue, mean order value, mean touches, steps."""
    p = without_repeats("path") if collapse else F.col("path")
    steps = paths.select(p.alias("_steps"), "order_value_usd", "touches")
    shown = F.array_join(F.transform("_steps", lambda s: F.coalesce(s.cast("string"), F.lit("(none)"))), ARROW)
    return steps.select(shown.alias("path"), F.size("_steps").cast("long").alias("steps"), "order_value_usd", "touches").groupBy("path", "steps").agg(
        F.count(F.lit(1)).alias("conversions"),
        money(F.sum("order_value_usd")).alias("revenue_usd"),
        F.round(F.avg("order_value_usd").cast("double"), 4).alias("mean_order_value_usd"),
        F.round(F.avg("touches"), 4).alias("mean_touches"),
    )
