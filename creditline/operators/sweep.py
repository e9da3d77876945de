"""Attribution without touch-order pairs: a sweep over prefix aggregates.

A pair join makes as many rows as there are touches in all orders' windows; without a
lookback that is every touch of a user for every order.  Counts and decayed weights,
however, are sums, and a window's sum is the difference of two prefixes of the user's
timeline.  So touches and orders meet as events on one timeline:

1. touches -> one row per (user, credit key, time bucket): count, weight, first and last
   touch;
2. these rows, and the buckets that orders look at, get what lies before them and the first
   touch after them through a window over buckets (bounded by the data's time span);
3. every order asks at most twice per credit key of its user: at its conversion, and before
   the start of its lookback, unless that lies in a bucket before the key's first.  A window
   over the touches and questions of one bucket, and the bucket's row of step 2, adds the
   part of the bucket that lies before the question;
4. the answers make one row per (order, credit key), as the pair join's first aggregate
   would.

No window holds a user's whole history: they run per (user, key, bucket), and over one
row per bucket.  Each step starts with a shuffle of its own, as a partition by user would
serve all of them and one task would hold the sorts and aggregates of all at once.

Weights are 2^(t / half-life).  They are kept as a mantissa relative to the start of a
block of half-lives and the block's number, so that no history is too long for a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.functions.columns import HALF_LIFE_DAYS, LOOKBACK_DAYS, MICROS_PER_DAY, order_key_for, wall_micros

#: Half-lives of a block, and at most of a bucket: 2^(250 + 250) touches' weights still add up in a double.
BLOCK_HALF_LIVES = 250
#: Questions are several rows a touch: their shuffles have so many times as many partitions as others.
SPREAD = 4


def _pow2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def order_credits(
    touches: DataFrame,
    conversions: DataFrame,
    lookback_days: int | None = LOOKBACK_DAYS,
    half_life_days: float = HALF_LIFE_DAYS,
    credit_key: str = "channel",
    bucket_hours: float = 24.0,
) -> DataFrame:
    """One row per (user_id, conversion_id, credit_key) with a touch in the order's window: n (touches), lw (log2 of
    the sum of 2^(t / half-life)), fk and lk (order keys of the first and last touch), value, conv_ts.

    Equal to the aggregate of the pairs that ``eligible_pairs`` gives.  Touches and orders without a user or a
    time have no pairs; a null credit key is a key like any other.  Orders are unique by conversion_id."""
    half_life = float(half_life_days) * MICROS_PER_DAY
    width = max(1, int(min(bucket_hours * 3_600_000_000, BLOCK_HALF_LIVES * half_life)))
    per_block = max(1, int(BLOCK_HALF_LIVES * half_life // width))
    step = width / half_life  # half-lives of a bucket
    key = F.col(credit_key)

    def bucket(us: str) -> Column:
        # integer division rounded down, as a double cannot hold all microseconds
        return F.expr(f"{us} div {width} - if(pmod({us}, {width}) <> 0 and {us} < 0, 1, 0)")

    parts = SPREAD * int(touches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = order_key_for(touches, "event_timestamp", "event_id")
    t = touches.where(F.col("user_id").isNotNull() & F.col("event_timestamp").isNotNull())
    # shuffled once: what follows reads the same columns, so that Spark reuses the exchange
    t = t.select("user_id", key.alias("_key"), wall_micros("event_timestamp").alias("_us"), ok.alias("_ok"))
    t = t.repartition(parts, "user_id", "_key", bucket("_us"))
    t = t.withColumn("_b", bucket("_us"))
    t = t.withColumn("_w", _pow2((F.col("_us") - F.col("_b") * width).cast("double") / F.lit(half_life)))

    heads = t.groupBy("user_id", "_key", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"), F.min("_ok").alias("_fk"), F.max("_ok").alias("_lk"))
    keys = t.groupBy("user_id", "_key").agg(F.min("_b").alias("_from"), F.min("_ok").alias("_first"))

    end_us = wall_micros("converted_at")
    orders = conversions.where(F.col("user_id").isNotNull() & F.col("converted_at").isNotNull()).select(
        "user_id", "conversion_id", F.col("order_value_usd").alias("value"), F.col("converted_at").alias("conv_ts"), end_us.alias("_end"))
    # an order asks for every credit key that its user has by the end of the order's bucket
    asks = orders.join(keys, "user_id").where(bucket("_end") >= F.col("_from"))
    at_end, none = F.struct(F.lit(2).alias("kind"), F.col("_end").alias("us")), F.lit(None)
    if lookback_days is None:
        asks = asks.withColumn("_a", at_end)
    else:
        # nothing lies before a start in a bucket before the key's first: the window begins with the first touch of all
        asks = asks.withColumn("_start", wall_micros(F.col("conv_ts") - F.make_dt_interval(days=F.lit(int(lookback_days)))))
        since = bucket("_start") >= F.col("_from")
        at_start = F.struct(F.lit(0).alias("kind"), F.col("_start").alias("us"))
        asks = asks.withColumn("_first", F.when(~since, F.col("_first")))
        asks = asks.withColumn("_a", F.explode(F.when(since, F.array(at_end, at_start)).otherwise(F.array(at_end))))
    asks = asks.select("user_id", "_key", F.col("_a.us").alias("_us"), F.col("_a.kind").alias("_kind"),
                       "conversion_id", "value", "conv_ts", F.when(F.col("_a.kind") == 2, F.col("_first")).alias("_first"))

    # buckets: what lies before them, what follows
    nothing = {"_n": F.lit(0).cast("long"), "_w": F.lit(0.0), "_fk": none, "_lk": none}
    places = asks.select("user_id", "_key", bucket("_us").alias("_b")).withColumns(nothing)
    line = heads.withColumn("_asked", F.lit(False)).unionByName(
        places.select(*[F.col(c).cast(heads.schema[c].dataType) for c in heads.columns], F.lit(True).alias("_asked")))
    line = line.repartition(parts, "user_id", "_key").groupBy("user_id", "_key", "_b").agg(
        F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.min("_fk").alias("_fk"), F.max("_lk").alias("_lk"), F.max("_asked").alias("_asked"))
    line = line.withColumn("_block", F.floor(F.col("_b") / F.lit(per_block)).cast("long"))
    # one sort for both: blocks follow one another as their buckets do
    by_block, by_line = Window.partitionBy("user_id", "_key", "_block"), Window.partitionBy("user_id", "_key").orderBy("_block", "_b")
    in_block = F.col("_w") * _pow2((F.col("_b") - F.col("_block") * per_block) * F.lit(step))
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumns({
        "_in": F.coalesce(F.sum(in_block).over(by_block.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_all": F.sum(in_block).over(by_block),
        "_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_lk0": F.max("_lk").over(before),
        "_fk1": F.min("_fk").over(by_line.rowsBetween(1, Window.unboundedFollowing)),
    })
    # the last block with touches before each block
    full = F.when(F.col("_all") > 0, F.struct(F.col("_block").alias("block"), F.col("_all").alias("w")))
    line = line.withColumn("_old", F.last(full, ignorenulls=True).over(before))
    line = line.withColumn("_old", F.first("_old").over(by_block.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    state = ["_in", "_old", "_n0", "_lk0", "_fk1"]
    line = line.where("_asked").select("user_id", "_key", "_b", *state)

    # inside a bucket: what lies before it (a row without a time, which comes first), touches before the question,
    # and the first one after it
    asked = ["conversion_id", "value", "conv_ts", "_first"]
    types = {f.name: f.dataType for d in (t, asks, line) for f in d.schema}
    columns = ["user_id", "_key", "_b", "_us", "_kind", "_w", "_ok", *asked, *state]

    def events(df: DataFrame, **given: Column) -> DataFrame:
        held = {c: F.col(c) for c in df.columns} | given
        return df.select(*[held.get(c, none).cast(types.get(c, "int")).alias(c) for c in columns])

    at_place = events(t, _kind=F.lit(1)).unionByName(events(asks, _b=bucket("_us"), _w=F.lit(0.0))).unionByName(
        events(line, _kind=F.lit(-1), _w=F.lit(0.0))).repartition(parts, "user_id", "_key", "_b")
    inside = Window.partitionBy("user_id", "_key", "_b").orderBy("_us", "_kind")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    # rows of one time and kind are alike: only touches count, and they sort between the two kinds of questions
    both = at_place.select(
        "user_id", "_key", "_b", "_kind", *asked,
        F.count_if(F.col("_kind") == 1).over(so_far).alias("_n1"), F.sum("_w").over(so_far).alias("_w1"), F.max("_ok").over(so_far).alias("_lk1"),
        F.min("_ok").over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("_fk0"),
        *[F.first(c).over(so_far).alias(c) for c in state],
    ).where("_kind in (0, 2)")
    both = both.withColumn("_block", F.floor(F.col("_b") / F.lit(per_block)).cast("long"))
    here = F.col("_in") + F.col("_w1") * _pow2((F.col("_b") - F.col("_block") * per_block) * F.lit(step))
    older = F.coalesce(F.col("_old.w") * _pow2((F.col("_old.block") - F.col("_block")) * F.lit(per_block * step)), F.lit(0.0))
    both = both.select(
        "user_id", "_key", "conversion_id", "value", "conv_ts", "_kind",
        (F.col("_n0") + F.col("_n1")).alias("_n"),
        F.when(here > 0, here + older).otherwise(F.coalesce(F.col("_old.w"), F.lit(0.0))).alias("_w"),
        F.when(here > 0, F.col("_block")).otherwise(F.coalesce(F.col("_old.block"), F.col("_block"))).alias("_block"),
        F.when(F.col("_kind") == 2, F.coalesce("_lk1", "_lk0")).alias("_lk"),
        F.when(F.col("_kind") == 0, F.coalesce("_fk0", "_fk1")).otherwise(F.col("_first")).alias("_fk"),
    )
    # one row of each kind: max() only picks it
    rows = both.repartition(parts, "conversion_id").groupBy("user_id", "conversion_id", "_key").agg(
        F.max("value").alias("value"), F.max("conv_ts").alias("conv_ts"),
        *[F.max(F.when(F.col("_kind") == kind, F.col(f"_{c}"))).alias(f"_{c}{kind}") for kind in (2, 0) for c in ("n", "w", "block")],
        F.max("_lk").alias("lk"), F.min("_fk").alias("fk"),
    )
    lost = F.coalesce(F.col("_w0") * _pow2((F.col("_block0") - F.col("_block2")) * F.lit(per_block * step)), F.lit(0.0))
    rows = rows.select(
        "user_id", "conversion_id", F.col("_key").alias(credit_key),
        (F.col("_n2") - F.coalesce("_n0", F.lit(0))).alias("n"),
        (F.log2(F.col("_w2") - lost) + F.col("_block2") * F.lit(per_block * step)).alias("lw"),
        "fk", "lk", "value", "conv_ts",
    )
    return rows.where("n > 0")
