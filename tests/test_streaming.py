"""Streaming variants against their batch counterparts (file source, availableNow)."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from creditline.plans.pipeline import Pipeline
from creditline.session import checkpoint_dir
from creditline.streaming import streams
from tests.conftest import SMALL


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/data/{name}-{uuid.uuid4().hex[:8]}"


def _ordered_write(df, ts, path, parts=4):
    """Write ``parts`` files in event-time order (one write per time slice), like an
    append-only landing folder; the file source then replays them in order."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    step = (hi - lo) / parts
    for i in range(parts):
        a, b = lo + step * i, (lo + step * (i + 1)) if i < parts - 1 else None
        cond = (F.col(ts) >= a) & ((F.col(ts) < b) if b is not None else F.lit(True))
        df.filter(cond).coalesce(1).write.mode("append").parquet(path)


def _staged_source(spark):
    p = Pipeline(spark, SMALL)
    src = _scratch(spark, "touch-src")
    _ordered_write(p.touches, "event_timestamp", src)
    return p, src


def test_stream_dedup_matches_batch_keys(spark):
    p, src = _staged_source(spark)
    schema = spark.read.parquet(src).schema
    out = _scratch(spark, "dedup-out")
    name = f"dedup_{uuid.uuid4().hex[:6]}"
    q = streams.start(streams.stream_dedup(streams.touch_stream(spark, src, schema, 1), "1 hour"), name, out)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    keys = ["user_id", "event_timestamp", "channel"]
    assert got.count() == p.deduped.count()
    assert got.select(*keys).subtract(p.deduped.select(*keys)).count() == 0


def test_stream_pairs_matches_batch(spark):
    p, src = _staged_source(spark)
    csrc = _scratch(spark, "conv-src")
    p.conversions.coalesce(1).write.parquet(csrc)
    t = streams.touch_stream(spark, src, spark.read.parquet(src).schema)
    c = spark.readStream.schema(spark.read.parquet(csrc).schema).parquet(csrc)
    out = _scratch(spark, "pairs-out")
    name = f"pairs_{uuid.uuid4().hex[:6]}"
    q = streams.start(streams.stream_pairs(t, c, conversion_watermark="60 days"), name, out)
    q.awaitTermination(600)
    got = spark.read.parquet(out).select("event_id", "conversion_id")
    want = p.pairs(90).select("event_id", "conversion_id")
    assert got.count() == want.count()
    assert got.subtract(want).count() == 0


def test_campaign_monitor_and_sessions(spark):
    p, src = _staged_source(spark)
    schema = spark.read.parquet(src).schema
    out = _scratch(spark, "monitor-out")
    q = streams.start(streams.campaign_monitor(streams.touch_stream(spark, src, schema, 1), "1 day", watermark="1 hour"),
                      f"mon_{uuid.uuid4().hex[:6]}", out)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = (p.touches.groupBy(F.window(F.col("event_timestamp").cast("timestamp"), "1 day").alias("w"), "channel")
             .count().select(F.col("w.start").alias("window_start"), "channel", F.col("count").alias("touches")))
    # append mode emits a window once the watermark passes it; emitted windows are final and exact
    assert got.count() > 0
    assert got.select("window_start", "channel", "touches").subtract(batch).count() == 0
    sess_out = _scratch(spark, "sessions-out")
    q2 = streams.start(streams.user_sessions(streams.touch_stream(spark, src, schema, 1), watermark="1 hour"),
                       f"ses_{uuid.uuid4().hex[:6]}", sess_out)
    q2.awaitTermination(300)
    s = spark.read.parquet(sess_out)
    assert s.count() > 0 and s.filter(F.col("session_end") <= F.col("session_start")).count() == 0


def test_incremental_daily_mart(spark):
    p, src = _staged_source(spark)
    schema = spark.read.parquet(src).schema
    mart = _scratch(spark, "mart")
    fn = streams.incremental_daily_mart(None, mart)
    q = streams.start_foreach_batch(streams.touch_stream(spark, src, schema, 1), f"mart_{uuid.uuid4().hex[:6]}", fn)
    q.awaitTermination(300)
    got = {(str(r.day), r.channel): r.touches for r in spark.read.parquet(mart).collect()}
    want = {(str(r.day), r.channel): r.touches for r in streams.daily_channel_aggregate(p.touches).collect()}
    assert got == want


def test_smallest_survivor_in_any_order_of_arrival(spark):
    """Copies arrive shuffled within the watermark; the survivors are those of the batch dedup."""
    p = Pipeline(spark, SMALL)
    src, out = _scratch(spark, "shuffled-src"), _scratch(spark, "smallest-out")
    hour = F.floor(F.unix_seconds(F.col("event_timestamp").cast("timestamp")) / 86_400)
    rows = p.touches.withColumn("_d", hour).withColumn("_part", F.ntile(3).over(Window.orderBy("_d", F.xxhash64("event_id")))).drop("_d")
    for i in (1, 2, 3):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    q = streams.start(streams.stream_dedup_smallest(streams.touch_stream(spark, src, schema, 1), "3 days"), f"small_{uuid.uuid4().hex[:6]}", out)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    last = p.touches.agg(F.max("event_timestamp")).first()[0]
    done = p.deduped.where(F.col("event_timestamp") < F.lit(last) - F.expr("INTERVAL 3 DAYS"))
    key = ["user_id", "event_timestamp", "channel", "event_id"]
    assert got.count() == got.dropDuplicates(key).count() and got.count() > 100
    assert got.select(*key).subtract(p.deduped.select(*key)).count() == 0
    assert done.select(*key).subtract(got.select(*key)).count() == 0


def test_unattributed_orders_come_once_across_a_restart(spark):
    from datetime import datetime, timedelta
    from decimal import Decimal

    t0 = datetime(2024, 1, 1)
    tsrc, csrc, out = (_scratch(spark, x) for x in ("un-touch", "un-conv", "un-out"))
    touch, order = "user_id bigint, event_timestamp timestamp_ntz", "user_id bigint, conversion_id bigint, converted_at timestamp_ntz, order_value_usd decimal(18,2)"

    def feed(day, touches, orders):
        at = t0 + timedelta(days=day)
        spark.createDataFrame([(u, at) for u in touches], touch).coalesce(1).write.mode("append").parquet(tsrc)
        spark.createDataFrame([(u, i, at + timedelta(hours=1), Decimal("5.00")) for u, i in orders], order).coalesce(1).write.mode("append").parquet(csrc)

    name = f"un_{uuid.uuid4().hex[:6]}"

    def run():
        t = spark.readStream.schema(touch).parquet(tsrc)
        c = spark.readStream.schema(order).parquet(csrc)
        streams.start(streams.stream_unattributed(t, c, 2, "3 days", "1 day"), name, out).awaitTermination(300)
        return sorted(r.conversion_id for r in spark.read.schema("conversion_id bigint").parquet(out).collect())

    feed(0, [1, 9], [(1, 10), (2, 20)])
    feed(3, [9], [(1, 11)])
    assert run() == []  # touches for them could still arrive
    feed(30, [9], [(9, 90)])
    feed(31, [9], [(9, 91)])
    run()
    feed(60, [9], [(9, 92)])
    run()
    feed(61, [9], [(9, 93)])
    assert run() == [11, 20]  # order 11's touch lies beyond the lookback; each once, over four runs of one checkpoint
