"""Journey paths: fragments joined equal a sort of each order's touches."""

from pyspark.sql import functions as F

from creditline.operators.journeys import eligible_pairs
from creditline.operators.paths import journey_paths, path_report, without_repeats
from tests.test_sweep import _data


def test_paths_equal_a_sort_of_the_pairs(spark):
    for bucket in (1, 7):
        t, o = _data(spark, 8)
        got = {r.conversion_id: (r.path, r.touches) for r in journey_paths(t, o, 30, bucket).collect()}
        want = {}
        for r in eligible_pairs(t, o, 30).collect():
            want.setdefault(r.conversion_id, []).append((r.touchpoint_ts, r.event_id, r.channel))
        assert got == {k: ([c for *_, c in sorted(v, key=lambda x: x[:2])], len(v)) for k, v in want.items()}


def test_runs_collapse_and_report(spark):
    df = spark.createDataFrame([(["a", "a", "b", None, None, "a"],), ([],), (["x"],)], "path array<string>")
    assert [r[0] for r in df.select(without_repeats("path")).where("true").collect()][0] == ["a", "b", None, "a"]
    t, o = _data(spark, 9)
    paths = journey_paths(t, o, 30)
    report = path_report(paths)
    assert report.agg(F.sum("conversions")).first()[0] == paths.count()


def test_long_history_has_no_window(spark):
    ts = F.timestamp_seconds(F.col("id") * 30 + 1_700_000_000).cast("timestamp_ntz")
    t = spark.range(1_000_000).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("event_id"), ts.alias("event_timestamp"), F.lit("c").alias("channel"))
    o = spark.range(3).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("conversion_id"), F.lit(1).cast("decimal(18,2)").alias("order_value_usd"),
                              F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 9_000_000).cast("timestamp_ntz").alias("converted_at"))
    rows = journey_paths(t, o, 2)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.conversion_id: r.touches for r in rows.collect()} == {0: 1, 1: 5761, 2: 5761}
