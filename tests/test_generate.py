"""Synthetic journey generator (A8-A10) feeds the same pipeline."""

from datetime import date

from pyspark.sql import functions as F

from creditline.operators import geo
from creditline.operators.attribution import attribute
from creditline.operators.journeys import dedup_touchpoints, eligible_pairs
from creditline.operators.staging import stage_conversions, stage_spend, stage_touchpoints
from creditline.sources.generate import gen_journeys


def test_generator_is_deterministic_and_consistent(spark):
    g = gen_journeys(spark, 2_000, seed=7)
    g2 = gen_journeys(spark, 2_000, seed=7)
    assert g.touchpoints.exceptAll(g2.touchpoints).count() == 0
    n_conv = g.conversions.count()
    assert 0.35 * 2_000 < n_conv < 0.55 * 2_000
    assert g.ad_spend.count() == 181 * 50 * 3
    touches = stage_touchpoints(g.touchpoints)
    deduped = dedup_touchpoints(touches)
    assert touches.count() > deduped.count()            # injected re-sends are removed
    convs = stage_conversions(g.conversions)
    pairs = eligible_pairs(deduped, convs)
    assert pairs.select("conversion_id").distinct().count() == n_conv   # every order has its journey
    total = sum(float(r.linear_revenue) for r in attribute(pairs).collect())
    assert abs(total - float(convs.agg(F.sum("order_value_usd")).first()[0])) < 0.01
    control = spark.createDataFrame([(f"DMA_{100 + i}",) for i in range(10)], "dma_code string")
    assert geo.holdout_contamination(touches, control, date(2026, 6, 1), date(2026, 6, 30)).count() == 0
    spend = stage_spend(g.ad_spend)
    paused = spend.filter((F.col("channel") == "Meta_Paid_Social") & (F.month("ad_date") == 6)).join(control, "dma_code", "left_semi")
    assert paused.agg(F.sum("spend_usd")).first()[0] == 0
