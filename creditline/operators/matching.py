"""Matched markets on several pre-period features.

Features are z-scored over the markets of a ``by`` key.  The nearest controls of a
treatment market are found in two equi-joins, without comparing all markets:

1. a bound: the k controls below and above it on the first feature (by rank) are at
   some distances; the k-th smallest bounds the distance of its k-th neighbour;
2. the ring: only controls whose first feature lies within the bound can be nearer.
   They are met through cells of the first feature, and compared exactly.

Ranks come from counts per cell and a row number within a cell, so no window holds all
markets of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.operators.geo import CONTROL, TREATMENT
from creditline.session import checkpoint_dir

#: Width of a cell of the first feature, in standard deviations.
CELL = 0.25


def zscored(features: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., dma_code, arm, z: the features less their mean, over their (population) standard deviation
    within a key.  Markets that lack a feature (or have NaN) are left out; a feature that does not vary is 0."""
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = features.where(known).select(*by, "dma_code", "arm", *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(cols)])
    stats = x.groupBy(*by).agg(*[f(f"_f{i}").alias(f"_{n}{i}") for i in range(len(cols)) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    if by:
        stats = stats.select(*[F.col(b).alias(f"_by_{b}") for b in by], *[c for c in stats.columns if c not in by])
        on = F.lit(True)
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
        x = x.join(stats, on)
    else:
        x = x.crossJoin(F.broadcast(stats))  # one row
    z = [F.when(F.col(f"_s{i}") > 0, (F.col(f"_f{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.lit(0.0)) for i in range(len(cols))]
    return x.select(*by, "dma_code", "arm", F.array(*z).alias("z"))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _equal(names: Sequence[str], left: str, right: str) -> Column:
    """Null keys are one key."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def nearest_controls(scored: DataFrame, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest control markets (all, if fewer) of each treatment market of ``zscored`` rows:
    by..., treatment_dma, control_dma, distance, place (from 1; equal distances by control code).
    Distances that agree to 9 digits count as equal.  Treatments of a key without controls have no row."""
    by = list(by)
    x = scored.withColumn("_z0", F.col("z")[0]).withColumn("_cell", F.floor(F.col("z")[0] / CELL).cast("long"))
    is_c = F.col("arm") == CONTROL
    # how many controls lie in the cells before, and at or before a market in its own cell
    cells = x.groupBy(*by, "_cell").agg(F.count_if(is_c).alias("_in"))
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_cell").orderBy("_z0", F.when(is_c, 0).otherwise(1), "dma_code")
    x = x.withColumn("_upto", F.count_if(is_c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.alias("x").join(cells.alias("c"), _equal([*by, "_cell"], "x", "c")).select(
        "x.*", (F.col("c._before") + F.col("x._upto")).alias("_rank"))
    c = x.where(is_c).select(*by, F.col("dma_code").alias("control_dma"), F.col("z").alias("_cz"), "_rank", "_cell")
    t = x.where(F.col("arm") == TREATMENT).select(*by, F.col("dma_code").alias("treatment_dma"), F.col("z").alias("_tz"), "_rank", "_z0")

    near = t.withColumn("_r", F.explode(F.sequence(F.col("_rank") - (k - 1), F.col("_rank") + k)))
    near = near.alias("t").join(c.alias("c"), _equal(by, "t", "c") & (F.col("t._r") == F.col("c._rank")))
    near = near.select(*[F.col(f"t.{b}").alias(b) for b in by], "treatment_dma", _distance("_tz", "_cz").alias("_d"))
    bound = near.groupBy(*by, "treatment_dma").agg(F.sort_array(F.collect_list("_d")).alias("_ds"))
    # fewer than k controls in all: the farthest of those met is no bound, but all controls were met
    bound = bound.select(*by, "treatment_dma", F.element_at("_ds", F.least(F.lit(k), F.size("_ds"))).alias("_bound"))
    t = t.alias("t").join(bound.alias("b"), _equal([*by, "treatment_dma"], "t", "b")).select("t.*", "b._bound")
    slack = F.col("_bound") + 1e-8  # distances are compared to 9 digits
    reach = F.sequence(F.floor((F.col("_z0") - slack) / CELL).cast("long"), F.floor((F.col("_z0") + slack) / CELL).cast("long"))
    ring = t.withColumn("_near", F.explode(reach))
    ring = ring.alias("t").join(c.alias("c"), _equal(by, "t", "c") & (F.col("t._near") == F.col("c._cell")))
    ring = ring.select(*[F.col(f"t.{b}").alias(b) for b in by], "treatment_dma", "control_dma", F.round(_distance("_tz", "_cz"), 9).alias("distance"), "_bound")
    best = Window.partitionBy(*by, "treatment_dma").orderBy("distance", "control_dma")
    ring = ring.where(F.col("distance") <= F.round("_bound", 9)).withColumn("place", F.row_number().over(best))
    return ring.where(F.col("place") <= k).select(*by, "treatment_dma", "control_dma", "distance", "place")


def assign_controls(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-to-one matching, nearest pairs first: by..., treatment_dma, control_dma, distance, round.

    In every round the free markets that are each other's nearest (ties by code) are paired, until one arm of
    every key is used up.  No pair that a scan of all pairs in order of (distance, treatment, control) takes earlier
    holds either of them, so the result is that of the scan.
    Each round is written to the checkpoint folder, if one is set."""
    by = list(by)
    spark = scored.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        return df.checkpoint() if checkpoint_dir(spark) else df.cache()

    free, out, n = kept(scored), None, 0
    while True:
        n += 1
        wanted = nearest_controls(free, 1, by)
        other = F.when(F.col("arm") == CONTROL, TREATMENT).when(F.col("arm") == TREATMENT, CONTROL)
        back = nearest_controls(free.withColumn("arm", other), 1, by).select(
            *by, F.col("control_dma").alias("treatment_dma"), F.col("treatment_dma").alias("control_dma"))
        pairs = wanted.alias("w").join(back.alias("b"), _equal([*by, "treatment_dma", "control_dma"], "w", "b"))
        pairs = kept(pairs.select(*[F.col(f"w.{b}").alias(b) for b in by], "w.treatment_dma", "w.control_dma", "distance", F.lit(n).alias("round")))
        if pairs.isEmpty():
            return pairs if out is None else out
        out = pairs if out is None else out.unionByName(pairs)
        for arm, col in ((TREATMENT, "treatment_dma"), (CONTROL, "control_dma")):
            gone = pairs.select(*by, F.lit(arm).alias("arm"), F.col(col).alias("dma_code"))
            free = free.alias("f").join(gone.alias("g"), _equal([*by, "arm", "dma_code"], "f", "g"), "left_anti")
        free = kept(free)


def market_features(conversions: DataFrame, touches: DataFrame, population: DataFrame, control_markets: DataFrame, before: Column) -> DataFrame:
    """Per market of ``population``: arm, conversions, revenue and touches per capita before ``before`` (a timestamp)."""
    conv = conversions.where(F.col("converted_at") < before).groupBy("dma_code").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("order_value_usd").cast("double").alias("_r"))
    seen = touches.where(F.col("event_timestamp") < before).groupBy("dma_code").agg(F.count(F.lit(1)).alias("_t"))
    ctrl = control_markets.select("dma_code", F.lit(True).alias("_ctrl")).distinct()
    x = population.join(conv, "dma_code", "left").join(seen, "dma_code", "left").join(ctrl, "dma_code", "left")
    per = {"conversion_rate": "_c", "revenue_per_capita": "_r", "touches_per_capita": "_t"}
    return x.select("dma_code", F.when(F.col("_ctrl"), F.lit(CONTROL)).otherwise(F.lit(TREATMENT)).alias("arm"),
                    *[F.try_divide(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.col("population").cast("double")).alias(n) for n, c in per.items()])
