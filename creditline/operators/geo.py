"""Geo-holdout experiment and incrementality.

Markets are aggregated first (one row per market), so every later step works
on a table bounded by the number of markets; the experiment-level numbers are
one conditional aggregate, never a driver-side loop.  ``by`` keys turn each
operator into one grouped job over many experiments (campaigns, advertisers).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.functions.columns import norm_ppf_approx, norm_tail, safe_ratio

CONTROL, TREATMENT = "control", "treatment"


def window_filter(ts: Column, start: date, end: date, end_inclusive_day: bool = True) -> Column:
    """Experiment window on a timestamp.

    ``end_inclusive_day=True``: half-open [start, end + 1 day).  ``False``
    reproduces comparing against the bare end date, i.e. midnight of the last day."""
    hi = (ts < F.lit(end + timedelta(days=1)).cast("timestamp_ntz")) if end_inclusive_day else (ts <= F.lit(end).cast("timestamp_ntz"))
    return (ts >= F.lit(start).cast("timestamp_ntz")) & hi


def dma_population_proxy(touches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unique users per market over all time (H1 proxy, E4)."""
    return touches.groupBy(*by, "dma_code").agg(F.countDistinct("user_id").alias("population"))


def geo_groups(
    conversions: DataFrame,
    population: DataFrame,
    control_markets: DataFrame,
    start: date,
    end: date,
    end_inclusive_day: bool = True,
    include_empty: bool = False,
    by: Sequence[str] = (),
    population_join: str = "left",
) -> DataFrame:
    """Per-market table: arm, window conversions, revenue, population, rate (H2, H3).

    Default: only markets with a window conversion; with ``include_empty`` every
    market of ``population`` appears for every ``by`` key that has conversions in
    the window, with 0 conversions.  ``population_join='inner'`` drops markets
    without a population (D6), ``'left'`` keeps them with a NULL rate (D5)."""
    if population_join not in ("left", "inner"):
        raise ValueError("population_join must be 'left' or 'inner'")
    win = conversions.filter(window_filter(F.col("converted_at"), start, end, end_inclusive_day))
    agg = win.groupBy(*by, "dma_code").agg(
        F.count(F.lit(1)).alias("conversions"),
        F.sum("order_value_usd").alias("revenue_usd"),
    )
    ctrl = control_markets.select("dma_code", F.lit(True).alias("_ctrl")).distinct()
    if include_empty:
        # the result itself has one row per key and market
        markets = agg.select(*by).distinct().crossJoin(population) if by else population
        held = agg.select(*[F.col(b).alias(f"_agg_{b}") for b in by], F.col("dma_code").alias("_agg_dma"), "conversions", "revenue_usd")
        same = F.col("dma_code") == F.col("_agg_dma")
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_agg_{b}"))
        base = markets.join(held, same, "left").fillna({"conversions": 0})
    else:
        base = agg.join(population, "dma_code", population_join)
    base = base.join(ctrl, "dma_code", "left")
    return base.select(
        *by,
        "dma_code",
        F.when(F.col("_ctrl"), F.lit(CONTROL)).otherwise(F.lit(TREATMENT)).alias("arm"),
        F.col("conversions").cast("long").alias("conversions"),
        F.coalesce(F.col("revenue_usd"), F.lit(0).cast("decimal(18,2)")).cast("double").alias("revenue_usd"),
        F.col("population").cast("long").alias("population"),
        safe_ratio(F.col("conversions"), F.col("population")).alias("conversion_rate"),
    )


def _arm_sums(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    is_c = F.col("arm") == CONTROL
    is_t = F.col("arm") == TREATMENT
    return groups.groupBy(*by).agg(
        F.sum(F.when(is_c, F.col("conversions"))).alias("cv_c"),
        F.sum(F.when(is_c, F.col("population"))).alias("n_c"),
        F.sum(F.when(is_t, F.col("conversions"))).alias("cv_t"),
        F.sum(F.when(is_t, F.col("population"))).alias("n_t"),
        F.sum(F.when(is_t, F.col("revenue_usd"))).alias("rev_t"),
        F.count_if(is_c).alias("control_markets"),
        F.count_if(is_t).alias("treatment_markets"),
    )


def treatment_spend(
    spend: DataFrame,
    control_markets: DataFrame,
    start: date,
    end: date,
    channel: str = "Meta_Paid_Social",
    by: Sequence[str] = (),
) -> DataFrame:
    """Spend of the tested channel in all non-control markets, window dates inclusive (H7)."""
    s = spend.filter(
        (F.col("channel") == channel) & (F.col("ad_date") >= F.lit(start)) & (F.col("ad_date") <= F.lit(end))
    ).join(control_markets.select("dma_code"), "dma_code", "left_anti")
    return s.groupBy(*by).agg(F.coalesce(F.sum("spend_usd"), F.lit(0)).cast("double").alias("treatment_spend_usd"))


def geo_incrementality(
    groups: DataFrame,
    spend_total: DataFrame,
    aov: float | None = None,
    by: Sequence[str] = (),
    on_zero: str = "limit",
) -> DataFrame:
    """Baseline, expected, incremental conversions, iCAC, iROAS, lift.

    ``aov=None`` uses the treatment arm's own revenue per conversion; a number is
    used as given.  ``on_zero`` says what iCAC without incremental conversions and
    iROAS without spend are: 'limit' (infinity and 0) or 'nan' (both NaN)."""
    if on_zero not in ("limit", "nan"):
        raise ValueError("on_zero must be 'limit' or 'nan'")
    no_cac, no_roas = (float("inf"), 0.0) if on_zero == "limit" else (float("nan"), float("nan"))
    a = _arm_sums(groups, by)
    j = a.join(spend_total, list(by), "left") if by else a.crossJoin(spend_total)
    baseline = safe_ratio(F.col("cv_c"), F.col("n_c"))
    expected = F.col("n_t").cast("double") * baseline
    incremental = F.col("cv_t").cast("double") - expected
    avg_order = F.lit(float(aov)) if aov is not None else safe_ratio(F.col("rev_t"), F.col("cv_t"))
    inc_rev = incremental * avg_order
    sp = F.coalesce(F.col("treatment_spend_usd"), F.lit(0.0))
    lift = F.when(expected > 0, incremental / expected * 100.0).otherwise(F.lit(0.0))
    return j.select(
        *by,
        F.col("control_markets").cast("long").alias("control_markets"),
        F.col("treatment_markets").cast("long").alias("treatment_markets"),
        F.round(baseline * 100.0, 4).alias("baseline_conversion_rate_pct"),
        F.round(expected, 0).alias("expected_baseline_conversions"),
        F.col("cv_t").cast("long").alias("actual_conversions"),
        F.round(incremental, 0).alias("incremental_conversions"),
        F.round(inc_rev, 2).alias("incremental_revenue_usd"),
        F.round(sp, 2).alias("treatment_spend_usd"),
        F.when(incremental > 0, F.round(sp / incremental, 2)).otherwise(F.lit(no_cac)).alias("incremental_cac_usd"),
        F.when(sp > 0, F.round(inc_rev / sp, 2)).otherwise(F.lit(no_roas)).alias("incremental_roas"),
        F.round(F.lit(100.0) - lift, 1).alias("organic_share_pct"),
        F.round(lift, 1).alias("incremental_lift_pct"),
        F.round(safe_ratio(expected * 100.0, F.col("cv_t")), 1).alias("expected_share_of_actual_pct"),
    )


def two_proportion_z(groups: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Pooled two-proportion z-test, two-tailed.

    z and p are NULL when the pooled rate is outside (0, 1) or an arm has no
    population (the test is undefined then)."""
    a = _arm_sums(groups, by)
    rt = safe_ratio(F.col("cv_t"), F.col("n_t"))
    rc = safe_ratio(F.col("cv_c"), F.col("n_c"))
    pooled = safe_ratio(F.col("cv_t") + F.col("cv_c"), F.col("n_t") + F.col("n_c"))
    valid = (pooled > 0) & (pooled < 1)
    se = F.sqrt(F.when(valid, pooled * (F.lit(1.0) - pooled) * (safe_ratio(F.lit(1.0), F.col("n_t")) + safe_ratio(F.lit(1.0), F.col("n_c")))))
    z = safe_ratio(rt - rc, se)
    p = F.lit(2.0) * norm_tail(z)
    return a.select(
        *by,
        F.round(rt * 100.0, 4).alias("treatment_conversion_rate_pct"),
        F.round(rc * 100.0, 4).alias("control_conversion_rate_pct"),
        F.round((rt - rc) * 100.0, 4).alias("absolute_diff_pct"),
        F.round(z, 3).alias("z_score"),
        F.round(p, 4).alias("p_value"),
        (p < F.lit(alpha)).alias("statistically_significant"),
        F.lit(f"{int(round((1 - alpha) * 100))}%").alias("confidence_level"),
    )


def lift_ci(groups: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Wald interval of the rate difference and of the relative lift.

    The bounds are NULL when an arm's rate is outside [0, 1] or undefined."""
    zc = norm_ppf_approx(1 - alpha / 2)
    a = _arm_sums(groups, by)
    rt = safe_ratio(F.col("cv_t"), F.col("n_t"))
    rc = safe_ratio(F.col("cv_c"), F.col("n_c"))
    valid = rt.between(0.0, 1.0) & rc.between(0.0, 1.0)
    se = F.sqrt(F.when(valid, safe_ratio(rt * (F.lit(1.0) - rt), F.col("n_t")) + safe_ratio(rc * (F.lit(1.0) - rc), F.col("n_c"))))
    diff = rt - rc
    return a.select(
        *by,
        F.round(diff * 100.0, 4).alias("diff_pct"),
        F.round((diff - F.lit(zc) * se) * 100.0, 4).alias("diff_ci_low_pct"),
        F.round((diff + F.lit(zc) * se) * 100.0, 4).alias("diff_ci_high_pct"),
        F.round(safe_ratio(diff * 100.0, rc), 2).alias("relative_lift_pct"),
        F.round(safe_ratio((diff - F.lit(zc) * se) * 100.0, rc), 2).alias("relative_lift_low_pct"),
        F.round(safe_ratio((diff + F.lit(zc) * se) * 100.0, rc), 2).alias("relative_lift_high_pct"),
    )


def minimum_detectable_effect(groups: DataFrame, alpha: float = 0.05, power: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Closed-form MDE of the rate difference at the control rate.

    NULL when the control rate is outside [0, 1] or an arm has no population."""
    k = norm_ppf_approx(1 - alpha / 2) + norm_ppf_approx(power)
    a = _arm_sums(groups, by)
    rc = safe_ratio(F.col("cv_c"), F.col("n_c"))
    per_head = safe_ratio(F.lit(1.0), F.col("n_t")) + safe_ratio(F.lit(1.0), F.col("n_c"))
    se0 = F.sqrt(F.when(rc.between(0.0, 1.0), rc * (F.lit(1.0) - rc) * per_head))
    mde = F.lit(k) * se0
    return a.select(
        *by,
        F.round(rc * 100.0, 4).alias("baseline_rate_pct"),
        F.round(mde * 100.0, 4).alias("mde_abs_pct"),
        F.round(safe_ratio(mde * 100.0, rc), 2).alias("mde_rel_pct"),
    )


def difference_in_differences(
    conversions: DataFrame,
    population: DataFrame,
    control_markets: DataFrame,
    pre_start: date,
    start: date,
    end: date,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pre/post x arm conversion rates per capita per day and the DiD estimate.

    An arm without population has NULL rates; a market listed twice as control counts once."""
    control_markets = control_markets.select("dma_code").distinct()
    pre_days = (start - pre_start).days
    post_days = (end - start).days + 1
    ts = F.col("converted_at")
    period = F.when(
        (ts >= F.lit(pre_start).cast("timestamp_ntz")) & (ts < F.lit(start).cast("timestamp_ntz")), F.lit("pre")
    ).when(window_filter(ts, start, end), F.lit("post"))
    per = (
        conversions.withColumn("_period", period)
        .filter(F.col("_period").isNotNull())
        .join(control_markets.select("dma_code", F.lit(True).alias("_ctrl")), "dma_code", "left")
        .withColumn("_arm", F.when(F.col("_ctrl"), F.lit(CONTROL)).otherwise(F.lit(TREATMENT)))
        .groupBy(*by, "_arm", "_period")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    pop = (
        population.join(control_markets.select("dma_code", F.lit(True).alias("_ctrl")), "dma_code", "left")
        .withColumn("_arm", F.when(F.col("_ctrl"), F.lit(CONTROL)).otherwise(F.lit(TREATMENT)))
        .groupBy("_arm")
        .agg(F.sum("population").alias("_pop"))
    )
    rates = per.join(pop, "_arm").withColumn(
        "_rate",
        safe_ratio(F.col("_n"), F.col("_pop"))
        / F.when(F.col("_period") == "pre", F.lit(float(pre_days))).otherwise(F.lit(float(post_days))),
    )

    def r(arm: str, period: str) -> Column:
        return F.max(F.when((F.col("_arm") == arm) & (F.col("_period") == period), F.col("_rate")))

    out = rates.groupBy(*by).agg(
        r(CONTROL, "pre").alias("c_pre"), r(CONTROL, "post").alias("c_post"),
        r(TREATMENT, "pre").alias("t_pre"), r(TREATMENT, "post").alias("t_post"),
    )
    scale = 1e6  # per million people per day
    return out.select(
        *by,
        *[F.round(F.col(c) * scale, 4).alias(f"{c}_rate_ppm") for c in ("c_pre", "c_post", "t_pre", "t_post")],
        F.round(((F.col("t_post") - F.col("t_pre")) - (F.col("c_post") - F.col("c_pre"))) * scale, 4).alias("did_ppm"),
    )


def rate_histogram(groups: DataFrame, bins: dict[str, int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram of market conversion rates (%) per arm.

    Bin i covers [lo + (i-1)w, lo + iw); the last bin is closed.  A constant
    sample uses the range [x - 0.5, x + 0.5].  Empty bins are emitted with 0."""
    bins = bins or {CONTROL: 8, TREATMENT: 12}
    keys = [*by, "arm"]
    x = groups.filter(F.col("conversion_rate").isNotNull()).select(*keys, (F.col("conversion_rate") * 100.0).alias("x"))
    nb = None
    for arm, n in bins.items():
        nb = F.when(F.col("arm") == arm, F.lit(n)) if nb is None else nb.when(F.col("arm") == arm, F.lit(n))
    stats = x.groupBy(*keys).agg(F.min("x").alias("_mn"), F.max("x").alias("_mx")).withColumn("_n", nb).filter(F.col("_n").isNotNull())
    stats = stats.select(
        *keys, "_n",
        F.when(F.col("_mx") == F.col("_mn"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mx") == F.col("_mn"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("_n")
    binned = (
        x.join(stats, keys)
        .select(*keys, F.least(F.floor((F.col("x") - F.col("_lo")) / width).cast("int") + 1, F.col("_n")).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("dma_count"))
    )
    grid = stats.select(*keys, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("bin"), "_lo", "_hi", "_n")
    return grid.join(binned, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        F.round(F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / F.col("_n"), 6).alias("bin_low_pct"),
        F.round(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.col("_n"), 6).alias("bin_high_pct"),
        F.coalesce(F.col("dma_count"), F.lit(0)).cast("long").alias("dma_count"),
    )


def rate_quartiles(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Box summary per arm: min, quartiles (linear interpolation), max, count.

    The group is the set of markets of one arm, bounded by the market count."""
    q = F.percentile(F.col("conversion_rate"), [0.25, 0.5, 0.75])
    s = groups.filter(F.col("conversion_rate").isNotNull()).groupBy(*by, "arm").agg(
        F.count(F.lit(1)).alias("markets"),
        F.min("conversion_rate").alias("min_rate"),
        q.alias("_q"),
        F.max("conversion_rate").alias("max_rate"),
    )
    return s.select(
        *by,
        "arm",
        F.col("markets").cast("long").alias("markets"),
        F.round("min_rate", 8).alias("min_rate"),
        F.round(F.col("_q")[0], 8).alias("q1_rate"),
        F.round(F.col("_q")[1], 8).alias("median_rate"),
        F.round(F.col("_q")[2], 8).alias("q3_rate"),
        F.round("max_rate", 8).alias("max_rate"),
    )


def arm_rates_long(groups: DataFrame) -> DataFrame:
    """Market rates of both arms stacked with a display label."""
    # fixed values: the labels that reports show
    labels = {CONTROL: "Control (Meta OFF)", TREATMENT: "Treatment (Meta ON)"}
    ctrl = groups.filter(F.col("arm") == CONTROL).withColumn("group", F.lit(labels[CONTROL]))
    trt = groups.filter(F.col("arm") == TREATMENT).withColumn("group", F.lit(labels[TREATMENT]))
    return ctrl.unionByName(trt).select("group", "dma_code", "conversions", "population", "conversion_rate")


def holdout_contamination(
    touches: DataFrame,
    control_markets: DataFrame,
    start: date,
    end: date,
    channel: str = "Meta_Paid_Social",
    end_inclusive_day: bool = True,
) -> DataFrame:
    """Touches of the paused channel in control markets inside the window (H14): expect none."""
    return touches.filter(
        (F.col("channel") == channel) & window_filter(F.col("event_timestamp"), start, end, end_inclusive_day)
    ).join(control_markets.select("dma_code"), "dma_code", "left_semi")


def overstatement(platform: Column, true: Column, basis: str = "true") -> Column:
    """(platform - true) / basis x 100."""
    den = true if basis == "true" else platform
    return safe_ratio((platform - true) * 100.0, den)


def cannibalization(incremental_roas: Column, platform_roas: Column) -> Column:
    """1 - iROAS / platform ROAS, as a percentage (I5); the sign is kept."""
    return (F.lit(1.0) - safe_ratio(incremental_roas, platform_roas)) * 100.0


# ----------------------------------------------------- bootstrap (H22) -----

def bootstrap_uniform(rep: Column, market: Column, draw: int, seed: int) -> Column:
    """Deterministic uniform in (0, 1): the first 52 bits of the MD5 of (seed, draw, replicate, market).

    A counter through a cryptographic hash: draws of different markets and replicates are
    independent for all purposes, whatever the job's partitions, and any engine computes the same."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(draw)), rep.cast("string"), market.cast("string"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _poisson1_cdf() -> list[float]:
    """P(K <= k) of Poisson(1), k = 0, 1, ... until it is 1 in double precision."""
    acc, p, k, out = 0.0, math.exp(-1.0), 0, []
    while acc + p > acc:
        acc += p
        out.append(acc)
        k += 1
        p /= k
    return out


def poisson1(u: Column) -> Column:
    """Poisson(1) draw of a uniform in (0, 1): the number of values with a CDF at or below it."""
    out = F.lit(0)
    for threshold in _poisson1_cdf():
        out = out + (u >= F.lit(threshold)).cast("int")
    return out


def bootstrap_lift(groups: DataFrame, n_boot: int = 200, seed: int = 42, ci: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Market-level Poisson bootstrap of the relative lift.

    Markets x replicates are generated with ``explode(sequence(1, B))`` (work
    grows with markets x B, spread over tasks); each replicate is one grouped
    conditional sum; the interval is ``percentile`` over the B replicate values.
    Draws depend on the market's code only, so no global numbering is needed."""
    m = groups.filter(F.col("population").isNotNull()).select(*by, "arm", "dma_code", "conversions", "population")
    reps = m.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    reps = reps.withColumn("_w", poisson1(bootstrap_uniform(F.col("_rep"), F.col("dma_code"), 0, seed)))
    is_c = F.col("arm") == CONTROL
    per = reps.groupBy(*by, "_rep").agg(
        F.sum(F.when(is_c, F.col("_w") * F.col("conversions"))).alias("cv_c"),
        F.sum(F.when(is_c, F.col("_w") * F.col("population"))).alias("n_c"),
        F.sum(F.when(~is_c, F.col("_w") * F.col("conversions"))).alias("cv_t"),
        F.sum(F.when(~is_c, F.col("_w") * F.col("population"))).alias("n_t"),
    )
    lift = safe_ratio(
        safe_ratio(F.col("cv_t"), F.col("n_t")) - safe_ratio(F.col("cv_c"), F.col("n_c")),
        safe_ratio(F.col("cv_c"), F.col("n_c")),
    ) * 100.0
    lo, hi = (1 - ci) / 2, 1 - (1 - ci) / 2
    return per.select(*by, lift.alias("lift")).groupBy(*by).agg(
        F.count("lift").alias("replicates"),
        F.round(F.avg("lift"), 4).alias("mean_lift_pct"),
        F.round(F.percentile("lift", lo), 4).alias("lift_ci_low_pct"),
        F.round(F.percentile("lift", 0.5), 4).alias("lift_median_pct"),
        F.round(F.percentile("lift", hi), 4).alias("lift_ci_high_pct"),
    )


def matched_markets(features: DataFrame, feature: str = "pre_rate", by: Sequence[str] = ()) -> DataFrame:
    """Nearest control market for each treatment market on a pre-period feature.

    Markets are sorted by the feature within each ``by`` key; each treatment market
    looks at the closest control market below and above it (``last``/``first``
    ignoring nulls) - no pairwise cross product.  One window holds the markets of
    one key, a number bounded by the market list.  Ties prefer the lower code;
    markets without a feature are not matched."""
    x = features.filter(F.col(feature).isNotNull())
    w_order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col(feature), F.col("dma_code"))
    below = w_order.rowsBetween(Window.unboundedPreceding, -1)
    above = w_order.rowsBetween(1, Window.unboundedFollowing)
    ctrl_struct = F.when(F.col("arm") == CONTROL, F.struct(F.col(feature).alias("f"), F.col("dma_code").alias("d")))
    x = x.withColumn("_below", F.last(ctrl_struct, ignorenulls=True).over(below)).withColumn(
        "_above", F.first(ctrl_struct, ignorenulls=True).over(above)
    )
    t = x.filter(F.col("arm") == TREATMENT)
    db = F.abs(F.col(feature) - F.col("_below.f"))
    da = F.abs(F.col("_above.f") - F.col(feature))
    pick_below = F.col("_above").isNull() | (
        F.col("_below").isNotNull() & ((db < da) | ((db == da) & (F.col("_below.d") < F.col("_above.d"))))
    )
    match = F.when(pick_below, F.col("_below")).otherwise(F.col("_above"))
    return t.select(
        *by,
        F.col("dma_code").alias("treatment_dma"),
        F.round(F.col(feature), 8).alias("treatment_feature"),
        match["d"].alias("control_dma"),
        F.round(match["f"], 8).alias("control_feature"),
        F.round(F.abs(F.col(feature) - match["f"]), 8).alias("distance"),
    )


def platform_vs_incremental_cac(incrementality: DataFrame, claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost per conversion as the platform claims it and per incremental conversion.

    ``claims`` has platform_spend_usd and platform_conversions per ``by`` key, from
    ``platform_claims``.  Both costs and their ratio are NULL where undefined."""
    j = incrementality.join(claims, list(by), "left") if by else incrementality.crossJoin(claims)
    platform = safe_ratio(F.col("platform_spend_usd"), F.col("platform_conversions"))
    true = F.when(F.col("incremental_conversions") > 0, F.col("incremental_cac_usd"))
    return j.select(
        *by,
        F.round(platform, 2).alias("platform_cac_usd"),
        true.alias("incremental_cac_usd"),
        F.round(safe_ratio(true, platform), 2).alias("cac_multiple"),
        F.round(true - platform, 2).alias("hidden_cost_usd"),
    )


def platform_claims(
    spend: DataFrame, control_markets: DataFrame, start: date, end: date, channel: str = "Meta_Paid_Social", by: Sequence[str] = ()
) -> DataFrame:
    """The tested channel's spend and claimed conversions in non-control markets inside the window."""
    s = spend.filter(
        (F.col("channel") == channel) & (F.col("ad_date") >= F.lit(start)) & (F.col("ad_date") <= F.lit(end))
    ).join(control_markets.select("dma_code"), "dma_code", "left_anti")
    return s.groupBy(*by).agg(
        F.sum("spend_usd").cast("double").alias("platform_spend_usd"),
        F.sum("platform_reported_conversions").cast("long").alias("platform_conversions"),
    )


def pre_period_features(
    conversions: DataFrame, population: DataFrame, control_markets: DataFrame, pre_start: date, start: date, by: Sequence[str] = ()
) -> DataFrame:
    """Per-market pre-period conversions per capita (input of H20); with ``by``, one
    row per key that has pre-period conversions and market."""
    pre = conversions.filter(
        (F.col("converted_at") >= F.lit(pre_start).cast("timestamp_ntz")) & (F.col("converted_at") < F.lit(start).cast("timestamp_ntz"))
    ).groupBy(*by, "dma_code").agg(F.count(F.lit(1)).alias("_n"))
    ctrl = control_markets.select("dma_code", F.lit(True).alias("_ctrl")).distinct()
    markets = pre.select(*by).distinct().crossJoin(population) if by else population
    return (
        markets.join(pre, [*by, "dma_code"], "left")
        .join(ctrl, "dma_code", "left")
        .select(
            *by,
            "dma_code",
            F.when(F.col("_ctrl"), F.lit(CONTROL)).otherwise(F.lit(TREATMENT)).alias("arm"),
            safe_ratio(F.coalesce(F.col("_n"), F.lit(0)), F.col("population")).alias("pre_rate"),
        )
    )
