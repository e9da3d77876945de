"""Registered queries: geo-holdout experiment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.operators import geo
from creditline.functions.columns import PLATFORM_AOV, safe_ratio
from creditline.operators.attribution import spend_by_channel
from creditline.plans.oracle_base import WIN_END_DATE, WIN_END_EXCL, WIN_START, WIN_START_DATE, norm_tail_sql, with_ctes
from creditline.plans.pipeline import Pipeline
from creditline.plans.registry import register
from creditline.sources.adapter import EXPERIMENT_END, EXPERIMENT_START

PRE_START = date(2024, 1, 1)
N_BOOT = 200
BOOT_SEED = 42


def groups(p: Pipeline) -> DataFrame:
    return geo.geo_groups(p.conversions, p.inputs.population, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END)


def spend_total(p: Pipeline) -> DataFrame:
    return geo.treatment_spend(p.spend, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END)


GROUPS_CTES = f"""
win_conv AS (SELECT * FROM stg_conversions WHERE converted_at >= {WIN_START} AND converted_at < {WIN_END_EXCL}),
dma_agg AS (SELECT dma_code, COUNT(*) AS conversions, SUM(order_value_usd) AS revenue_usd FROM win_conv GROUP BY dma_code),
groups AS (
  SELECT d.dma_code,
         CASE WHEN h.dma_code IS NOT NULL THEN 'control' ELSE 'treatment' END AS arm,
         CAST(d.conversions AS BIGINT) AS conversions,
         CAST(COALESCE(d.revenue_usd, 0) AS DOUBLE) AS revenue_usd,
         CAST(p.population AS BIGINT) AS population,
         CAST(d.conversions AS DOUBLE) / NULLIF(CAST(p.population AS DOUBLE), 0) AS conversion_rate
  FROM dma_agg d
  LEFT JOIN population p ON d.dma_code = p.dma_code
  LEFT JOIN (SELECT DISTINCT dma_code FROM holdout) h ON d.dma_code = h.dma_code
),
arm_sums AS (
  SELECT CAST(SUM(CASE WHEN arm = 'control' THEN conversions END) AS DOUBLE) AS cv_c,
         CAST(SUM(CASE WHEN arm = 'control' THEN population END) AS DOUBLE) AS n_c,
         CAST(SUM(CASE WHEN arm = 'treatment' THEN conversions END) AS DOUBLE) AS cv_t,
         CAST(SUM(CASE WHEN arm = 'treatment' THEN population END) AS DOUBLE) AS n_t,
         SUM(CASE WHEN arm = 'treatment' THEN revenue_usd END) AS rev_t,
         COUNT(*) FILTER (WHERE arm = 'control') AS control_markets,
         COUNT(*) FILTER (WHERE arm = 'treatment') AS treatment_markets
  FROM groups
),
tspend AS (
  SELECT CAST(COALESCE(SUM(spend_usd), 0) AS DOUBLE) AS treatment_spend_usd FROM stg_spend
  WHERE channel = 'Meta_Paid_Social' AND ad_date >= {WIN_START_DATE} AND ad_date <= {WIN_END_DATE}
    AND dma_code NOT IN (SELECT dma_code FROM holdout)
)"""


@register("geo_groups", with_ctes(GROUPS_CTES) + "SELECT * FROM groups")
def q_geo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(Pipeline(spark, sf_dir))


@register("dma_population", with_ctes() + "SELECT dma_code, CAST(population AS BIGINT) AS population FROM population")
def q_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(spark, sf_dir).inputs.population.select("dma_code", F.col("population").cast("long"))


@register("dma_population_proxy", with_ctes() + """
SELECT dma_code, COUNT(DISTINCT user_id) AS population FROM stg_touchpoints GROUP BY dma_code""")
def q_population_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.dma_population_proxy(Pipeline(spark, sf_dir).touches)


_INC_SQL = """
SELECT CAST(control_markets AS BIGINT) AS control_markets, CAST(treatment_markets AS BIGINT) AS treatment_markets,
  ROUND(cv_c / NULLIF(n_c, 0) * 100.0, 4) AS baseline_conversion_rate_pct,
  ROUND(exp_b, 0) AS expected_baseline_conversions,
  CAST(cv_t AS BIGINT) AS actual_conversions,
  ROUND(inc, 0) AS incremental_conversions,
  ROUND(inc * aov, 2) AS incremental_revenue_usd,
  ROUND(sp, 2) AS treatment_spend_usd,
  CASE WHEN inc > 0 THEN ROUND(sp / inc, 2) ELSE CAST('inf' AS DOUBLE) END AS incremental_cac_usd,
  CASE WHEN sp > 0 THEN ROUND(inc * aov / sp, 2) ELSE 0.0 END AS incremental_roas,
  ROUND(100.0 - lift, 1) AS organic_share_pct,
  ROUND(lift, 1) AS incremental_lift_pct,
  ROUND(exp_b * 100.0 / NULLIF(cv_t, 0), 1) AS expected_share_of_actual_pct
FROM (
  SELECT *, CASE WHEN exp_b > 0 THEN inc / exp_b * 100.0 ELSE 0.0 END AS lift
  FROM (
    SELECT *, cv_t - exp_b AS inc
    FROM (
      SELECT a.*, n_t * (cv_c / NULLIF(n_c, 0)) AS exp_b, {aov} AS aov,
             COALESCE(t.treatment_spend_usd, 0.0) AS sp
      FROM arm_sums a, tspend t
    )
  )
)"""


@register("geo_incrementality", with_ctes(GROUPS_CTES) + _INC_SQL.format(aov="rev_t / NULLIF(cv_t, 0)"))
def q_geo_incrementality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return geo.geo_incrementality(groups(p), spend_total(p))


@register("geo_incrementality_fixed_aov", with_ctes(GROUPS_CTES) + _INC_SQL.format(aov="160.0"))
def q_geo_incrementality_aov(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return geo.geo_incrementality(groups(p), spend_total(p), aov=160.0)


_Z = "CASE WHEN pooled > 0 AND pooled < 1 THEN (rt - rc) / sqrt(pooled * (1.0 - pooled) * (1.0 / n_t + 1.0 / n_c)) END"


@register("geo_significance", with_ctes(GROUPS_CTES) + f"""
SELECT ROUND(rt * 100.0, 4) AS treatment_conversion_rate_pct, ROUND(rc * 100.0, 4) AS control_conversion_rate_pct,
       ROUND((rt - rc) * 100.0, 4) AS absolute_diff_pct, ROUND(z, 3) AS z_score, ROUND(p, 4) AS p_value,
       p < 0.05 AS statistically_significant, '95%' AS confidence_level
FROM (
  SELECT *, 2.0 * {norm_tail_sql('z')} AS p FROM (
    SELECT *, {_Z} AS z FROM (
      SELECT *, cv_t / NULLIF(n_t, 0) AS rt, cv_c / NULLIF(n_c, 0) AS rc,
             (cv_t + cv_c) / NULLIF(n_t + n_c, 0) AS pooled
      FROM arm_sums)))""")
def q_geo_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.two_proportion_z(groups(Pipeline(spark, sf_dir)))


@register("dma_rate_histogram", with_ctes(GROUPS_CTES) + """
, hx AS (SELECT arm, conversion_rate * 100.0 AS x FROM groups WHERE conversion_rate IS NOT NULL),
hs AS (
  SELECT arm, CASE arm WHEN 'control' THEN 8 WHEN 'treatment' THEN 12 END AS n,
         CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM hx GROUP BY arm
),
hb AS (SELECT hx.arm, least(CAST(floor((x - lo) / ((hi - lo) / n)) AS INTEGER) + 1, n) AS bin FROM hx JOIN hs ON hx.arm = hs.arm),
hc AS (SELECT arm, bin, COUNT(*) AS cnt FROM hb GROUP BY arm, bin),
grid AS (SELECT arm, UNNEST(range(1, n + 1)) AS bin, lo, hi, n FROM hs)
SELECT g.arm, CAST(g.bin AS INTEGER) AS bin, ROUND(lo + (g.bin - 1) * (hi - lo) / n, 6) AS bin_low_pct,
       ROUND(lo + g.bin * (hi - lo) / n, 6) AS bin_high_pct, CAST(COALESCE(cnt, 0) AS BIGINT) AS dma_count
FROM grid g LEFT JOIN hc ON g.arm = hc.arm AND g.bin = hc.bin""")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.rate_histogram(groups(Pipeline(spark, sf_dir)))


@register("dma_rate_quartiles", with_ctes(GROUPS_CTES) + """
SELECT arm, CAST(COUNT(*) AS BIGINT) AS markets, ROUND(min(conversion_rate), 8) AS min_rate,
       ROUND(quantile_cont(conversion_rate, 0.25), 8) AS q1_rate,
       ROUND(quantile_cont(conversion_rate, 0.5), 8) AS median_rate,
       ROUND(quantile_cont(conversion_rate, 0.75), 8) AS q3_rate,
       ROUND(max(conversion_rate), 8) AS max_rate
FROM groups WHERE conversion_rate IS NOT NULL GROUP BY arm""")
def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.rate_quartiles(groups(Pipeline(spark, sf_dir)))


@register("arm_rates_long", with_ctes(GROUPS_CTES) + """
SELECT 'Control (Meta OFF)' AS "group", dma_code, conversions, population, conversion_rate FROM groups WHERE arm = 'control'
UNION ALL
SELECT 'Treatment (Meta ON)' AS "group", dma_code, conversions, population, conversion_rate FROM groups WHERE arm = 'treatment'""")
def q_arm_rates_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.arm_rates_long(groups(Pipeline(spark, sf_dir)))


@register("holdout_contamination", with_ctes() + f"""
SELECT * FROM stg_touchpoints
WHERE channel = 'Meta_Paid_Social' AND event_timestamp >= {WIN_START} AND event_timestamp < {WIN_END_EXCL}
  AND dma_code IN (SELECT dma_code FROM holdout)""")
def q_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return geo.holdout_contamination(p.touches, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END)


@register("holdout_contamination_treatment_check", with_ctes() + f"""
SELECT dma_code, COUNT(*) AS meta_touches FROM stg_touchpoints
WHERE channel = 'Meta_Paid_Social' AND event_timestamp >= {WIN_START} AND event_timestamp < {WIN_END_EXCL}
GROUP BY dma_code""")
def q_meta_touch_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paused-channel touches per market in the window: control markets must be absent."""
    t = Pipeline(spark, sf_dir).touches
    return (
        t.filter((F.col("channel") == "Meta_Paid_Social") & geo.window_filter(F.col("event_timestamp"), EXPERIMENT_START, EXPERIMENT_END))
        .groupBy("dma_code").agg(F.count(F.lit(1)).alias("meta_touches"))
    )


# Standard normal quantiles, as printed in statistical tables.
_Z975, _Z80 = "1.959963984540054", "0.8416212335729143"


@register("lift_ci", with_ctes(GROUPS_CTES) + """
SELECT ROUND(d * 100.0, 4) AS diff_pct, ROUND((d - {z} * se) * 100.0, 4) AS diff_ci_low_pct,
       ROUND((d + {z} * se) * 100.0, 4) AS diff_ci_high_pct,
       ROUND(d * 100.0 / NULLIF(rc, 0), 2) AS relative_lift_pct,
       ROUND((d - {z} * se) * 100.0 / NULLIF(rc, 0), 2) AS relative_lift_low_pct,
       ROUND((d + {z} * se) * 100.0 / NULLIF(rc, 0), 2) AS relative_lift_high_pct
FROM (SELECT *, rt - rc AS d, CASE WHEN rt BETWEEN 0 AND 1 AND rc BETWEEN 0 AND 1
                                   THEN sqrt(rt * (1.0 - rt) / n_t + rc * (1.0 - rc) / n_c) END AS se
      FROM (SELECT *, cv_t / NULLIF(n_t, 0) AS rt, cv_c / NULLIF(n_c, 0) AS rc FROM arm_sums))""".replace("{z}", _Z975))
def q_lift_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.lift_ci(groups(Pipeline(spark, sf_dir)))


@register("mde", with_ctes(GROUPS_CTES) + f"""
SELECT ROUND(rc * 100.0, 4) AS baseline_rate_pct, ROUND(m * 100.0, 4) AS mde_abs_pct,
       ROUND(m * 100.0 / NULLIF(rc, 0), 2) AS mde_rel_pct
FROM (SELECT *, ({_Z975} + {_Z80}) * CASE WHEN rc BETWEEN 0 AND 1
                                          THEN sqrt(rc * (1.0 - rc) * (1.0 / n_t + 1.0 / n_c)) END AS m
      FROM (SELECT *, cv_c / NULLIF(n_c, 0) AS rc FROM arm_sums))""")
def q_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.minimum_detectable_effect(groups(Pipeline(spark, sf_dir)))


@register("did", with_ctes() + f"""
, dconv AS (
  SELECT CASE WHEN h.dma_code IS NOT NULL THEN 'control' ELSE 'treatment' END AS arm,
         CASE WHEN converted_at >= TIMESTAMP '{PRE_START.isoformat()}' AND converted_at < {WIN_START} THEN 'pre'
              WHEN converted_at >= {WIN_START} AND converted_at < {WIN_END_EXCL} THEN 'post' END AS period
  FROM stg_conversions c LEFT JOIN holdout h ON c.dma_code = h.dma_code
),
dcount AS (SELECT arm, period, COUNT(*) AS n FROM dconv WHERE period IS NOT NULL GROUP BY 1, 2),
dpop AS (
  SELECT CASE WHEN h.dma_code IS NOT NULL THEN 'control' ELSE 'treatment' END AS arm, SUM(population) AS pop
  FROM population p LEFT JOIN holdout h ON p.dma_code = h.dma_code GROUP BY 1
),
drate AS (
  SELECT d.arm, d.period, CAST(d.n AS DOUBLE) / CAST(p.pop AS DOUBLE)
         / CASE WHEN d.period = 'pre' THEN {float((EXPERIMENT_START - PRE_START).days)!r}
                ELSE {float((EXPERIMENT_END - EXPERIMENT_START).days + 1)!r} END AS rate
  FROM dcount d JOIN dpop p ON d.arm = p.arm
),
dwide AS (
  SELECT max(CASE WHEN arm = 'control' AND period = 'pre' THEN rate END) AS c_pre,
         max(CASE WHEN arm = 'control' AND period = 'post' THEN rate END) AS c_post,
         max(CASE WHEN arm = 'treatment' AND period = 'pre' THEN rate END) AS t_pre,
         max(CASE WHEN arm = 'treatment' AND period = 'post' THEN rate END) AS t_post
  FROM drate
)
SELECT ROUND(c_pre * 1000000.0, 4) AS c_pre_rate_ppm, ROUND(c_post * 1000000.0, 4) AS c_post_rate_ppm,
       ROUND(t_pre * 1000000.0, 4) AS t_pre_rate_ppm, ROUND(t_post * 1000000.0, 4) AS t_post_rate_ppm,
       ROUND(((t_post - t_pre) - (c_post - c_pre)) * 1000000.0, 4) AS did_ppm
FROM dwide""")
def q_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return geo.difference_in_differences(
        p.conversions, p.inputs.population, p.inputs.holdout_markets, PRE_START, EXPERIMENT_START, EXPERIMENT_END
    )


@register("matched_markets", with_ctes() + f"""
, pre AS (
  SELECT dma_code, COUNT(*) AS n FROM stg_conversions
  WHERE converted_at >= TIMESTAMP '{PRE_START.isoformat()}' AND converted_at < {WIN_START} GROUP BY dma_code
),
feat AS (
  SELECT p.dma_code, CASE WHEN h.dma_code IS NOT NULL THEN 'control' ELSE 'treatment' END AS arm,
         CAST(COALESCE(pre.n, 0) AS DOUBLE) / NULLIF(CAST(p.population AS DOUBLE), 0) AS pre_rate
  FROM population p LEFT JOIN pre ON p.dma_code = pre.dma_code LEFT JOIN holdout h ON p.dma_code = h.dma_code
),
nb AS (
  SELECT *,
    last_value(CASE WHEN arm = 'control' THEN pre_rate END IGNORE NULLS) OVER
      (ORDER BY pre_rate, dma_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
    last_value(CASE WHEN arm = 'control' THEN dma_code END IGNORE NULLS) OVER
      (ORDER BY pre_rate, dma_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bd,
    first_value(CASE WHEN arm = 'control' THEN pre_rate END IGNORE NULLS) OVER
      (ORDER BY pre_rate, dma_code ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af,
    first_value(CASE WHEN arm = 'control' THEN dma_code END IGNORE NULLS) OVER
      (ORDER BY pre_rate, dma_code ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ad
  FROM feat
),
pick AS (
  SELECT *, (ad IS NULL OR (bd IS NOT NULL AND (abs(pre_rate - bf) < abs(af - pre_rate)
             OR (abs(pre_rate - bf) = abs(af - pre_rate) AND bd < ad)))) AS use_below
  FROM nb WHERE arm = 'treatment'
)
SELECT dma_code AS treatment_dma, ROUND(pre_rate, 8) AS treatment_feature,
       CASE WHEN use_below THEN bd ELSE ad END AS control_dma,
       ROUND(CASE WHEN use_below THEN bf ELSE af END, 8) AS control_feature,
       ROUND(abs(pre_rate - CASE WHEN use_below THEN bf ELSE af END), 8) AS distance
FROM pick""")
def q_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    feats = geo.pre_period_features(p.conversions, p.inputs.population, p.inputs.holdout_markets, PRE_START, EXPERIMENT_START)
    return geo.matched_markets(feats)


def bootstrap_sql(groups: str, by: str = "") -> str:
    """Poisson bootstrap of ``groups``; the draw counts the Poisson(1) CDF values at or below the uniform."""
    key = f"{by}, " if by else ""
    return f"""
pois AS (SELECT k, SUM(exp(-1.0) / gamma(k + 1.0)) OVER (ORDER BY k) AS cdf FROM range(0, 25) t(k)),
pois_all AS (SELECT list(cdf) AS cdfs FROM pois),
bm AS (SELECT {key}arm, dma_code, conversions, population FROM {groups} WHERE population IS NOT NULL),
br AS (SELECT *, UNNEST(range(1, {N_BOOT + 1})) AS rep FROM bm),
bh AS (SELECT *, md5('{BOOT_SEED}:0:' || rep || ':' || dma_code) AS h FROM br),
bu AS (SELECT bh.*, (list_sum(list_transform(range(1, 14), lambda i: (strpos('0123456789abcdef', h[i:i]) - 1) * pow(16.0, 13 - i))) + 0.5) / pow(2.0, 52) AS u,
              cdfs FROM bh, pois_all),
bw AS (SELECT *, len(list_filter(cdfs, lambda x: x <= u)) AS w FROM bu),
bs AS (
  SELECT {key}rep,
    CAST(SUM(CASE WHEN arm = 'control' THEN w * conversions END) AS DOUBLE) AS cv_c,
    CAST(SUM(CASE WHEN arm = 'control' THEN w * population END) AS DOUBLE) AS n_c,
    CAST(SUM(CASE WHEN arm <> 'control' THEN w * conversions END) AS DOUBLE) AS cv_t,
    CAST(SUM(CASE WHEN arm <> 'control' THEN w * population END) AS DOUBLE) AS n_t
  FROM bw GROUP BY {key}rep
),
bl AS (
  SELECT {key}((cv_t / NULLIF(n_t, 0)) - (cv_c / NULLIF(n_c, 0))) / NULLIF(cv_c / NULLIF(n_c, 0), 0) * 100.0 AS lift FROM bs
)
SELECT {key}COUNT(lift) AS replicates, ROUND(avg(lift), 4) AS mean_lift_pct,
       ROUND(quantile_cont(lift, 0.025), 4) AS lift_ci_low_pct,
       ROUND(quantile_cont(lift, 0.5), 4) AS lift_median_pct,
       ROUND(quantile_cont(lift, 0.975), 4) AS lift_ci_high_pct
FROM bl{f' GROUP BY {by}' if by else ''}"""


@register("bootstrap_lift", with_ctes(GROUPS_CTES).rstrip() + "," + bootstrap_sql("groups"))
def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.bootstrap_lift(groups(Pipeline(spark, sf_dir)), N_BOOT, BOOT_SEED)


@register("overstatement", with_ctes(GROUPS_CTES) + """
, inc AS (
  SELECT CASE WHEN sp > 0 THEN ROUND(i * aov / sp, 2) ELSE 0.0 END AS incremental_roas FROM (
    SELECT cv_t - n_t * (cv_c / NULLIF(n_c, 0)) AS i, rev_t / NULLIF(cv_t, 0) AS aov,
           COALESCE(t.treatment_spend_usd, 0.0) AS sp FROM arm_sums a, tspend t)
),
plat AS (
  SELECT ROUND(CAST(SUM(platform_reported_conversions) AS BIGINT) * 160.0 / NULLIF(CAST(SUM(spend_usd) AS DOUBLE), 0), 2)
         AS platform_roas
  FROM stg_spend WHERE channel = 'Meta_Paid_Social'
)
SELECT platform_roas, incremental_roas,
       ROUND((platform_roas - incremental_roas) * 100.0 / NULLIF(incremental_roas, 0), 0) AS overstatement_vs_true_pct,
       ROUND((platform_roas - incremental_roas) * 100.0 / NULLIF(platform_roas, 0), 0) AS overstatement_vs_platform_pct,
       ROUND((1.0 - incremental_roas / NULLIF(platform_roas, 0)) * 100.0, 1) AS cannibalization_pct
FROM plat, inc""")
def q_overstatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    inc = geo.geo_incrementality(groups(p), spend_total(p)).select("incremental_roas")
    plat = (
        spend_by_channel(p.spend)
        .filter(F.col("channel") == "Meta_Paid_Social")
        .select(
            F.round(safe_ratio(F.col("total_platform_conversions") * F.lit(PLATFORM_AOV), F.col("total_spend_usd")), 2)
            .alias("platform_roas")
        )
    )
    j = plat.crossJoin(inc)
    pr, ir = F.col("platform_roas"), F.col("incremental_roas")
    return j.select(
        "platform_roas",
        "incremental_roas",
        F.round(geo.overstatement(pr, ir, "true"), 0).alias("overstatement_vs_true_pct"),
        F.round(geo.overstatement(pr, ir, "platform"), 0).alias("overstatement_vs_platform_pct"),
        F.round(geo.cannibalization(ir, pr), 1).alias("cannibalization_pct"),
    )
