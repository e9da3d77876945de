"""Registered queries with ``by`` keys, variants, injected violations and extracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.functions.columns import GUIDE_ALIASES
from creditline.operators import budget, geo, quality, spend
from creditline.operators.attribution import attribute, model_mart, new_to_brand
from creditline.operators.journeys import dedup_touchpoints, eligible_pairs, near_duplicates_removed
from creditline.operators.staging import stage_touchpoints, stage_touchpoints_display
from creditline.plans.oracle_base import WIN_END_DATE, WIN_END_EXCL, WIN_START, WIN_START_DATE, canonical_channel_sql, norm_tail_sql, with_ctes
from creditline.plans.pipeline import Pipeline
from creditline.plans.q_core import _r2, credits_sql
from creditline.plans.q_geo import BOOT_SEED, GROUPS_CTES, N_BOOT, PRE_START, bootstrap_sql, groups, spend_total
from creditline.plans.q_more import _DISPLAY_SQL
from creditline.plans.registry import register
from creditline.sources.adapter import EXPERIMENT_END, EXPERIMENT_START, read_table
from creditline.sources.raw import extract_completed_orders, extract_daily_spend, extract_sessions

# ------------------------------------------------- experiments by week -----


def _week(ts: str) -> Column:
    return F.date_format(spend.week_of(F.col(ts)), "yyyy-MM-dd")


def _week_sql(ts: str) -> str:
    return f"CAST(CAST(date_trunc('week', {ts}) AS DATE) AS VARCHAR)"


WEEK_CTES = f"""
wk_agg AS (SELECT {_week_sql('converted_at')} AS week, dma_code, COUNT(*) AS conversions, SUM(order_value_usd) AS revenue_usd
           FROM stg_conversions WHERE converted_at >= {WIN_START} AND converted_at < {WIN_END_EXCL} GROUP BY 1, 2),
wk_groups AS (
  SELECT a.week, a.dma_code, CASE WHEN h.dma_code IS NOT NULL THEN 'control' ELSE 'treatment' END AS arm,
         a.conversions, CAST(a.revenue_usd AS DOUBLE) AS revenue_usd, p.population
  FROM wk_agg a LEFT JOIN population p ON a.dma_code = p.dma_code LEFT JOIN holdout h ON a.dma_code = h.dma_code
),
wk_arms AS (
  SELECT week, CAST(SUM(conversions) FILTER (WHERE arm = 'control') AS DOUBLE) AS cv_c,
         CAST(SUM(population) FILTER (WHERE arm = 'control') AS DOUBLE) AS n_c,
         CAST(SUM(conversions) FILTER (WHERE arm = 'treatment') AS DOUBLE) AS cv_t,
         CAST(SUM(population) FILTER (WHERE arm = 'treatment') AS DOUBLE) AS n_t,
         SUM(revenue_usd) FILTER (WHERE arm = 'treatment') AS rev_t
  FROM wk_groups GROUP BY week
),
wk_spend AS (
  SELECT {_week_sql('ad_date')} AS week, CAST(SUM(spend_usd) AS DOUBLE) AS sp,
         CAST(SUM(platform_reported_conversions) AS BIGINT) AS claims
  FROM stg_spend WHERE channel = 'Meta_Paid_Social' AND ad_date >= {WIN_START_DATE} AND ad_date <= {WIN_END_DATE}
    AND dma_code NOT IN (SELECT dma_code FROM holdout) GROUP BY 1
),
wk AS (
  SELECT a.*, COALESCE(s.sp, 0.0) AS sp, s.claims, n_t * (cv_c / NULLIF(n_c, 0)) AS expected,
         cv_t - n_t * (cv_c / NULLIF(n_c, 0)) AS inc, rev_t / NULLIF(cv_t, 0) AS aov
  FROM wk_arms a LEFT JOIN wk_spend s ON a.week = s.week
)"""


def _week_groups(p: Pipeline) -> DataFrame:
    conv = p.conversions.withColumn("week", _week("converted_at"))
    return geo.geo_groups(conv, p.inputs.population, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END, by=["week"])


def _week_incrementality(p: Pipeline) -> DataFrame:
    cost = geo.treatment_spend(p.spend.withColumn("week", _week("ad_date")), p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END, by=["week"])
    return geo.geo_incrementality(_week_groups(p), cost, by=["week"])


@register("geo_incrementality_by", with_ctes(WEEK_CTES) + """
SELECT week, ROUND(cv_c / NULLIF(n_c, 0) * 100.0, 4) AS baseline_conversion_rate_pct, ROUND(expected, 0) AS expected_baseline_conversions,
       CAST(cv_t AS BIGINT) AS actual_conversions, ROUND(inc, 0) AS incremental_conversions,
       ROUND(inc * aov, 2) AS incremental_revenue_usd, ROUND(sp, 2) AS treatment_spend_usd,
       CASE WHEN inc > 0 THEN ROUND(sp / inc, 2) ELSE CAST('inf' AS DOUBLE) END AS incremental_cac_usd,
       CASE WHEN sp > 0 THEN ROUND(inc * aov / sp, 2) ELSE 0.0 END AS incremental_roas
FROM wk""")
def q_incrementality_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week_incrementality(Pipeline(spark, sf_dir)).select(
        "week", "baseline_conversion_rate_pct", "expected_baseline_conversions", "actual_conversions", "incremental_conversions",
        "incremental_revenue_usd", "treatment_spend_usd", "incremental_cac_usd", "incremental_roas")


@register("geo_significance_by", with_ctes(WEEK_CTES) + f"""
SELECT week, ROUND(rt * 100.0, 4) AS treatment_conversion_rate_pct, ROUND(rc * 100.0, 4) AS control_conversion_rate_pct,
       ROUND(z, 3) AS z_score, ROUND(2.0 * {norm_tail_sql('z')}, 4) AS p_value
FROM (SELECT *, CASE WHEN po > 0 AND po < 1 THEN (rt - rc) / NULLIF(sqrt(po * (1.0 - po) * (1.0 / n_t + 1.0 / n_c)), 0) END AS z
      FROM (SELECT *, cv_t / NULLIF(n_t, 0) AS rt, cv_c / NULLIF(n_c, 0) AS rc, (cv_t + cv_c) / NULLIF(n_t + n_c, 0) AS po FROM wk_arms))""")
def q_significance_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.two_proportion_z(_week_groups(Pipeline(spark, sf_dir)), by=["week"]).select(
        "week", "treatment_conversion_rate_pct", "control_conversion_rate_pct", "z_score", "p_value")


@register("bootstrap_lift_by", with_ctes(WEEK_CTES).rstrip() + "," + bootstrap_sql("wk_groups", "week"))
def q_bootstrap_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.bootstrap_lift(_week_groups(Pipeline(spark, sf_dir)), N_BOOT, BOOT_SEED, by=["week"])


@register("matched_markets_by", with_ctes() + f"""
, seg AS (SELECT user_id % 3 AS segment, dma_code, COUNT(*) AS n FROM stg_conversions
          WHERE converted_at >= TIMESTAMP '{PRE_START.isoformat()}' AND converted_at < {WIN_START} GROUP BY 1, 2),
feat AS (
  SELECT s.segment, p.dma_code, h.dma_code IS NOT NULL AS is_control,
         CAST(COALESCE(seg.n, 0) AS DOUBLE) / NULLIF(CAST(p.population AS DOUBLE), 0) AS f
  FROM (SELECT DISTINCT segment FROM seg) s CROSS JOIN population p
  LEFT JOIN seg ON seg.segment = s.segment AND seg.dma_code = p.dma_code LEFT JOIN holdout h ON h.dma_code = p.dma_code
),
near AS (
  SELECT t.segment, t.dma_code AS treatment_dma, t.f AS tf, c.dma_code AS control_dma, c.f AS cf,
         row_number() OVER (PARTITION BY t.segment, t.dma_code ORDER BY abs(t.f - c.f)) AS nth,
         rank() OVER (PARTITION BY t.segment, t.dma_code ORDER BY abs(t.f - c.f)) AS place
  FROM feat t JOIN feat c ON t.segment = c.segment AND c.is_control WHERE NOT t.is_control
)
SELECT segment, treatment_dma, ROUND(MIN(tf), 8) AS treatment_feature, ROUND(MIN(abs(tf - cf)), 8) AS distance
FROM near WHERE place = 1 GROUP BY 1, 2""")
def q_matched_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle finds the nearest distance by brute force; ties between controls are tested in pytest."""
    p = Pipeline(spark, sf_dir)
    conv = p.conversions.withColumn("segment", F.col("user_id") % 3)
    feats = geo.pre_period_features(conv, p.inputs.population, p.inputs.holdout_markets, PRE_START, EXPERIMENT_START, by=["segment"])
    return geo.matched_markets(feats, by=["segment"]).select("segment", "treatment_dma", "treatment_feature", "distance")


@register("scenario_grid_by", with_ctes(WEEK_CTES) + """
, al AS (SELECT """ + _week_sql("ad_date") + """ AS week,
  CAST(SUM(CASE WHEN channel = 'Meta_Paid_Social' THEN spend_usd END) AS DOUBLE) AS m,
  CAST(SUM(CASE WHEN channel = 'Google_Paid_Search' THEN spend_usd END) AS DOUBLE) AS g,
  CAST(SUM(CASE WHEN channel = 'TikTok_Ads' THEN spend_usd END) AS DOUBLE) AS t FROM stg_spend GROUP BY 1),
ro AS (SELECT week, CASE WHEN sp > 0 THEN ROUND(inc * aov / sp, 2) ELSE 0.0 END AS rm FROM wk),
st AS (SELECT al.*, rm, UNNEST(range(0, 8)) AS step FROM al LEFT JOIN ro ON al.week = ro.week),
sc AS (SELECT st.*, v.split, v.gs, v.ts, step / 7.0 * (m * 0.5711) AS shift FROM st, (VALUES
  ('50% Google / 50% TikTok', 0.5, 0.5), ('100% Google Search', 1.0, 0.0), ('100% TikTok Ads', 0.0, 1.0)) v(split, gs, ts))
SELECT week, ROUND(shift, 4) AS shift_usd, split, channel, ROUND(cur, 2) AS current_spend, ROUND(sim, 2) AS sim_spend,
       ROUND(sim * r - cur * r, 2) AS revenue_delta
FROM (SELECT week, shift, split, 'Meta_Paid_Social' AS channel, m AS cur, m - shift AS sim, rm AS r FROM sc
      UNION ALL SELECT week, shift, split, 'Google_Paid_Search', g, g + shift * CAST(gs AS DOUBLE), CAST(2.65 AS DOUBLE) FROM sc
      UNION ALL SELECT week, shift, split, 'TikTok_Ads', t, t + shift * CAST(ts AS DOUBLE), CAST(2.1 AS DOUBLE) FROM sc)
WHERE week IN (SELECT week FROM ro)""")
def q_grid_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    roas = budget.true_roas_row(_week_incrementality(p).select("week", "incremental_roas"), by=["week"])
    alloc = budget.current_allocation(p.spend.withColumn("week", _week("ad_date")), by=["week"])
    grid = budget.scenario_grid(alloc, roas, max_share=0.5711, n_steps=7, by=["week"])
    return grid.join(roas.select("week"), "week", "left_semi").select(
        "week", F.round("shift_usd", 4).alias("shift_usd"), "split", "channel", "current_spend", "sim_spend", "revenue_delta")


@register("attribution_by", with_ctes() + f"""
, wp AS (SELECT *, {_week_sql('conversion_ts')} AS week FROM pairs),
ws AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conversion_id ORDER BY touchpoint_ts, event_id) AS a,
         ROW_NUMBER() OVER (PARTITION BY conversion_id ORDER BY touchpoint_ts DESC, event_id DESC) AS z,
         COUNT(*) OVER (PARTITION BY conversion_id) AS n,
         pow(2.0, -(date_diff('microsecond', touchpoint_ts, conversion_ts) / 86400000000.0) / 7.0) AS w FROM wp
),
ww AS (SELECT *, SUM(w) OVER (PARTITION BY conversion_id) AS sw FROM ws)
SELECT week, channel, COUNT(DISTINCT conversion_id) AS attributed_conversions, COUNT(DISTINCT user_id) AS attributed_users,
       {_r2('SUM(CASE WHEN a = 1 THEN order_value_usd ELSE 0 END)')} AS first_touch_revenue,
       {_r2('SUM(CASE WHEN z = 1 THEN order_value_usd ELSE 0 END)')} AS last_touch_revenue,
       {_r2('SUM(CAST(order_value_usd AS DOUBLE) / n)')} AS linear_revenue,
       {_r2('SUM(CAST(order_value_usd AS DOUBLE) * w / sw)')} AS time_decay_revenue
FROM ww GROUP BY 1, 2""")
def q_attribution_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Pipeline(spark, sf_dir).pairs(90).withColumn("week", _week("conversion_ts"))
    c = attribute(pairs, by=["week"], max_age_days=90)
    revenue = [F.round(F.col(f"{m}_revenue").cast("double"), 2).alias(f"{m}_revenue") for m in ("first_touch", "last_touch", "linear", "time_decay")]
    return c.select("week", "channel", F.col("attributed_conversions").cast("long").alias("attributed_conversions"),
                    F.col("attributed_users").cast("long").alias("attributed_users"), *revenue)


@register("overview_by", with_ctes() + f"""
SELECT COALESCE(s.week, c.week) AS week, ROUND(sp, 2) AS total_spend, n AS total_actual_convs, pc AS total_platform_convs,
       ROUND(rev, 2) AS total_revenue, ROUND(rev / NULLIF(sp, 0), 2) AS blended_actual_roas
FROM (SELECT {_week_sql('ad_date')} AS week, CAST(SUM(spend_usd) AS DOUBLE) AS sp,
             CAST(SUM(platform_reported_conversions) AS BIGINT) AS pc FROM stg_spend GROUP BY 1) s
FULL JOIN (SELECT {_week_sql('converted_at')} AS week, COUNT(*) AS n, CAST(SUM(order_value_usd) AS DOUBLE) AS rev
           FROM stg_conversions GROUP BY 1) c ON s.week = c.week""")
def q_overview_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.overview(p.conversions.withColumn("week", _week("converted_at")), p.spend.withColumn("week", _week("ad_date")), by=["week"]).select(
        "week", "total_spend", "total_actual_convs", "total_platform_convs", "total_revenue", "blended_actual_roas")


# ------------------------------------------------------------ variants -----

@register("platform_vs_incremental_cac", with_ctes(WEEK_CTES) + """
SELECT week, ROUND(sp / NULLIF(claims, 0), 2) AS platform_cac_usd, CASE WHEN ROUND(inc, 0) > 0 THEN ROUND(sp / inc, 2) END AS incremental_cac_usd
FROM wk""")
def q_cac(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    claims = geo.platform_claims(p.spend.withColumn("week", _week("ad_date")), p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END, by=["week"])
    return geo.platform_vs_incremental_cac(_week_incrementality(p), claims, by=["week"]).select("week", "platform_cac_usd", "incremental_cac_usd")


@register("new_to_brand", with_ctes() + """
SELECT channel, COUNT(*) AS touched_users, COUNT(*) FILTER (WHERE fk = uk) AS new_to_brand_users,
       ROUND(COUNT(*) FILTER (WHERE fk = uk) * 100.0 / COUNT(*), 2) AS new_to_brand_pct
FROM (SELECT *, min(fk) OVER (PARTITION BY user_id) AS uk FROM (
  SELECT user_id, channel, min((event_timestamp, event_id)) AS fk FROM deduped WHERE user_id IS NOT NULL GROUP BY 1, 2)) GROUP BY channel""")
def q_new_to_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_to_brand(Pipeline(spark, sf_dir).deduped)


@register("cac_payback", with_ctes() + f"""
, fo AS (SELECT user_id, min(converted_at) AS f FROM stg_conversions GROUP BY 1),
co AS (SELECT {_week_sql('f')} AS wk, CAST(floor(datediff('day', f, converted_at) / 7) AS INTEGER) AS age, c.user_id, order_value_usd
       FROM stg_conversions c JOIN fo ON c.user_id = fo.user_id),
ages AS (SELECT wk, age, CAST(SUM(order_value_usd) AS DOUBLE) AS rev FROM co GROUP BY 1, 2),
users AS (SELECT wk, COUNT(DISTINCT user_id) AS n FROM co WHERE age = 0 GROUP BY 1),
life AS (SELECT a.wk, a.age, u.n, ROUND(SUM(rev) OVER (PARTITION BY a.wk ORDER BY a.age) / u.n, 2) AS ltv FROM ages a JOIN users u ON a.wk = u.wk),
cac AS (SELECT s.wk, ROUND(sp / NULLIF(CAST(n AS DOUBLE), 0), 2) AS cac
        FROM (SELECT {_week_sql('ad_date')} AS wk, CAST(SUM(spend_usd) AS DOUBLE) AS sp FROM stg_spend GROUP BY 1) s
        JOIN (SELECT {_week_sql('converted_at')} AS wk, COUNT(*) AS n FROM stg_conversions GROUP BY 1) c ON s.wk = c.wk)
SELECT life.wk AS cohort_week, n AS cohort_users, cac AS blended_cac, max_by(ltv, age) AS ltv_to_date,
       MIN(CASE WHEN ltv >= cac THEN age END) AS payback_weeks
FROM life LEFT JOIN cac ON life.wk = cac.wk GROUP BY 1, 2, 3""")
def q_payback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.cac_payback(spend.cohort_ltv(p.conversions), spend.weekly_blended_cac(p.spend, p.conversions))


@register("linear_display", with_ctes(f"""
dsp AS (SELECT event_id, user_id, "timestamp" AS event_timestamp, {_DISPLAY_SQL} AS channel, dma_code FROM raw_touchpoints),
dd AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_timestamp, channel ORDER BY event_id) AS rn
                      FROM dsp WHERE channel IS NOT NULL) WHERE rn = 1),
dpairs AS (SELECT t.user_id, t.event_id, t.channel, t.event_timestamp AS touchpoint_ts, c.conversion_id, c.converted_at AS conversion_ts,
                  c.order_value_usd
           FROM dd t JOIN stg_conversions c ON t.user_id = c.user_id
           WHERE t.event_timestamp <= c.converted_at AND t.event_timestamp >= c.converted_at - INTERVAL 90 DAY)""",
    credits_sql(pairs="dpairs", name="dcredits")) + f"""
SELECT channel, CAST(attributed_conversions AS BIGINT) AS attributed_conversions, CAST(attributed_users AS BIGINT) AS attributed_users,
       {_r2('linear_revenue')} AS attributed_revenue_usd FROM dcredits""")
def q_linear_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard path end to end: display map, dedup, pairs, credits."""
    p = Pipeline(spark, sf_dir)
    touches = dedup_touchpoints(stage_touchpoints_display(p.inputs.raw_touchpoints))
    return model_mart(attribute(eligible_pairs(touches, p.conversions), max_age_days=90), "linear")


@register("channel_counts_guide_map", with_ctes() + f"""
SELECT {canonical_channel_sql('channel', GUIDE_ALIASES)} AS channel, COUNT(*) AS touches FROM raw_touchpoints GROUP BY 1""")
def q_guide_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stage_touchpoints(Pipeline(spark, sf_dir).inputs.raw_touchpoints, GUIDE_ALIASES)
    return t.groupBy("channel").agg(F.count(F.lit(1)).alias("touches"))


@register("geo_groups_midnight", with_ctes() + f"""
SELECT dma_code, COUNT(*) AS conversions FROM stg_conversions
WHERE converted_at >= {WIN_START} AND converted_at <= CAST({WIN_END_DATE} AS TIMESTAMP) GROUP BY 1""")
def q_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    g = geo.geo_groups(p.conversions, p.inputs.population, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END, end_inclusive_day=False)
    return g.select("dma_code", "conversions")


@register("geo_groups_known_population", with_ctes(GROUPS_CTES) + "SELECT * FROM groups WHERE population % 2 = 0")
def q_known_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    known = p.inputs.population.filter(F.col("population") % 2 == 0)
    return geo.geo_groups(p.conversions, known, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END, population_join="inner")


@register("geo_incrementality_nan", with_ctes(WEEK_CTES) + """
SELECT week, CASE WHEN inc > 0 THEN ROUND(0.0 / inc, 2) ELSE CAST('nan' AS DOUBLE) END AS incremental_cac_usd,
       CAST('nan' AS DOUBLE) AS incremental_roas FROM wk""")
def q_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment whose channel had no spend: ratios are not numbers."""
    p = Pipeline(spark, sf_dir)
    none = geo.treatment_spend(p.spend.withColumn("week", _week("ad_date")), p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END,
                               channel="Unknown", by=["week"])
    return geo.geo_incrementality(_week_groups(p), none, by=["week"], on_zero="nan").select("week", "incremental_cac_usd", "incremental_roas")


# ------------------------------------- quality checks on planted faults -----

@register("dq_not_null_planted", with_ctes() + "SELECT event_id FROM stg_touchpoints WHERE event_id % 50 = 0")
def q_planted_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Pipeline(spark, sf_dir).touches
    t = t.withColumn("user_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")))
    return quality.check_not_null(t, ["event_id", "user_id", "channel"]).select("event_id")


@register("dq_unique_planted", with_ctes() + """
SELECT event_id, COUNT(*) AS occurrences FROM (SELECT event_id - event_id % 2 AS event_id FROM deduped) GROUP BY 1 HAVING COUNT(*) > 1""")
def q_planted_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Pipeline(spark, sf_dir).deduped.withColumn("event_id", F.col("event_id") - F.col("event_id") % 2)
    return quality.check_unique(t, ["event_id"])


@register("dq_unique_conversion_planted", with_ctes() + "SELECT conversion_id, 2 AS occurrences FROM stg_conversions WHERE conversion_id % 10 = 0")
def q_planted_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Pipeline(spark, sf_dir).conversions
    again = c.withColumn("copy", F.explode(F.when(F.col("conversion_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return quality.check_unique(again, ["conversion_id"]).withColumn("occurrences", F.col("occurrences").cast("int"))


@register("dq_accepted_planted", with_ctes() + "SELECT event_id, 'Snap_Ads' AS channel FROM stg_touchpoints WHERE event_id % 40 = 0")
def q_planted_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditline.functions.columns import CHANNEL_ALIASES

    t = Pipeline(spark, sf_dir).touches
    t = t.withColumn("channel", F.when(F.col("event_id") % 40 == 0, F.lit("Snap_Ads")).otherwise(F.col("channel")))
    return quality.check_accepted(t, "channel", list(CHANNEL_ALIASES)).select("event_id", "channel")


@register("dq_post_conversion_planted", with_ctes() + """
SELECT event_id, conversion_id FROM pairs WHERE event_id % 25 = 0 AND touchpoint_ts + INTERVAL 30 DAY > conversion_ts""")
def q_planted_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir).pairs(90)
    late = F.col("touchpoint_ts") + F.make_dt_interval(days=F.lit(30))
    p = p.withColumn("touchpoint_ts", F.when(F.col("event_id") % 25 == 0, late).otherwise(F.col("touchpoint_ts")))
    return quality.check_causal(p, ("event_id", "conversion_id")).select("event_id", "conversion_id")


@register("dq_pair_key_planted", with_ctes() + "SELECT event_id, conversion_id, 2 AS occurrences FROM pairs WHERE conversion_id % 20 = 0")
def q_planted_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir).pairs(90)
    again = p.withColumn("copy", F.explode(F.when(F.col("conversion_id") % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return quality.check_unique(again, ["event_id", "conversion_id"]).withColumn("occurrences", F.col("occurrences").cast("int"))


@register("holdout_contamination_planted", with_ctes() + f"""
SELECT event_id FROM stg_touchpoints WHERE event_id % 30 = 0 AND event_timestamp >= {WIN_START} AND event_timestamp < {WIN_END_EXCL}
  AND dma_code IN (SELECT dma_code FROM holdout)""")
def q_planted_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    t = p.touches.withColumn("channel", F.when(F.col("event_id") % 30 == 0, F.lit("Meta_Paid_Social")).otherwise(F.col("channel")))
    return geo.holdout_contamination(t, p.inputs.holdout_markets, EXPERIMENT_START, EXPERIMENT_END).select("event_id")


@register("near_duplicate_planted", with_ctes() + """
, planted AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, channel, event_timestamp FROM deduped
  UNION ALL SELECT event_id + 5000000000, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END, channel,
                   event_timestamp + INTERVAL 400 MILLISECOND FROM deduped WHERE event_id % 20 = 0)
SELECT event_id FROM (SELECT *, LAG(event_timestamp) OVER (PARTITION BY user_id, channel ORDER BY event_timestamp, event_id) AS prev FROM planted)
WHERE prev IS NULL OR date_diff('microsecond', prev, event_timestamp) > 1000000""")
def q_planted_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Pipeline(spark, sf_dir).deduped.select("event_id", "user_id", "channel", "event_timestamp")
    shift = F.make_dt_interval(secs=F.lit(0.4).cast("decimal(18,6)"))
    twin = F.struct((F.col("event_id") + F.lit(5_000_000_000)).alias("event_id"), (F.col("event_timestamp") + shift).alias("event_timestamp"))
    own = F.struct(F.col("event_id").alias("event_id"), F.col("event_timestamp").alias("event_timestamp"))
    d = d.withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    d = d.select("user_id", "channel", F.explode(F.when(F.col("event_id") % 20 == 0, F.array(own, twin)).otherwise(F.array(own))).alias("e"))
    return near_duplicates_removed(d.select("e.event_id", "user_id", "channel", "e.event_timestamp")).select("event_id")


# ------------------------------------------------------------ extracts -----

_FROM, _TO = date(1995, 1, 1), date(1996, 1, 1)


@register("extract_completed_orders", f"""
SELECT o_orderkey AS conversion_id, o_custkey AS user_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS converted_at,
       CAST(o_totalprice AS DOUBLE) AS order_value_usd
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '{_FROM}' AND o_orderdate < DATE '{_TO}'""")
def q_extract_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("PENDING").alias("status"),
        F.col("o_orderdate").cast("date").alias("created_at"), F.col("o_totalprice").alias("total_usd"), F.lit(None).cast("string").alias("dma_code"))
    return extract_completed_orders(orders, _FROM, _TO).select(
        "conversion_id", "user_id", F.date_format("converted_at", "yyyy-MM-dd").alias("converted_at"),
        F.col("order_value_usd").cast("double").alias("order_value_usd"))


@register("extract_daily_spend", with_ctes() + f"""
SELECT CAST("date" AS VARCHAR) AS "date", channel, dma_code, CAST(daily_spend_usd AS DOUBLE) AS daily_spend_usd
FROM raw_ad_spend WHERE "date" BETWEEN {WIN_START_DATE} AND {WIN_END_DATE}""")
def q_extract_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_daily_spend(Pipeline(spark, sf_dir).inputs.raw_ad_spend, EXPERIMENT_START, EXPERIMENT_END)
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "channel", "dma_code", F.col("daily_spend_usd").cast("double").alias("daily_spend_usd"))


@register("extract_sessions", f"""
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS event_micros, lower(event_type) AS utm_source, 'web' AS utm_medium
FROM events WHERE event_type <> 'purchase' AND CAST(ts AS DATE) BETWEEN {WIN_START_DATE} AND {WIN_END_DATE}""")
def q_extract_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from a nested, date-sharded export made of the events."""
    from creditline.functions.columns import wall_micros

    e = read_table(spark, sf_dir, "events")
    nested = e.select(
        F.date_format(F.col("ts").cast("date"), "yyyyMMdd").alias("event_date"),
        F.when(F.col("event_type") == "purchase", "purchase").otherwise("session_start").alias("event_name"),
        F.col("user_id").alias("user_pseudo_id"), wall_micros("ts").alias("event_timestamp"),
        F.struct(F.lower("event_type").alias("source"), F.lit("web").alias("medium")).alias("traffic_source"),
        F.struct(F.lit(None).cast("string").alias("metro")).alias("geo"))
    s = extract_sessions(nested, EXPERIMENT_START.strftime("%Y%m%d"), EXPERIMENT_END.strftime("%Y%m%d"))
    return s.select("user_id", F.unix_micros("event_timestamp").alias("event_micros"), "utm_source", "utm_medium")
