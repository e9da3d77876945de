"""Registered queries: spend reports, budget, data quality, journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.operators import budget, quality, spend
from creditline.operators.attribution import assisted_conversions, attribute, model_mart
from creditline.operators.geo import geo_incrementality
from creditline.operators.journeys import eligible_pairs, journey_steps, near_duplicates_removed, unattributed_conversions
from creditline.operators.staging import fill_missing_utm, stage_touchpoints_display
from creditline.plans.oracle_base import PAID_IN, pairs_cte, with_ctes
from creditline.plans.pipeline import Pipeline
from creditline.plans.q_core import _mart_sql, _r2, credits_sql
from creditline.plans.q_geo import GROUPS_CTES, groups, spend_total
from creditline.plans.registry import register

PAID_SPEND = f"(SELECT * FROM stg_spend WHERE channel IN {PAID_IN})"


# ------------------------------------------------------------- spend side ---

@register("overview_metrics", with_ctes() + f"""
SELECT ROUND(total_spend, 2) AS total_spend, total_actual_convs, total_platform_convs, ROUND(total_revenue, 2) AS total_revenue,
       ROUND(pr, 2) AS blended_platform_roas, ROUND(ar, 2) AS blended_actual_roas,
       ROUND((pr - ar) * 100.0 / NULLIF(ar, 0), 1) AS overstatement_pct
FROM (
  SELECT *, total_platform_convs * 160.0 / NULLIF(total_spend, 0) AS pr, total_revenue / NULLIF(total_spend, 0) AS ar
  FROM (SELECT CAST(SUM(spend_usd) AS DOUBLE) AS total_spend,
               CAST(SUM(platform_reported_conversions) AS BIGINT) AS total_platform_convs FROM {PAID_SPEND}) s,
       (SELECT COUNT(*) AS total_actual_convs, CAST(SUM(order_value_usd) AS DOUBLE) AS total_revenue FROM stg_conversions) c
)""")
def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.overview(p.conversions, p.spend)


@register("platform_by_channel", with_ctes() + f"""
SELECT channel, {_r2('sp')} AS spend, pc AS platform_conversions, pc * 160.0 AS platform_revenue,
       ROUND(pc * 160.0 / NULLIF(CAST(sp AS DOUBLE), 0), 2) AS platform_roas
FROM (SELECT channel, SUM(spend_usd) AS sp, CAST(SUM(platform_reported_conversions) AS BIGINT) AS pc
      FROM {PAID_SPEND} GROUP BY channel)""")
def q_platform_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.platform_by_channel(Pipeline(spark, sf_dir).spend).withColumn(
        "platform_revenue", F.col("platform_revenue").cast("double")
    )


@register("attribution_gap", with_ctes() + f"""
SELECT claims AS platform_claimed_conversions, wc AS warehouse_conversions, uc AS unique_converters,
       claims - uc AS attribution_gap, ROUND((claims - uc) * 100.0 / NULLIF(uc, 0), 1) AS over_reporting_pct
FROM (SELECT CAST(SUM(platform_reported_conversions) AS BIGINT) AS claims FROM {PAID_SPEND}) a,
     (SELECT COUNT(*) AS wc, COUNT(DISTINCT user_id) AS uc FROM stg_conversions) b""")
def q_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.attribution_gap(p.conversions, p.spend)


@register("platform_vs_attributed", with_ctes(credits_sql()) + f"""
SELECT s.channel, s.pc * 160.0 AS platform_revenue,
       {_r2('COALESCE(CAST(c.time_decay_revenue AS DOUBLE), 0.0)')} AS attributed_revenue,
       ROUND(s.pc * 160.0 / NULLIF(CAST(c.time_decay_revenue AS DOUBLE), 0), 2) AS claimed_to_attributed
FROM (SELECT channel, CAST(SUM(platform_reported_conversions) AS BIGINT) AS pc FROM {PAID_SPEND} GROUP BY channel) s
LEFT JOIN credits c ON s.channel = c.channel""")
def q_platform_vs_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.platform_vs_attributed(p.spend, p.credits())


@register("daily_spend", with_ctes() + f"""
SELECT CAST(ad_date AS VARCHAR) AS ad_date, channel, {_r2('SUM(spend_usd)')} AS daily_spend_usd
FROM {PAID_SPEND} GROUP BY ad_date, channel""")
def q_daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spend.daily_spend(Pipeline(spark, sf_dir).spend)
    return d.select(F.date_format("ad_date", "yyyy-MM-dd").alias("ad_date"), "channel", "daily_spend_usd")


@register("blended_roas_rollup", with_ctes(credits_sql()) + f"""
SELECT COALESCE(channel, 'ALL') AS channel, {_r2('SUM(sp)')} AS spend, {_r2('SUM(rev)')} AS attributed_revenue,
       ROUND(SUM(rev) / NULLIF(SUM(sp), 0), 2) AS roas
FROM (
  SELECT s.channel, s.sp, COALESCE(CAST(c.time_decay_revenue AS DOUBLE), 0.0) AS rev
  FROM (SELECT channel, CAST(SUM(spend_usd) AS DOUBLE) AS sp FROM {PAID_SPEND} GROUP BY channel) s
  LEFT JOIN credits c ON s.channel = c.channel
) GROUP BY ROLLUP (channel)""")
def q_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.blended_roas_rollup(p.spend, p.credits())


@register("weekly_blended_cac", with_ctes() + f"""
SELECT CAST(COALESCE(s.week, c.week) AS VARCHAR) AS week, {_r2('COALESCE(s.sp, 0.0)')} AS spend,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS conversions, ROUND(s.sp / NULLIF(CAST(c.n AS DOUBLE), 0), 2) AS blended_cac
FROM (SELECT CAST(date_trunc('week', ad_date) AS DATE) AS week, CAST(SUM(spend_usd) AS DOUBLE) AS sp
      FROM {PAID_SPEND} GROUP BY 1) s
FULL OUTER JOIN (SELECT CAST(date_trunc('week', converted_at) AS DATE) AS week, COUNT(*) AS n
                 FROM stg_conversions GROUP BY 1) c ON s.week = c.week""")
def q_weekly_cac(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return spend.weekly_blended_cac(p.spend, p.conversions)


@register("cohort_ltv", with_ctes() + """
, fo AS (SELECT user_id, min(converted_at) AS f FROM stg_conversions GROUP BY user_id),
co AS (
  SELECT CAST(date_trunc('week', fo.f) AS DATE) AS cohort_week,
         CAST(floor(datediff('day', fo.f, c.converted_at) / 7) AS INTEGER) AS age_weeks,
         c.user_id, c.order_value_usd
  FROM stg_conversions c JOIN fo ON c.user_id = fo.user_id
),
cg AS (SELECT cohort_week, age_weeks, COUNT(*) AS orders, CAST(SUM(order_value_usd) AS DOUBLE) AS revenue
       FROM co GROUP BY 1, 2),
cs AS (SELECT cohort_week, COUNT(DISTINCT user_id) AS cohort_users FROM co WHERE age_weeks = 0 GROUP BY 1)
SELECT CAST(cg.cohort_week AS VARCHAR) AS cohort_week, age_weeks, CAST(cohort_users AS BIGINT) AS cohort_users,
       CAST(orders AS BIGINT) AS orders, ROUND(revenue, 2) AS revenue,
       ROUND(SUM(revenue) OVER (PARTITION BY cg.cohort_week ORDER BY age_weeks
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / NULLIF(cohort_users, 0), 2) AS ltv_per_user
FROM cg JOIN cs ON cg.cohort_week = cs.cohort_week""")
def q_cohort_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.cohort_ltv(Pipeline(spark, sf_dir).conversions)


# ---------------------------------------------------------------- budget ---

BUDGET_CTES = GROUPS_CTES + """,
inc_roas AS (
  SELECT CASE WHEN sp > 0 THEN ROUND(i * aov / sp, 2) ELSE 0.0 END AS rm FROM (
    SELECT cv_t - n_t * (cv_c / NULLIF(n_c, 0)) AS i, rev_t / NULLIF(cv_t, 0) AS aov,
           COALESCE(t.treatment_spend_usd, 0.0) AS sp FROM arm_sums a, tspend t)
),
alloc AS (
  SELECT CAST(SUM(CASE WHEN channel = 'Meta_Paid_Social' THEN spend_usd END) AS DOUBLE) AS m,
         CAST(SUM(CASE WHEN channel = 'Google_Paid_Search' THEN spend_usd END) AS DOUBLE) AS g,
         CAST(SUM(CASE WHEN channel = 'TikTok_Ads' THEN spend_usd END) AS DOUBLE) AS t
  FROM stg_spend
),
ar AS (SELECT alloc.*, rm, CAST(2.65 AS DOUBLE) AS rg, CAST(2.1 AS DOUBLE) AS rt FROM alloc, inc_roas)"""


def _scored_sql(src: str) -> str:
    return f"""
SELECT {{keys}}channel, ROUND(cur, 2) AS current_spend, ROUND(sim, 2) AS sim_spend, true_roas,
       ROUND(cur * true_roas, 2) AS current_revenue, ROUND(sim * true_roas, 2) AS sim_revenue,
       ROUND(sim * true_roas - cur * true_roas, 2) AS revenue_delta
FROM (
  SELECT {{keys}}'Meta_Paid_Social' AS channel, m AS cur, m - shift_usd AS sim, rm AS true_roas FROM {src}
  UNION ALL SELECT {{keys}}'Google_Paid_Search', g, g + shift_usd * gs, rg FROM {src}
  UNION ALL SELECT {{keys}}'TikTok_Ads', t, t + shift_usd * tsh, rt FROM {src}
)"""


def _budget_inputs(p: Pipeline):
    inc = geo_incrementality(groups(p), spend_total(p)).select("incremental_roas")
    return budget.current_allocation(p.spend), budget.true_roas_row(inc)


@register("projected_revenue", with_ctes(BUDGET_CTES) + """
SELECT channel, ROUND(cur, 2) AS spend, true_roas, ROUND(cur * true_roas, 2) AS projected_revenue FROM (
  SELECT 'Meta_Paid_Social' AS channel, m AS cur, rm AS true_roas FROM ar
  UNION ALL SELECT 'Google_Paid_Search', g, rg FROM ar
  UNION ALL SELECT 'TikTok_Ads', t, rt FROM ar)""")
def q_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    alloc, roas = _budget_inputs(Pipeline(spark, sf_dir))
    return budget.projected_revenue(alloc, roas)


@register("reallocation", with_ctes(BUDGET_CTES + """,
fixed AS (SELECT ar.*, CAST(100000.0 AS DOUBLE) AS shift_usd, CAST(0.5 AS DOUBLE) AS gs, CAST(0.5 AS DOUBLE) AS tsh FROM ar)""")
    + _scored_sql("(SELECT m, g, t, rm, rg, rt, gs, tsh, m >= shift_usd AS feasible, CASE WHEN m >= shift_usd THEN shift_usd END AS shift_usd FROM fixed)").replace("{keys}", "feasible, "))
def q_reallocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    alloc, roas = _budget_inputs(Pipeline(spark, sf_dir))
    return budget.reallocation(alloc, roas)


_GRID_CTES = BUDGET_CTES + """,
steps AS (SELECT ar.*, UNNEST(range(0, GREATEST(CAST(floor(m * 0.6 / 10000.0) AS INTEGER), 0) + 1)) AS step FROM ar),
splits AS (SELECT * FROM (VALUES ('50% Google / 50% TikTok', CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE)),
                                 ('100% Google Search', CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)),
                                 ('100% TikTok Ads', CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE))) v(split, gs, tsh)),
grid AS (SELECT steps.*, splits.*, step * 10000.0 AS shift_usd FROM steps, splits)"""


@register("scenario_grid", with_ctes(_GRID_CTES) + _scored_sql("grid").replace("{keys}", "shift_usd, split, "))
def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    alloc, roas = _budget_inputs(Pipeline(spark, sf_dir))
    return budget.scenario_grid(alloc, roas)


_SUMMARY_SQL = """
SELECT shift_usd, split, ROUND(c, 2) AS current_revenue, ROUND(s, 2) AS sim_revenue,
       ROUND((s - c) * 100.0 / NULLIF(c, 0), 2) AS delta_pct
FROM (SELECT shift_usd, split, SUM(current_revenue) AS c, SUM(sim_revenue) AS s FROM scored GROUP BY 1, 2)"""


@register("scenario_summary", with_ctes(_GRID_CTES, "scored AS (" + _scored_sql("grid").replace("{keys}", "shift_usd, split, ") + ")")
          + _SUMMARY_SQL)
def q_grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    alloc, roas = _budget_inputs(Pipeline(spark, sf_dir))
    return budget.scenario_summary(budget.scenario_grid(alloc, roas))


@register("best_scenario", with_ctes(_GRID_CTES, "scored AS (" + _scored_sql("grid").replace("{keys}", "shift_usd, split, ") + ")",
                                     "summ AS (" + _SUMMARY_SQL + ")")
          + "SELECT shift_usd, split, sim_revenue, delta_pct FROM summ ORDER BY sim_revenue DESC, shift_usd ASC, split DESC LIMIT 1")
def q_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    alloc, roas = _budget_inputs(Pipeline(spark, sf_dir))
    return budget.best_scenario(budget.scenario_summary(budget.scenario_grid(alloc, roas)))


@register("budget_scorecard", with_ctes(BUDGET_CTES) + """
SELECT channel, pr AS platform_roas, ROUND(tr, 2) AS true_roas, ROUND((1.0 - tr / NULLIF(pr, 0)) * 100.0, 1) AS cannibalization_pct,
       CASE WHEN tr < 1.0 OR tr < pr * 0.5 THEN 'cut' ELSE 'increase' END AS action
FROM (
  SELECT s.channel, ROUND(s.pc * 160.0 / NULLIF(s.sp, 0), 2) AS pr,
         CASE s.channel WHEN 'Meta_Paid_Social' THEN ar.rm WHEN 'Google_Paid_Search' THEN ar.rg ELSE ar.rt END AS tr
  FROM (SELECT channel, CAST(SUM(spend_usd) AS DOUBLE) AS sp, CAST(SUM(platform_reported_conversions) AS BIGINT) AS pc
        FROM stg_spend WHERE channel IN ('Meta_Paid_Social', 'Google_Paid_Search', 'TikTok_Ads') GROUP BY channel) s, ar
)""")
def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    _, roas = _budget_inputs(p)
    return budget.scorecard(p.spend, roas)


# ---------------------------------------------------------- data quality ---

@register("dq_not_null", with_ctes() + """
SELECT * FROM stg_touchpoints WHERE event_id IS NULL OR user_id IS NULL OR event_timestamp IS NULL OR channel IS NULL""")
def q_dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_not_null(Pipeline(spark, sf_dir).touches, ["event_id", "user_id", "event_timestamp", "channel"])


_RAW_TP_COLS = ("event_id", "user_id", "timestamp", "channel", "utm_source", "utm_medium", "campaign_name", "dma_code")


@register("null_counts", with_ctes() + "SELECT COUNT(*) AS \"rows\", " + ", ".join(
    f'COUNT(*) FILTER (WHERE "{c}" IS NULL) AS null_{c}' for c in _RAW_TP_COLS) + " FROM raw_touchpoints")
def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_counts(Pipeline(spark, sf_dir).inputs.raw_touchpoints, _RAW_TP_COLS)


@register("dq_unique_event_id", with_ctes() + "SELECT event_id, COUNT(*) AS occurrences FROM deduped GROUP BY event_id HAVING COUNT(*) > 1")
def q_dq_unique_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_unique(Pipeline(spark, sf_dir).deduped, ["event_id"])


@register("dq_unique_conversion_id", with_ctes() + """
SELECT conversion_id, COUNT(*) AS occurrences FROM stg_conversions GROUP BY conversion_id HAVING COUNT(*) > 1""")
def q_dq_unique_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_unique(Pipeline(spark, sf_dir).conversions, ["conversion_id"])


@register("duplicate_touch_keys", with_ctes() + """
SELECT user_id, event_timestamp, channel, COUNT(*) AS occurrences FROM stg_touchpoints
GROUP BY user_id, event_timestamp, channel HAVING COUNT(*) > 1""")
def q_dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_unique(Pipeline(spark, sf_dir).touches, ["user_id", "event_timestamp", "channel"])


@register("dq_accepted_channels", with_ctes() + """
SELECT * FROM stg_touchpoints WHERE channel IS NULL OR channel NOT IN
  ('Meta_Paid_Social', 'Google_Paid_Search', 'TikTok_Ads', 'Google_Organic', 'Email_CRM')""")
def q_dq_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditline.functions.columns import CHANNEL_ALIASES

    return quality.check_accepted(Pipeline(spark, sf_dir).touches, "channel", list(CHANNEL_ALIASES))


@register("dq_accepted_spend_channels", with_ctes() + f"""
SELECT CAST(ad_date AS VARCHAR) AS ad_date, channel, dma_code FROM stg_spend
WHERE channel IS NULL OR channel NOT IN {PAID_IN}""")
def q_dq_accepted_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditline.functions.columns import PAID_CHANNELS

    s = quality.check_accepted(Pipeline(spark, sf_dir).spend, "channel", PAID_CHANNELS)
    return s.select(F.date_format("ad_date", "yyyy-MM-dd").alias("ad_date"), "channel", "dma_code")


@register("dq_post_conversion", with_ctes() + """
SELECT user_id, event_id, touchpoint_ts, conversion_ts,
       date_diff('microsecond', conversion_ts, touchpoint_ts) / 86400000000.0 * 86400.0 AS seconds_after_conversion
FROM pairs WHERE touchpoint_ts > conversion_ts""")
def q_dq_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_causal(Pipeline(spark, sf_dir).pairs(90))


@register("dq_pair_key_unique", with_ctes() + """
SELECT event_id, conversion_id, COUNT(*) AS occurrences FROM pairs GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def q_dq_pair_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_unique(Pipeline(spark, sf_dir).pairs(90), ["event_id", "conversion_id"])


@register("dedup_removed_pct", with_ctes() + """
SELECT total_before, total_after, ROUND((1.0 - CAST(total_after AS DOUBLE) / total_before) * 100.0, 2) AS pct_removed
FROM (SELECT COUNT(*) AS total_before FROM stg_touchpoints) a, (SELECT COUNT(*) AS total_after FROM deduped) b""")
def q_dedup_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return quality.dedup_removed_pct(p.touches, p.deduped)


@register("touches_per_user", with_ctes() + """
SELECT ROUND(AVG(n), 2) AS avg_touchpoints_per_user, MAX(n) AS max_touchpoints
FROM (SELECT user_id, COUNT(*) AS n FROM pairs GROUP BY user_id)""")
def q_touches_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.touches_per_user(Pipeline(spark, sf_dir).pairs(90))


@register("channel_counts_raw", with_ctes() + 'SELECT channel AS raw_channel, COUNT(*) AS "rows" FROM raw_touchpoints GROUP BY channel')
def q_channel_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts(Pipeline(spark, sf_dir).inputs.raw_touchpoints, "channel", "raw_channel")


@register("channel_counts_clean", with_ctes() + 'SELECT channel, COUNT(*) AS "rows" FROM deduped GROUP BY channel')
def q_channel_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts(Pipeline(spark, sf_dir).deduped, "channel", "channel")


@register("distinct_channels", with_ctes() + "SELECT DISTINCT channel FROM pairs")
def q_distinct_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(spark, sf_dir).pairs(90).select("channel").distinct()


@register("orphan_conversions", with_ctes() + """
SELECT conversion_id, user_id, order_id, converted_at, CAST(order_value_usd AS DOUBLE) AS order_value_usd, dma_code
FROM stg_conversions c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.conversion_id = c.conversion_id)""")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    o = unattributed_conversions(p.conversions, p.pairs(90))
    return o.select("conversion_id", "user_id", "order_id", "converted_at",
                    F.col("order_value_usd").cast("double").alias("order_value_usd"), "dma_code")


@register("utm_fill", with_ctes() + """
SELECT COALESCE(utm_source, '(not set)') AS utm_source, COALESCE(utm_medium, '(not set)') AS utm_medium,
       COALESCE(utm_campaign, '(not set)') AS utm_campaign, COUNT(*) AS touches
FROM stg_touchpoints GROUP BY 1, 2, 3""")
def q_utm_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fill_missing_utm(Pipeline(spark, sf_dir).touches)
    return t.groupBy("utm_source", "utm_medium", "utm_campaign").agg(F.count(F.lit(1)).alias("touches"))


_DISPLAY_SQL = """CASE regexp_replace(lower(channel), '^\\s+|\\s+$', '', 'g')
  WHEN 'meta_paid_social' THEN 'Meta Paid Social' WHEN 'google_paid_search' THEN 'Google Paid Search'
  WHEN 'tiktok_ads' THEN 'TikTok Ads' WHEN 'email_crm' THEN 'Email / CRM' WHEN 'google_organic' THEN 'Google Organic' END"""


@register("stage_touchpoints_display", with_ctes() + f"""
SELECT channel, COUNT(*) AS touches FROM (SELECT {_DISPLAY_SQL} AS channel FROM raw_touchpoints)
WHERE channel IS NOT NULL GROUP BY channel""")
def q_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stage_touchpoints_display(Pipeline(spark, sf_dir).inputs.raw_touchpoints)
    return d.groupBy("channel").agg(F.count(F.lit(1)).alias("touches"))


# -------------------------------------------------------------- journeys ---

@register("near_duplicate_1s", with_ctes() + """
SELECT event_id, user_id, event_timestamp, utm_source, utm_medium, utm_campaign, channel, dma_code FROM (
  SELECT *, LAG(event_timestamp) OVER (PARTITION BY user_id, channel ORDER BY event_timestamp, event_id) AS prev_ts
  FROM deduped)
WHERE prev_ts IS NULL OR date_diff('microsecond', prev_ts, event_timestamp) > 1000000""")
def q_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_removed(Pipeline(spark, sf_dir).deduped, within_seconds=1.0)


@register("journey_lag_lead", with_ctes() + """
SELECT conversion_id, user_id, event_id, channel, touchpoint_ts,
  ROW_NUMBER() OVER w AS position, COUNT(*) OVER (PARTITION BY conversion_id) AS journey_touches,
  LAG(channel) OVER w AS prev_channel, LEAD(channel) OVER w AS next_channel,
  ROUND(date_diff('microsecond', LAG(touchpoint_ts) OVER w, touchpoint_ts) / 86400000000.0 * 24.0, 6) AS hours_since_prev
FROM pairs WINDOW w AS (PARTITION BY conversion_id ORDER BY touchpoint_ts, event_id)""")
def q_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return journey_steps(p.deduped, p.conversions, 90)


@register("assisted_conversions", with_ctes() + """
, ak AS (
  SELECT conversion_id, channel, min((touchpoint_ts, event_id)) AS fk, max((touchpoint_ts, event_id)) AS lk
  FROM pairs GROUP BY conversion_id, channel
),
ak2 AS (SELECT *, max(lk) OVER (PARTITION BY conversion_id) AS big_lk FROM ak)
SELECT channel, COUNT(*) AS touched_conversions, COUNT(*) FILTER (WHERE lk = big_lk) AS closed_conversions,
       COUNT(*) FILTER (WHERE fk < big_lk) AS assisted_conversions,
       COUNT(*) FILTER (WHERE fk < big_lk AND lk <> big_lk) AS assist_only_conversions
FROM ak2 GROUP BY channel""")
def q_assisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assisted_conversions(Pipeline(spark, sf_dir).pairs(90))


@register("campaign_attribution", with_ctes(
    pairs_cte("pairs_c", 90, ("utm_campaign",)),
    credits_sql(pairs="pairs_c", name="ccredits", key="utm_campaign"),
) + f"""
SELECT utm_campaign, CAST(attributed_conversions AS BIGINT) AS attributed_conversions,
       CAST(attributed_users AS BIGINT) AS attributed_users,
       {_r2('time_decay_revenue')} AS attributed_revenue_usd
FROM ccredits WHERE attributed_conversions > 0""")
def q_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    pairs = eligible_pairs(p.deduped, p.conversions, 90, p.bucket_days, ("channel", "dma_code", "utm_campaign"))
    credits = attribute(pairs, credit_key="utm_campaign", max_age_days=90)
    return model_mart(credits, "time_decay", credit_key="utm_campaign")
