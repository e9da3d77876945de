"""Registered queries: staging, dedup, pairs and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.functions.columns import PAID_CHANNELS, money
from creditline.operators.attribution import (
    FOUR_MODELS,
    MODELS,
    attribution_comparison,
    credit_long,
    credit_wide,
    model_mart,
    model_share,
    model_share_all,
    roas_consistency,
    roas_table,
)
from creditline.plans.oracle_base import PAID_IN, with_ctes
from creditline.plans.pipeline import Pipeline
from creditline.plans.registry import register


def iso_date(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


# ---------------------------------------------------------------- staging ---

@register("stage_spend", with_ctes() + """
SELECT CAST(ad_date AS VARCHAR) AS ad_date, channel, dma_code, CAST(spend_usd AS DOUBLE) AS spend_usd,
       platform_reported_conversions
FROM stg_spend""")
def q_stage_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Pipeline(spark, sf_dir).spend
    return s.select(iso_date("ad_date"), "channel", "dma_code", F.col("spend_usd").cast("double").alias("spend_usd"),
                    "platform_reported_conversions")


@register("stage_touchpoints", with_ctes() + "SELECT * FROM stg_touchpoints")
def q_stage_touchpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(spark, sf_dir).touches


@register("stage_conversions", with_ctes() + """
SELECT conversion_id, user_id, order_id, converted_at, CAST(order_value_usd AS DOUBLE) AS order_value_usd, dma_code
FROM stg_conversions""")
def q_stage_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Pipeline(spark, sf_dir).conversions
    return c.withColumn("order_value_usd", F.col("order_value_usd").cast("double"))


@register("dedup_touchpoints", with_ctes() + "SELECT * FROM deduped")
def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(spark, sf_dir).deduped


_PAIRS_OUT = """
SELECT user_id, event_id, channel, dma_code, touchpoint_ts, conversion_id, conversion_ts,
       CAST(order_value_usd AS DOUBLE) AS order_value_usd
FROM {name}"""


def _pairs_out(df: DataFrame) -> DataFrame:
    return df.withColumn("order_value_usd", F.col("order_value_usd").cast("double"))


@register("eligible_pairs", with_ctes() + _PAIRS_OUT.format(name="pairs"))
def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs_out(Pipeline(spark, sf_dir).pairs(90))


@register("eligible_pairs_7d", with_ctes(lookback_days=7) + _PAIRS_OUT.format(name="pairs"))
def q_pairs_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs_out(Pipeline(spark, sf_dir).pairs(7))


# ------------------------------------------------------ attribution oracle ---

def credits_sql(
    scope: str = "conversion",
    half_life: float = 7.0,
    anchor: str = "conversion",
    position: tuple[float, float] = (0.4, 0.4),
    pairs: str = "pairs",
    name: str = "credits",
    key: str = "channel",
) -> str:
    """Window-function formulation of every model (the SQL-mart style)."""
    unit = "conversion_id" if scope == "conversion" else "user_id"
    order = "touchpoint_ts, event_id, conversion_id"
    order_desc = "touchpoint_ts DESC, event_id DESC, conversion_id DESC"
    anchor_ts = "conversion_ts" if anchor == "conversion" else f"MAX(touchpoint_ts) OVER (PARTITION BY {unit})"
    pf, pl = position
    pm = 1.0 - pf - pl
    return f"""
{name}_seq AS (
  SELECT *,
    ROW_NUMBER() OVER (PARTITION BY {unit} ORDER BY {order}) AS rn_first,
    ROW_NUMBER() OVER (PARTITION BY {unit} ORDER BY {order_desc}) AS rn_last,
    COUNT(*) OVER (PARTITION BY {unit}) AS n_touches,
    pow(2.0, -(date_diff('microsecond', touchpoint_ts, {anchor_ts}) / 86400000000.0) / {float(half_life)!r}) AS w
  FROM {pairs}
),
{name}_seq2 AS (SELECT *, SUM(w) OVER (PARTITION BY {unit}) AS sw FROM {name}_seq),
{name} AS (
  SELECT {key},
    COUNT(*) AS touches,
    COUNT(DISTINCT conversion_id) AS attributed_conversions,
    COUNT(DISTINCT user_id) AS attributed_users,
    COUNT(*) FILTER (WHERE rn_first = 1) AS first_touch_conversions,
    COUNT(DISTINCT user_id) FILTER (WHERE rn_first = 1) AS first_touch_users,
    COUNT(*) FILTER (WHERE rn_last = 1) AS last_touch_conversions,
    COUNT(DISTINCT user_id) FILTER (WHERE rn_last = 1) AS last_touch_users,
    SUM(CASE WHEN rn_first = 1 THEN order_value_usd ELSE 0 END) AS first_touch_revenue,
    SUM(CASE WHEN rn_last = 1 THEN order_value_usd ELSE 0 END) AS last_touch_revenue,
    SUM(CAST(order_value_usd AS DOUBLE) / n_touches) AS linear_revenue,
    SUM(CAST(order_value_usd AS DOUBLE) * w / sw) AS time_decay_revenue,
    SUM(CAST(order_value_usd AS DOUBLE) * CASE WHEN n_touches = 1 THEN 1.0 WHEN n_touches = 2 THEN 0.5
        WHEN rn_first = 1 THEN {pf!r} WHEN rn_last = 1 THEN {pl!r} ELSE {pm!r} / (n_touches - 2) END)
      AS position_based_revenue
  FROM {name}_seq2 GROUP BY {key}
)"""


def _r2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DOUBLE), 2) AS DOUBLE)"


def comparison_sql(credits: str = "credits") -> str:
    rev = {m: f"COALESCE(CAST(cr.{m}_revenue AS DOUBLE), 0.0)" for m in FOUR_MODELS}
    spend = "CAST(s.total_spend_usd AS DOUBLE)"
    cols = ",\n  ".join(
        [f"{_r2(rev[m])} AS {m}_revenue" for m in FOUR_MODELS]
        + [f"ROUND({rev[m]} / NULLIF({spend}, 0), 2) AS {m}_roas" for m in FOUR_MODELS]
    )
    return f"""
spend_agg AS (
  SELECT channel, SUM(spend_usd) AS total_spend_usd,
         CAST(SUM(platform_reported_conversions) AS BIGINT) AS total_platform_conversions
  FROM stg_spend GROUP BY channel
),
comparison AS (
SELECT s.channel, {_r2('s.total_spend_usd')} AS total_spend_usd, s.total_platform_conversions,
  {cols},
  ROUND(s.total_platform_conversions * 160.0 / NULLIF({spend}, 0), 2) AS platform_reported_roas
FROM spend_agg s LEFT JOIN {credits} cr ON s.channel = cr.channel
)"""


# ---------------------------------------------------- attribution queries ---

@register("attribution_comparison", with_ctes(credits_sql(), comparison_sql()) + "SELECT * FROM comparison")
def q_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return attribution_comparison(p.credits(), p.spend)


def _mart_sql(model: str, credits: str = "credits") -> str:
    if model in ("first_touch", "last_touch"):
        conv, users = f"{model}_conversions", f"{model}_users"
    else:
        conv, users = "attributed_conversions", "attributed_users"
    return f"""
SELECT channel, CAST({conv} AS BIGINT) AS attributed_conversions, CAST({users} AS BIGINT) AS attributed_users,
       {_r2(f'{model}_revenue')} AS attributed_revenue_usd
FROM {credits} WHERE {conv} > 0"""


def _mart(model: str, lookback_days: int | None = 90, swept: bool = False, **opts):
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Pipeline(spark, sf_dir)
        return model_mart((p.swept if swept else p.credits)(lookback_days, **opts), model)

    return fn


for _model in ("first_touch", "last_touch", "linear", "time_decay", "position_based"):
    register(_model, with_ctes(credits_sql()) + _mart_sql(_model))(_mart(_model))

for _model in FOUR_MODELS:
    register(f"{_model}_user_scope", with_ctes(credits_sql(scope="user")) + _mart_sql(_model))(
        _mart(_model, scope="user")
    )

register(
    "time_decay_last_touch_anchor",
    with_ctes(credits_sql(scope="user", anchor="last_touch")) + _mart_sql("time_decay"),
)(_mart("time_decay", scope="user", anchor="last_touch"))

register("linear_7d", with_ctes(credits_sql(), lookback_days=7) + _mart_sql("linear"))(_mart("linear", lookback_days=7))
register("time_decay_7d", with_ctes(credits_sql(), lookback_days=7) + _mart_sql("time_decay"))(
    _mart("time_decay", lookback_days=7)
)
register(
    "time_decay_no_lookback_user",
    with_ctes(credits_sql(scope="user"), lookback_days=None) + _mart_sql("time_decay"),
)(_mart("time_decay", scope="user", lookback_days=None, swept=True))
for _model in MODELS:
    register(f"{_model}_swept", with_ctes(credits_sql()) + _mart_sql(_model))(_mart(_model, swept=True))
register("linear_swept_7d", with_ctes(credits_sql(), lookback_days=7) + _mart_sql("linear"))(_mart("linear", lookback_days=7, swept=True))
register("time_decay_swept_no_lookback", with_ctes(credits_sql(), lookback_days=None) + _mart_sql("time_decay"))(
    _mart("time_decay", lookback_days=None, swept=True))
register("time_decay_swept_last_touch_anchor", with_ctes(credits_sql(scope="user", anchor="last_touch")) + _mart_sql("time_decay"))(
    _mart("time_decay", scope="user", anchor="last_touch", swept=True))
register("time_decay_half_life_3", with_ctes(credits_sql(half_life=3.0)) + _mart_sql("time_decay"))(
    _mart("time_decay", half_life_days=3.0)
)


@register("credit_wide", with_ctes(credits_sql()) + f"""
SELECT channel, {', '.join(f"{_r2(m + '_revenue')} AS {m}_revenue" for m in FOUR_MODELS)},
       CAST(attributed_conversions AS BIGINT) AS total_conversions
FROM credits""")
def q_credit_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit_wide(Pipeline(spark, sf_dir).credits())


_LABELS = {"first_touch": "First-Touch", "last_touch": "Last-Touch", "linear": "Linear", "time_decay": "Time-Decay"}


@register("credit_long", with_ctes(credits_sql()) + " UNION ALL ".join(
    f"SELECT channel, '{_LABELS[m]}' AS model, {_r2(m + '_revenue')} AS attributed_revenue FROM credits"
    for m in FOUR_MODELS))
def q_credit_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit_long(Pipeline(spark, sf_dir).credits())


@register("model_share", with_ctes(credits_sql()) + f"""
SELECT channel, {_r2('time_decay_revenue')} AS attributed_revenue,
       CAST(attributed_conversions AS BIGINT) AS total_conversions,
       ROUND(CAST(time_decay_revenue AS DOUBLE) * 100.0
             / NULLIF(SUM(CAST(time_decay_revenue AS DOUBLE)) OVER (), 0), 1) AS share_pct
FROM credits WHERE channel IN {PAID_IN}""")
def q_model_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_share(Pipeline(spark, sf_dir).credits(), "time_decay", PAID_CHANNELS)


@register("model_share_all", with_ctes(credits_sql()) + "SELECT channel, " + ", ".join(
    [f"{_r2(m + '_revenue')} AS {m}_revenue" for m in FOUR_MODELS]
    + [f"ROUND(CAST({m}_revenue AS DOUBLE) * 100.0 / NULLIF(SUM(CAST({m}_revenue AS DOUBLE)) OVER (), 0), 1) AS {m}_pct"
       for m in FOUR_MODELS]) + " FROM credits")
def q_model_share_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_share_all(Pipeline(spark, sf_dir).credits())


def _band_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN '' WHEN {x} >= 2.5 THEN 'high' "
            f"WHEN {x} >= 1.5 THEN 'medium' ELSE 'low' END")


def _comparison_keep_credit_sql(credits: str = "credits") -> str:
    rev = {m: f"COALESCE(CAST(cr.{m}_revenue AS DOUBLE), 0.0)" for m in FOUR_MODELS}
    spend = "CAST(s.total_spend_usd AS DOUBLE)"
    cols = ",\n  ".join(
        [f"{_r2(rev[m])} AS {m}_revenue" for m in FOUR_MODELS]
        + [f"ROUND({rev[m]} / NULLIF({spend}, 0), 2) AS {m}_roas" for m in FOUR_MODELS]
    )
    return f"""
spend_agg2 AS (
  SELECT channel, SUM(spend_usd) AS total_spend_usd,
         CAST(SUM(platform_reported_conversions) AS BIGINT) AS total_platform_conversions
  FROM stg_spend GROUP BY channel
),
comparison_all AS (
SELECT cr.channel, {_r2('s.total_spend_usd')} AS total_spend_usd, s.total_platform_conversions,
  {cols},
  ROUND(s.total_platform_conversions * 160.0 / NULLIF({spend}, 0), 2) AS platform_reported_roas
FROM {credits} cr LEFT JOIN spend_agg2 s ON s.channel = cr.channel
)"""


@register("roas_table", with_ctes(credits_sql(), _comparison_keep_credit_sql()) + f"""
SELECT channel, total_spend_usd, platform_reported_roas,
       {', '.join(f'{m}_roas' for m in FOUR_MODELS)},
       {_band_sql('platform_reported_roas')} AS platform_band,
       {', '.join(f"{_band_sql(m + '_roas')} AS {m}_band" for m in FOUR_MODELS)}
FROM comparison_all""")
def q_roas_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return roas_table(attribution_comparison(p.credits(), p.spend, keep="credit"))


@register("roas_consistency", with_ctes(credits_sql(), comparison_sql()) + "SELECT " + ", ".join(
    [f"ROUND(SUM(total_spend_usd * {m}_roas), 2) AS {m}_implied_revenue" for m in FOUR_MODELS]
    + [f"ROUND(SUM({m}_revenue), 2) AS {m}_revenue" for m in FOUR_MODELS]) + " FROM comparison")
def q_roas_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return roas_consistency(attribution_comparison(p.credits(), p.spend))


_CREDIT_COUNTS = ("touches", "attributed_conversions", "attributed_users", "first_touch_conversions",
                  "first_touch_users", "last_touch_conversions", "last_touch_users")
_CREDIT_REVS = ("first_touch", "last_touch", "linear", "time_decay", "position_based")


def _credits_full_sql(name: str = "credits") -> str:
    return "SELECT channel, " + ", ".join(
        [f"CAST({c} AS BIGINT) AS {c}" for c in _CREDIT_COUNTS]
        + [f"{_r2(m + '_revenue')} AS {m}_revenue" for m in _CREDIT_REVS]) + f" FROM {name}"


def _credits_full(df: DataFrame) -> DataFrame:
    return df.select("channel", *[F.col(c).cast("long").alias(c) for c in _CREDIT_COUNTS],
                     *[money(F.col(f"{m}_revenue")).alias(f"{m}_revenue") for m in _CREDIT_REVS])


@register("attribution_credits", with_ctes(credits_sql()) + _credits_full_sql())
def q_credits_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credits_full(Pipeline(spark, sf_dir).credits())


@register("attribution_credits_user_scope", with_ctes(credits_sql(scope="user")) + _credits_full_sql())
def q_credits_full_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credits_full(Pipeline(spark, sf_dir).credits(scope="user"))
