"""DuckDB SQL text for the adapter, staging, dedup and pair layers.

Written as plain SQL (windows, joins, CASE) independently of the Spark
operators, so an equal result is a real cross-check.  Every oracle query is
``WITH <these CTEs>, ... SELECT ...`` over the pre-registered driver views.
"""

from __future__ import annotations

from creditline.functions.columns import CHANNEL_ALIASES, PAID_CHANNELS, SPEND_ALIASES
from creditline.sources.adapter import (
    DUP_ID_OFFSET,
    DUP_MODULUS,
    EXPERIMENT_END,
    EXPERIMENT_START,
    HOLDOUT_NATION_LIMIT,
    RAW_CHANNELS,
    RAW_SPEND_CHANNELS,
)
from datetime import timedelta


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WIN_START = f"TIMESTAMP '{EXPERIMENT_START.isoformat()}'"
WIN_END_EXCL = f"TIMESTAMP '{(EXPERIMENT_END + timedelta(days=1)).isoformat()}'"
WIN_START_DATE = f"DATE '{EXPERIMENT_START.isoformat()}'"
WIN_END_DATE = f"DATE '{EXPERIMENT_END.isoformat()}'"
PAID_IN = "(" + ", ".join(q(c) for c in PAID_CHANNELS) + ")"


def _case_index(expr: str, values: tuple[str, ...]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def pg_initcap_sql(x: str) -> str:
    """PostgreSQL INITCAP in DuckDB (which has none)."""
    s = f"lower({x})"
    return (
        f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: "
        f"CASE WHEN i = 1 OR NOT regexp_matches(substr({s}, i - 1, 1), '[[:alnum:]]') "
        f"THEN upper(substr({s}, i, 1)) ELSE substr({s}, i, 1) END), '')"
    )


def canonical_channel_sql(x: str, aliases=CHANNEL_ALIASES) -> str:
    key = f"lower(trim({x}))"
    whens = " ".join(
        f"WHEN {key} IN ({', '.join(q(a) for a in names)}) THEN {q(canon)}" for canon, names in aliases.items()
    )
    return f"CASE {whens} ELSE {pg_initcap_sql(f'trim({x})')} END"


_PAUSED = (
    f"COALESCE(n_nationkey < {HOLDOUT_NATION_LIMIT} AND ts >= {WIN_START} AND ts < {WIN_END_EXCL} "
    f"AND k % 10 IN (0, 1), FALSE)"
)

ADAPTER_CTES = f"""
base AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type,
         CAST(e.value AS DECIMAL(18,2)) AS v,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) AS k,
         n.n_name AS dma_code, n.n_nationkey
  FROM events e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
base_p AS (SELECT *, {_PAUSED} AS paused FROM base),
tp0 AS (
  SELECT event_id, user_id,
         CAST(date_trunc('second', ts) AS TIMESTAMP) AS "timestamp",
         {_case_index('k % 10', RAW_CHANNELS)} AS channel,
         CASE WHEN k % 4 = 0 THEN upper(event_type) WHEN k % 4 = 1 THEN ' ' || event_type || ' '
              WHEN k % 4 = 2 THEN event_type END AS utm_source,
         CASE WHEN k % 10 < 6 THEN (CASE WHEN k % 2 = 0 THEN 'CPC' ELSE 'cpc ' END)
              WHEN k % 10 < 8 THEN 'organic' ELSE 'Email' END AS utm_medium,
         CASE WHEN k % 5 = 4 THEN NULL WHEN k % 2 = 0 THEN 'Jan_' || upper(event_type)
              ELSE ' jan_' || event_type END AS campaign_name,
         dma_code
  FROM base_p WHERE event_type <> 'purchase' AND NOT paused
),
raw_touchpoints AS (
  SELECT * FROM tp0
  UNION ALL
  SELECT event_id + {DUP_ID_OFFSET} AS event_id, user_id, "timestamp", channel, utm_source, utm_medium,
         campaign_name, dma_code
  FROM tp0 WHERE event_id % {DUP_MODULUS} = 0
),
raw_conversions AS (
  SELECT event_id AS conversion_id, user_id, 'ORD_' || CAST(event_id AS VARCHAR) AS order_id,
         ts AS converted_at, v AS order_value_usd, dma_code
  FROM base WHERE event_type = 'purchase'
),
raw_ad_spend AS (
  SELECT CAST(ts AS DATE) AS "date",
         {_case_index('(k % 10) // 2', RAW_SPEND_CHANNELS)} AS channel,
         dma_code,
         CAST(SUM(CASE WHEN paused THEN CAST(0 AS DECIMAL(18,2)) ELSE v END) AS DECIMAL(18,2)) AS daily_spend_usd,
         CAST(SUM(CASE WHEN paused THEN 0 ELSE 1 END) AS INTEGER) AS platform_reported_conversions
  FROM base_p WHERE event_type <> 'purchase' AND k % 10 < 6
  GROUP BY 1, 2, 3
),
population AS (
  SELECT n.n_name AS dma_code, COUNT(*) AS population
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1
),
holdout AS (SELECT n_name AS dma_code FROM nation WHERE n_nationkey < {HOLDOUT_NATION_LIMIT})
"""

STAGING_CTES = f"""
stg_touchpoints AS (
  SELECT event_id, user_id, CAST("timestamp" AS TIMESTAMP) AS event_timestamp,
         lower(trim(utm_source)) AS utm_source, lower(trim(utm_medium)) AS utm_medium,
         lower(trim(campaign_name)) AS utm_campaign,
         {canonical_channel_sql('channel')} AS channel,
         trim(dma_code) AS dma_code
  FROM raw_touchpoints
),
stg_conversions AS (
  SELECT conversion_id, user_id, order_id, CAST(converted_at AS TIMESTAMP) AS converted_at,
         CAST(order_value_usd AS DECIMAL(18,2)) AS order_value_usd, trim(dma_code) AS dma_code
  FROM raw_conversions
),
stg_spend AS (
  SELECT CAST("date" AS DATE) AS ad_date, {canonical_channel_sql('channel', SPEND_ALIASES)} AS channel,
         trim(dma_code) AS dma_code, CAST(daily_spend_usd AS DECIMAL(18,2)) AS spend_usd,
         CAST(platform_reported_conversions AS INTEGER) AS platform_reported_conversions
  FROM raw_ad_spend
),
deduped AS (
  SELECT event_id, user_id, event_timestamp, utm_source, utm_medium, utm_campaign, channel, dma_code
  FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_timestamp, channel ORDER BY event_id) AS rn
    FROM stg_touchpoints
  ) WHERE rn = 1
)
"""


def pairs_cte(name: str = "pairs", lookback_days: int | None = 90, extra_cols: tuple[str, ...] = ()) -> str:
    window = "" if lookback_days is None else f" AND t.event_timestamp >= c.converted_at - INTERVAL {int(lookback_days)} DAY"
    extra = "".join(f" t.{c}," for c in extra_cols)
    return f"""
{name} AS (
  SELECT t.user_id, t.event_id, t.channel, t.dma_code,{extra} t.event_timestamp AS touchpoint_ts,
         c.conversion_id, c.converted_at AS conversion_ts, c.order_value_usd
  FROM deduped t JOIN stg_conversions c ON t.user_id = c.user_id
  WHERE t.event_timestamp <= c.converted_at{window}
)"""


def with_ctes(*extra: str, lookback_days: int | None = 90) -> str:
    parts = [ADAPTER_CTES.strip(), STAGING_CTES.strip(), pairs_cte("pairs", lookback_days).strip()]
    parts += [e.strip() for e in extra]
    return "WITH " + ",\n".join(parts) + "\n"


def norm_tail_sql(x: str) -> str:
    """1 - Phi(|x|) by Simpson's rule over [|x|, |x| + 12], 2,000 panels."""
    weight = "(CASE WHEN i IN (0, 2000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    at = f"(abs(CAST({x} AS DOUBLE)) + i * 0.006)"
    return f"(list_sum(list_transform(range(0, 2001), lambda i: {weight} * exp(-{at} * {at} / 2.0))) * 0.002 / sqrt(2.0 * pi()))"
