"""Registered queries: multivariate market matching, journey paths, quarantine, mergeable sketches."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.functions.columns import money
from creditline.operators import matching, paths, sketches
from creditline.operators.geo import CONTROL, TREATMENT
from creditline.plans.oracle_base import WIN_START, with_ctes
from creditline.plans.pipeline import Pipeline
from creditline.plans.registry import register
from creditline.sources.adapter import EXPERIMENT_START, read_table
from creditline.sources.quarantine import REASON, Rule, accepted, checked, rejected, rejects_report

# ------------------------------------------- matched markets (H20) ---------

FEATURES = ("conversion_rate", "revenue_per_capita", "touches_per_capita")
_MATCH_SQL = f"""
, cv AS (SELECT dma_code, COUNT(*) AS c, CAST(SUM(order_value_usd) AS DOUBLE) AS r FROM stg_conversions WHERE converted_at < {WIN_START} GROUP BY 1),
tv AS (SELECT dma_code, COUNT(*) AS t FROM deduped WHERE event_timestamp < {WIN_START} GROUP BY 1),
mf AS (
  SELECT p.dma_code, p.dma_code IN (SELECT dma_code FROM holdout) AS ctrl,
         COALESCE(c, 0) / NULLIF(CAST(population AS DOUBLE), 0) AS f1, COALESCE(r, 0) / NULLIF(CAST(population AS DOUBLE), 0) AS f2,
         COALESCE(t, 0) / NULLIF(CAST(population AS DOUBLE), 0) AS f3
  FROM population p LEFT JOIN cv USING (dma_code) LEFT JOIN tv USING (dma_code)
),
mz AS (
  SELECT dma_code, ctrl, COALESCE((f1 - avg(f1) OVER ()) / NULLIF(stddev_pop(f1) OVER (), 0), 0) AS z1,
         COALESCE((f2 - avg(f2) OVER ()) / NULLIF(stddev_pop(f2) OVER (), 0), 0) AS z2,
         COALESCE((f3 - avg(f3) OVER ()) / NULLIF(stddev_pop(f3) OVER (), 0), 0) AS z3
  FROM mf WHERE f1 IS NOT NULL
),
md AS (
  SELECT t.dma_code AS treatment_dma, c.dma_code AS control_dma,
         ROUND(sqrt(pow(t.z1 - c.z1, 2) + pow(t.z2 - c.z2, 2) + pow(t.z3 - c.z3, 2)), 9) AS d
  FROM mz t, mz c WHERE c.ctrl AND NOT t.ctrl
)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    before = F.lit(EXPERIMENT_START).cast("timestamp_ntz")
    return matching.zscored(matching.market_features(p.conversions, p.deduped, p.inputs.population, p.inputs.holdout_markets, before), FEATURES)


@register("matched_markets_knn", with_ctes() + _MATCH_SQL + """
SELECT treatment_dma, control_dma, ROUND(d, 6) AS distance, place FROM (
  SELECT *, row_number() OVER (PARTITION BY treatment_dma ORDER BY d, control_dma) AS place FROM md) WHERE place <= 3""")
def q_matched_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = matching.nearest_controls(_scored(spark, sf_dir), 3)
    return near.select("treatment_dma", "control_dma", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"))


@register("matched_markets_assigned", with_ctes().replace("WITH ", "WITH RECURSIVE ", 1) + _MATCH_SQL + """
, taken AS (
  SELECT CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS cs, CAST(NULL AS VARCHAR) AS treatment_dma, CAST(NULL AS VARCHAR) AS control_dma,
         CAST(NULL AS DOUBLE) AS d
  UNION ALL
  SELECT list_append(ts, best.t), list_append(cs, best.c), best.t, best.c, best.d FROM (
    SELECT any_value(x.ts) AS ts, any_value(x.cs) AS cs,
           min({'d': md.d, 't': md.treatment_dma, 'c': md.control_dma}) AS best
    FROM taken x, md WHERE NOT list_contains(x.ts, md.treatment_dma) AND NOT list_contains(x.cs, md.control_dma)) WHERE best IS NOT NULL
)
SELECT treatment_dma, control_dma, ROUND(d, 6) AS distance FROM taken WHERE treatment_dma IS NOT NULL""")
def q_matched_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.assign_controls(_scored(spark, sf_dir))
    return pairs.select("treatment_dma", "control_dma", F.round("distance", 6).alias("distance"))


# ------------------------------------------------- journey paths (F11) -----

_PATHS_SQL = """
, jp AS (
  SELECT conversion_id, user_id, order_value_usd, list(channel ORDER BY touchpoint_ts, event_id) AS path
  FROM pairs GROUP BY conversion_id, user_id, order_value_usd
)"""


@register("journey_paths", with_ctes() + _PATHS_SQL + """
SELECT conversion_id, user_id, array_to_string(path, ' > ') AS path, CAST(len(path) AS BIGINT) AS touches FROM jp""")
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    rows = paths.journey_paths(p.deduped, p.conversions)
    return rows.select("conversion_id", "user_id", F.array_join("path", paths.ARROW).alias("path"), "touches")


@register("path_report", with_ctes() + _PATHS_SQL + """
, runs AS (
  SELECT *, list_filter(path, lambda x, i: i = 1 OR x <> path[i - 1]) AS short FROM jp
)
SELECT array_to_string(short, ' > ') AS path, CAST(len(short) AS BIGINT) AS steps, COUNT(*) AS conversions,
       ROUND(CAST(SUM(order_value_usd) AS DOUBLE), 2) AS revenue_usd, ROUND(AVG(order_value_usd), 4) AS mean_order_value_usd,
       ROUND(AVG(len(path)), 4) AS mean_touches
FROM runs GROUP BY 1, 2""")
def q_path_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return paths.path_report(paths.journey_paths(p.deduped, p.conversions))


# ---------------------------------------------------- quarantine (L4) ------

RULES = {
    "event_id": Rule("bigint"),
    "ts": Rule("timestamp_ntz"),
    "user_id": Rule("bigint"),
    "value": Rule("decimal(18,2)", required=False, minimum=0),
    "event_type": Rule("string", values=("view", "click", "purchase", "signup", "cart", "search", "login", "logout", "error", "add_to_cart")),
}


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as text, with planted faults; row is the true id."""
    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")

    def planted(mod: int, bad: str, good):
        return F.when(i % mod == 0, F.lit(bad)).otherwise(good)

    return e.select(
        i.alias("row"),
        F.when(i % 103 == 0, " ").otherwise(planted(101, "x17", i.cast("string"))).alias("event_id"),
        planted(97, "2024-13-45 00:00:00", F.col("ts").cast("timestamp_ntz").cast("string")).alias("ts"),
        planted(107, "12.5e", F.col("user_id").cast("string")).alias("user_id"),
        planted(89, "-1.50", planted(83, "abc", planted(7, "", F.format_string("%.2f", F.col("value").cast("double"))))).alias("value"),
        planted(79, "refund", F.concat(F.lit(" "), F.lit("Click"))).alias("event_type"),
    )


_FAULT_SQL = """
faults AS (
  SELECT event_id AS row, list_filter([
    CASE WHEN event_id % 103 = 0 THEN 'event_id: missing' WHEN event_id % 101 = 0 THEN 'event_id: not a bigint' END,
    CASE WHEN event_id % 97 = 0 THEN 'ts: not a timestamp_ntz' END,
    CASE WHEN event_id % 107 = 0 THEN 'user_id: not a bigint' WHEN user_id IS NULL THEN 'user_id: missing' END,
    CASE WHEN event_id % 89 = 0 THEN 'value: below 0' WHEN event_id % 83 = 0 THEN 'value: not a decimal(18,2)'
         WHEN event_id % 7 <> 0 AND ROUND(value, 2) < 0 THEN 'value: below 0' END,
    CASE WHEN event_id % 79 = 0 THEN 'event_type: not accepted' END], lambda x: x IS NOT NULL) AS reasons,
    user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value
  FROM events
)"""


@register("quarantine_rejects", "WITH " + _FAULT_SQL + "SELECT row, array_to_string(reasons, '; ') AS reject_reason FROM faults WHERE len(reasons) > 0")
def q_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(checked(_faulty(spark, sf_dir), RULES)).select("row", REASON)


@register("quarantine_accepted", "WITH " + _FAULT_SQL + """
SELECT row AS event_id, user_id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS BIGINT) AS event_micros, ROUND(CAST(value AS DOUBLE), 2) AS value_usd, 'Click' AS event_type
FROM faults WHERE len(reasons) = 0""")
def q_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from creditline.functions.columns import wall_micros

    good = accepted(checked(_faulty(spark, sf_dir), RULES), RULES)
    return good.select("event_id", "user_id", wall_micros("ts").alias("event_micros"), money(F.col("value")).alias("value_usd"), "event_type")


@register("quarantine_report", "WITH " + _FAULT_SQL + """
SELECT reason, COUNT(*) AS rows FROM (SELECT UNNEST(CASE WHEN len(reasons) = 0 THEN ['ok'] ELSE reasons END) AS reason FROM faults) GROUP BY 1""")
def q_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects_report(checked(_faulty(spark, sf_dir), RULES))


# ---------------------------------------------------- sketches (E, H22) ----

RANGES = {"all": (None, None), "week": (date(2024, 1, 8), date(2024, 1, 14)), "month": (date(2024, 1, 1), date(2024, 1, 31))}
#: Allowed error: five standard errors of a sketch of 2^12 registers, and one user.
REACH_ERROR = 5 * 1.04 / 2**6


@register("reach_by_range", with_ctes() + " UNION ALL ".join(f"""
SELECT '{n}' AS period, channel, COUNT(*) AS touches, COUNT(DISTINCT user_id) AS exact_users, TRUE AS within_error
FROM deduped {f"WHERE event_timestamp >= DATE '{a}' AND event_timestamp < DATE '{b}' + INTERVAL 1 DAY" if a else ''} GROUP BY channel"""
                                                                   for n, (a, b) in RANGES.items()))
def q_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched users of three ranges, checked against the exact number."""
    t = Pipeline(spark, sf_dir).deduped
    daily, out = sketches.reach_sketches(t), None
    for name, (a, b) in RANGES.items():
        day = F.to_date("event_timestamp")
        rows = t if a is None else t.where((day >= F.lit(a)) & (day <= F.lit(b)))
        exact = rows.groupBy("channel").agg(F.count_distinct("user_id").alias("exact_users"))
        one = sketches.reach(daily, a, b).join(exact, "channel").select(
            F.lit(name).alias("period"), "channel", "touches", "exact_users",
            (F.abs(F.col("users") - F.col("exact_users")) <= F.col("exact_users") * REACH_ERROR + 1).alias("within_error"))
        out = one if out is None else out.unionByName(one)
    return out


RANKS = (0.1, 0.5, 0.9)
RANK_ERROR = 0.02


@register("order_value_quantiles", with_ctes() + f"""
, ov AS (SELECT CASE WHEN dma_code IN (SELECT dma_code FROM holdout) THEN '{CONTROL}' ELSE '{TREATMENT}' END AS arm FROM stg_conversions)
SELECT arm, q, COUNT(*) AS n, TRUE AS within_error FROM ov, (SELECT UNNEST([{', '.join(map(str, RANKS))}]) AS q) GROUP BY arm, q""")
def q_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched quantiles of the order value by arm, checked by their exact ranks."""
    p = Pipeline(spark, sf_dir)
    ctrl = p.inputs.holdout_markets.select("dma_code", F.lit(True).alias("_c")).distinct()
    rows = p.conversions.join(ctrl, "dma_code", "left").withColumn("arm", F.when(F.col("_c"), CONTROL).otherwise(TREATMENT))
    daily = sketches.quantile_sketches(rows, "order_value_usd", "converted_at", ["arm"])
    found = sketches.quantiles(daily, RANKS, keys=["arm"])
    ranks = F.array(*[F.lit(float(q)) for q in RANKS])
    each = found.select("arm", "n", F.explode(F.arrays_zip(ranks.alias("q"), F.col("quantiles").alias("v"))).alias("x")).select("arm", "n", "x.q", "x.v")
    v = F.col("order_value_usd").cast("double")
    placed = rows.select("arm", v.alias("order_value")).join(each, "arm").groupBy("arm", "q", "n").agg(
        F.count_if(F.col("order_value") < F.col("v")).alias("below"), F.count_if(F.col("order_value") <= F.col("v")).alias("upto"))
    ok = (F.col("below") / F.col("n") <= F.col("q") + RANK_ERROR) & (F.col("upto") / F.col("n") >= F.col("q") - RANK_ERROR)
    return placed.select("arm", "q", "n", ok.alias("within_error"))
