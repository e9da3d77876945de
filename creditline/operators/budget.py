"""Budget decisions: projected revenue, reallocation, what-if grid, scorecard.

Scenarios are generated from data, not loops: the current paid spend is one
conditional aggregate row per ``by`` key (advertiser, market, ...), ``explode``
produces the shift steps and splits on it, and a second ``explode`` over an array
of channel structs turns each scenario into per-channel rows.  Thousands of
advertisers are one job; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditline.functions.columns import PAID_CHANNELS, PLATFORM_AOV, safe_ratio

# True ROAS of the channels not measured by the holdout test, and
# the labels and shares of the redistribution splits.
DEFAULT_TRUE_ROAS: dict[str, float] = {"Google_Paid_Search": 2.65, "TikTok_Ads": 2.10}
SPLITS: tuple[tuple[str, float, float], ...] = (
    ("50% Google / 50% TikTok", 0.5, 0.5),
    ("100% Google Search", 1.0, 0.0),
    ("100% TikTok Ads", 0.0, 1.0),
)
SOURCE_CHANNEL = "Meta_Paid_Social"
SINK_CHANNELS = ("Google_Paid_Search", "TikTok_Ads")
SHIFT_STEP_USD = 10_000.0
MAX_SHIFT_SHARE = 0.6
FIXED_SHIFT_USD = 100_000.0


def current_allocation(spend: DataFrame, channels: Sequence[str] = PAID_CHANNELS, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` key one row: total spend per paid channel as columns (conditional sums)."""
    return spend.groupBy(*by).agg(
        *[F.sum(F.when(F.col("channel") == c, F.col("spend_usd"))).cast("double").alias(c) for c in channels]
    )


def true_roas_row(incremental_roas: DataFrame, others: Mapping[str, float] = DEFAULT_TRUE_ROAS, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` key one row of true ROAS per paid channel: source channel from the
    holdout test, the others from constants (I4)."""
    return incremental_roas.select(
        *by,
        F.col("incremental_roas").alias(f"roas_{SOURCE_CHANNEL}"),
        *[F.lit(float(v)).alias(f"roas_{k}") for k, v in others.items()],
    )


def _with_roas(alloc: DataFrame, roas: DataFrame, by: Sequence[str]) -> DataFrame:
    return alloc.join(roas, list(by), "left") if by else alloc.crossJoin(roas)


def _channel_rows(alloc_cols: Mapping[str, Column]) -> Column:
    """Array of (channel, current, simulated) structs, exploded into rows."""
    return F.explode(
        F.array(*[
            F.struct(F.lit(ch).alias("channel"), F.col(ch).alias("current_spend"), sim.alias("sim_spend"),
                     F.col(f"roas_{ch}").alias("true_roas"))
            for ch, sim in alloc_cols.items()
        ])
    )


def _simulated(shift: Column, g_share: Column, t_share: Column) -> dict[str, Column]:
    """Spend after the shift; NULL where the source channel has less than that."""
    g, t = SINK_CHANNELS
    ok = shift <= F.col(SOURCE_CHANNEL)
    return {
        SOURCE_CHANNEL: F.when(ok, F.col(SOURCE_CHANNEL) - shift),
        g: F.when(ok, F.col(g) + shift * g_share),
        t: F.when(ok, F.col(t) + shift * t_share),
    }


def projected_revenue(alloc: DataFrame, roas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Projected revenue = spend x true ROAS per channel."""
    j = _with_roas(alloc, roas, by)
    rows = j.select(*by, _channel_rows({c: F.col(c) for c in PAID_CHANNELS}).alias("r")).select(*by, "r.*")
    return rows.select(
        *by,
        "channel",
        F.round("current_spend", 2).alias("spend"),
        F.col("true_roas"),
        F.round(F.col("current_spend") * F.col("true_roas"), 2).alias("projected_revenue"),
    )


def reallocation(
    alloc: DataFrame, roas: DataFrame, shift_usd: float = FIXED_SHIFT_USD, g_share: float = 0.5, t_share: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Fixed move of ``shift_usd`` out of the source channel, split over the sinks.

    Where the source channel spends less than that, feasible is false and the
    simulated columns are NULL."""
    j = _with_roas(alloc, roas, by)
    sims = _simulated(F.lit(float(shift_usd)), F.lit(g_share), F.lit(t_share))
    j = j.withColumn("feasible", F.coalesce(F.lit(float(shift_usd)) <= F.col(SOURCE_CHANNEL), F.lit(False)))
    keys = [*by, "feasible"]
    rows = j.select(*keys, _channel_rows(sims).alias("r")).select(*keys, "r.*")
    return _score(rows, keys)


def _score(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cur = F.col("current_spend") * F.col("true_roas")
    sim = F.col("sim_spend") * F.col("true_roas")
    return rows.select(
        *keys,
        "channel",
        F.round("current_spend", 2).alias("current_spend"),
        F.round("sim_spend", 2).alias("sim_spend"),
        "true_roas",
        F.round(cur, 2).alias("current_revenue"),
        F.round(sim, 2).alias("sim_revenue"),
        F.round(sim - cur, 2).alias("revenue_delta"),
    )


def scenario_grid(
    alloc: DataFrame,
    roas: DataFrame,
    step_usd: float | None = SHIFT_STEP_USD,
    max_share: float = MAX_SHIFT_SHARE,
    n_steps: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """What-if grid (I3): shifts 0, step, ... up to ``max_share`` of the source
    channel's spend, times the three splits, scored per channel.

    With ``n_steps`` the range is cut into that many equal steps instead, so the
    grid has the same size whatever the spend."""
    j = _with_roas(alloc, roas, by)
    top = F.coalesce(F.col(SOURCE_CHANNEL), F.lit(0.0)) * F.lit(max_share)
    if n_steps is None:
        steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(top / F.lit(step_usd)).cast("long"), F.lit(0).cast("long")))
        shift = F.col("_step").cast("double") * F.lit(step_usd)
    else:
        steps = F.sequence(F.lit(0).cast("long"), F.lit(n_steps).cast("long"))
        shift = F.col("_step").cast("double") / F.lit(float(n_steps)) * top
    splits = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(g).alias("g"), F.lit(t).alias("t")) for n, g, t in SPLITS])
    grid = j.withColumn("_step", F.explode(steps)).withColumn("_split", F.explode(splits)).withColumn("shift_usd", shift)
    grid = grid.select("*", F.col("_split.split").alias("split"), F.col("_split.g").alias("_g"), F.col("_split.t").alias("_t")).drop("_split")
    sims = _simulated(F.col("shift_usd"), F.col("_g"), F.col("_t"))
    grid = grid.select("*", *[sim.alias(f"_sim_{ch}") for ch, sim in sims.items()])
    keys = [*by, "shift_usd", "split"]
    rows = grid.select(*keys, _channel_rows({ch: F.col(f"_sim_{ch}") for ch in sims}).alias("r")).select(*keys, "r.*")
    return _score(rows, keys)


def scenario_summary(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total current/simulated revenue and delta % per scenario."""
    s = grid.groupBy(*by, "shift_usd", "split").agg(
        F.sum("current_revenue").alias("_cur"), F.sum("sim_revenue").alias("_sim")
    )
    return s.select(
        *by,
        "shift_usd",
        "split",
        F.round("_cur", 2).alias("current_revenue"),
        F.round("_sim", 2).alias("sim_revenue"),
        F.round(safe_ratio((F.col("_sim") - F.col("_cur")) * 100.0, F.col("_cur")), 2).alias("delta_pct"),
    )


def best_scenario(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scenario with the highest simulated revenue (ties: smaller shift, then split name)."""
    key = F.struct(F.col("sim_revenue"), -F.col("shift_usd"), F.col("split"))
    return summary.groupBy(*by).agg(
        F.max_by(F.struct("shift_usd", "split", "sim_revenue", "delta_pct"), key).alias("b")
    ).select(*by, "b.*")


def scorecard(
    spend: DataFrame,
    roas: DataFrame,
    platform_aov: float = PLATFORM_AOV,
    cut_below: float = 1.0,
    cut_below_platform_share: float | None = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Platform ROAS vs true ROAS per paid channel, cannibalisation and action.

    action = 'cut' when the true ROAS is below break-even (``cut_below``) or below
    ``cut_below_platform_share`` of what the platform claims (a policy of this
    library; None leaves only the break-even rule), else 'increase'."""
    per = spend.filter(F.col("channel").isin(*PAID_CHANNELS)).groupBy(*by, "channel").agg(
        F.sum("spend_usd").cast("double").alias("spend"),
        F.sum("platform_reported_conversions").cast("long").alias("claims"),
    )
    r = roas.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"roas_{c}").alias("true_roas")) for c in PAID_CHANNELS])).alias("x")
    ).select(*by, "x.*")
    j = per.join(r, [*by, "channel"])
    platform = F.round(safe_ratio(F.col("claims") * F.lit(platform_aov), F.col("spend")), 2)
    cut = F.col("true_roas") < cut_below
    if cut_below_platform_share is not None:
        cut = cut | (F.col("true_roas") < platform * cut_below_platform_share)
    return j.select(
        *by,
        "channel",
        platform.alias("platform_roas"),
        F.round("true_roas", 2).alias("true_roas"),
        F.round((F.lit(1.0) - safe_ratio(F.col("true_roas"), platform)) * 100.0, 1).alias("cannibalization_pct"),
        F.when(cut, F.lit("cut")).otherwise(F.lit("increase")).alias("action"),
    )
