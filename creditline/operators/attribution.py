"""Multi-touch attribution.

One pass computes every model.  The plan never windows over the raw pairs:

1. pairs -> aggregate per (by, user_id, conversion_id, credit_key):
   touch count, sum of decay weights, first/last order key (packed DECIMAL, so
   this stays a hash aggregate with map-side combine right after the join);
2. (user scope only) roll up to (by, user_id, credit_key);
3. a window over the attribution unit on these rows (at most one row per
   credit key per unit, so the window group is bounded) gives unit totals and
   the unit's first/last touch;
4. per-key credits -> aggregate per (by, credit_key, user_id) -> (by, credit_key):
   a two-level aggregate instead of COUNT(DISTINCT), so there is no Expand.

``scope='conversion'`` (default) splits each order's value over that order's
eligible touches; ``scope='user'`` reproduces the per-user windows of the SQL
pipeline, where all of a user's pairs form one journey.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.functions.columns import (
    HALF_LIFE_DAYS,
    LOOKBACK_DAYS,
    PAID_CHANNELS,
    PLATFORM_AOV,
    days_between,
    money,
    order_key_for,
    roas_band,
    safe_ratio,
    wall_micros,
)
from creditline.operators.sweep import order_credits

#: Weights span at most this many half-lives in one sum of doubles.
MAX_HALF_LIVES = 1000
BLOCK_HALF_LIVES = 500

MODELS = ("first_touch", "last_touch", "linear", "time_decay", "position_based")
FOUR_MODELS = ("first_touch", "last_touch", "linear", "time_decay")
MODEL_LABELS = {
    "first_touch": "First-Touch",
    "last_touch": "Last-Touch",
    "linear": "Linear",
    "time_decay": "Time-Decay",
    "position_based": "Position-Based",
}


def _order_key(df: DataFrame) -> Column:
    return order_key_for(df, "touchpoint_ts", "event_id")


def attribute(
    pairs: DataFrame,
    scope: str = "conversion",
    half_life_days: float = HALF_LIFE_DAYS,
    anchor: str = "conversion",
    position: tuple[float, float] = (0.4, 0.4),
    credit_key: str = "channel",
    by: Sequence[str] = (),
    max_age_days: float | None = None,
) -> DataFrame:
    """Credit table: one row per (by, credit_key) with every model's revenue.

    ``max_age_days`` states the lookback of the pairs: within MAX_HALF_LIVES
    half-lives no weight can underflow, and one aggregate is enough.  Without it
    the weights are summed by blocks of half-lives; the credits are the same.

    Columns: by..., credit_key, touches, attributed_conversions, attributed_users,
    first_touch_conversions, first_touch_users, last_touch_conversions,
    last_touch_users, first_touch_revenue, last_touch_revenue (exact DECIMAL),
    linear_revenue, time_decay_revenue, position_based_revenue (DOUBLE).
    """
    if scope not in ("conversion", "user"):
        raise ValueError("scope must be 'conversion' or 'user'")
    by = list(by)
    key = credit_key
    unit = [*by, "conversion_id"] if scope == "conversion" else [*by, "user_id"]

    if anchor not in ("conversion", "last_touch"):
        raise ValueError("anchor must be 'conversion' or 'last_touch'")
    # Shares within a unit do not change when all its weights are scaled alike, so
    # every order's weights are taken relative to its conversion.
    age = days_between(F.col("touchpoint_ts"), F.col("conversion_ts")) / F.lit(float(half_life_days))
    ok = _order_key(pairs)
    bounded = max_age_days is not None and max_age_days / half_life_days <= MAX_HALF_LIVES
    block = F.lit(0).cast("long") if bounded else F.floor(age / BLOCK_HALF_LIVES).cast("long")
    order_keys = [*by, "user_id", "conversion_id", key]
    p = pairs if bounded else pairs.withColumn("_block", block)
    g = p.groupBy(*order_keys, *([] if bounded else ["_block"])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(F.lit(2.0), block * BLOCK_HALF_LIVES - age)).alias("sw"),
        F.min(ok).alias("fk"),
        F.max(ok).alias("lk"),
        F.max("order_value_usd").alias("value"),
        F.max("conversion_ts").alias("conv_ts"),
    )
    if not bounded:
        # weights of old touches are summed relative to their own block of half-lives
        # and scaled to the youngest block of the unit, so they cannot all underflow
        scale_to = unit if anchor == "conversion" else [*by, "conversion_id"]
        youngest = g.groupBy(*scale_to).agg(F.min("_block").alias("_youngest"))
        g = g.join(youngest, scale_to)
        scaled = F.col("sw") * F.pow(F.lit(2.0), (F.col("_youngest") - F.col("_block")) * BLOCK_HALF_LIVES)
        g = g.groupBy(*order_keys).agg(
            F.sum("n").alias("n"), F.sum(scaled).alias("sw"), F.min("fk").alias("fk"), F.max("lk").alias("lk"),
            F.max("value").alias("value"), F.max("conv_ts").alias("conv_ts"), F.max("_youngest").alias("_youngest"),
        )

    u = Window.partitionBy(*unit)
    if scope == "conversion":
        rows = g.select(
            *by, "user_id", "conversion_id", key, "n", "sw",
            (F.col("value") * F.col("n")).alias("svn"),
            (F.col("value").cast("double") * F.col("sw")).alias("svw"),
            F.struct(F.col("fk").alias("k"), F.col("conversion_id").alias("c"), F.col("value").alias("v")).alias("first"),
            F.struct(F.col("lk").alias("k"), F.col("conversion_id").alias("c"), F.col("value").alias("v")).alias("last"),
            F.lit(1).cast("long").alias("n_conv"),
        )
    else:
        span: list[str] = []
        if anchor == "last_touch":
            # one anchor for all orders of the user: each order's weights move from its
            # conversion to the end of its block of half-lives, later to the user's last block
            at = wall_micros("conv_ts").cast("double") / F.lit(86_400e6 * half_life_days)
            if not bounded:
                at = at - F.col("_youngest") * BLOCK_HALF_LIVES
            g = g.withColumn("_span", F.floor(at / BLOCK_HALF_LIVES).cast("long"))
            g = g.withColumn("sw", F.col("sw") * F.pow(F.lit(2.0), at - (F.col("_span") + 1) * BLOCK_HALF_LIVES))
            span = ["_span"]
        rows = g.groupBy(*by, "user_id", key, *span).agg(
            F.sum("n").alias("n"),
            F.sum("sw").alias("sw"),
            F.sum(F.col("value") * F.col("n")).alias("svn"),
            F.sum(F.col("value").cast("double") * F.col("sw")).alias("svw"),
            F.min(F.struct(F.col("fk").alias("k"), F.col("conversion_id").alias("c"), F.col("value").alias("v"))).alias("first"),
            F.max(F.struct(F.col("lk").alias("k"), F.col("conversion_id").alias("c"), F.col("value").alias("v"))).alias("last"),
            F.count(F.lit(1)).alias("n_conv"),
        )
        if span:
            scale = F.pow(F.lit(2.0), (F.col("_span") - F.max("_span").over(u)) * BLOCK_HALF_LIVES)
            rows = rows.withColumn("_scale", scale).withColumns(
                {"sw": F.col("sw") * F.col("_scale"), "svw": F.col("svw") * F.col("_scale")}).drop("_scale", "_span")

    return _credits(rows, unit, by, key, position)


def attribute_swept(
    touches: DataFrame,
    conversions: DataFrame,
    lookback_days: int | None = LOOKBACK_DAYS,
    scope: str = "conversion",
    half_life_days: float = HALF_LIFE_DAYS,
    anchor: str = "conversion",
    position: tuple[float, float] = (0.4, 0.4),
    credit_key: str = "channel",
    bucket_hours: float = 24.0,
) -> DataFrame:
    """The credit table of ``attribute`` over all eligible pairs, without making them: prefix sums over each
    user's timeline (``sweep.order_credits``).  For heavy users, long lookbacks, or none at all."""
    if scope not in ("conversion", "user"):
        raise ValueError("scope must be 'conversion' or 'user'")
    if anchor not in ("conversion", "last_touch"):
        raise ValueError("anchor must be 'conversion' or 'last_touch'")
    g = order_credits(touches, conversions, lookback_days, half_life_days, credit_key, bucket_hours)
    unit = ["conversion_id"] if scope == "conversion" else ["user_id"]
    u = Window.partitionBy(*unit)
    if scope == "user" and anchor == "conversion":
        # every order's weights are relative to its conversion
        g = g.withColumn("lw", F.col("lw") - wall_micros("conv_ts").cast("double") / F.lit(86_400e6 * half_life_days))
    ends = [F.struct(F.col(k).alias("k"), F.col("conversion_id").alias("c"), F.col("value").alias("v")) for k in ("fk", "lk")]
    if scope == "conversion":
        sw = F.pow(F.lit(2.0), F.col("lw") - F.max("lw").over(u))
        rows = g.withColumn("sw", sw).select(
            "user_id", "conversion_id", credit_key, "n", "sw", (F.col("value") * F.col("n")).alias("svn"),
            (F.col("value").cast("double") * F.col("sw")).alias("svw"), ends[0].alias("first"), ends[1].alias("last"), F.lit(1).cast("long").alias("n_conv"))
    else:
        # sums by blocks of half-lives, scaled to the unit's largest
        g = g.withColumn("_block", F.floor(F.col("lw") / BLOCK_HALF_LIVES).cast("long"))
        g = g.withColumn("sw", F.pow(F.lit(2.0), F.col("lw") - (F.col("_block") + 1) * BLOCK_HALF_LIVES))
        rows = g.groupBy("user_id", credit_key, "_block").agg(
            F.sum("n").alias("n"), F.sum("sw").alias("sw"), F.sum(F.col("value") * F.col("n")).alias("svn"),
            F.sum(F.col("value").cast("double") * F.col("sw")).alias("svw"), F.min(ends[0]).alias("first"), F.max(ends[1]).alias("last"),
            F.count(F.lit(1)).alias("n_conv"))
        rows = rows.withColumn("_scale", F.pow(F.lit(2.0), (F.col("_block") - F.max("_block").over(u)) * BLOCK_HALF_LIVES))
        rows = rows.withColumns({"sw": F.col("sw") * F.col("_scale"), "svw": F.col("svw") * F.col("_scale")}).drop("_scale", "_block")
    return _credits(rows, unit, [], credit_key, position)


def _credits(rows: DataFrame, unit: list[str], by: list[str], key: str, position: tuple[float, float]) -> DataFrame:
    """Credits by key from rows of (unit, key, ...): totals of each unit, shares, and a two-level aggregate."""
    u = Window.partitionBy(*unit)
    rows = rows.select(
        "*",
        F.sum("n").over(u).alias("_N"),
        F.sum("sw").over(u).alias("_SW"),
        F.min("first").over(u).alias("_F1"),
        F.max("last").over(u).alias("_L1"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    is_first = F.col("first") == F.col("_F1")
    is_last = F.col("last") == F.col("_L1")
    first_part = F.when(is_first, F.col("_F1.v")).otherwise(zero)
    last_part = F.when(is_last, F.col("_L1.v")).otherwise(zero)
    pf, pl = position
    pm = 1.0 - pf - pl
    n_total = F.col("_N").cast("double")
    fp, lp, svn_d = first_part.cast("double"), last_part.cast("double"), F.col("svn").cast("double")
    pos = (
        F.when(F.col("_N") == 1, svn_d)
        .when(F.col("_N") == 2, F.lit(0.5) * (fp + lp))
        .otherwise(F.lit(pf) * fp + F.lit(pl) * lp + F.lit(pm) * (svn_d - fp - lp) / (n_total - F.lit(2.0)))
    )
    credits = rows.select(
        *by, key, "user_id", "n", "n_conv",
        is_first.alias("_is_first"),
        is_last.alias("_is_last"),
        first_part.alias("ft"),
        last_part.alias("lt"),
        (svn_d / n_total).alias("li"),
        F.try_divide(F.col("svw"), F.col("_SW")).alias("td"),
        pos.alias("pb"),
    )

    per_user = credits.groupBy(*by, key, "user_id").agg(
        F.sum("n").alias("touches"),
        F.sum("n_conv").alias("convs"),
        F.count_if("_is_first").alias("ft_convs"),
        F.count_if("_is_last").alias("lt_convs"),
        F.sum("ft").alias("ft"),
        F.sum("lt").alias("lt"),
        F.sum("li").alias("li"),
        F.sum("td").alias("td"),
        F.sum("pb").alias("pb"),
    )
    return per_user.groupBy(*by, key).agg(
        F.sum("touches").alias("touches"),
        F.sum("convs").alias("attributed_conversions"),
        F.count(F.lit(1)).alias("attributed_users"),
        F.sum("ft_convs").alias("first_touch_conversions"),
        F.count_if(F.col("ft_convs") > 0).alias("first_touch_users"),
        F.sum("lt_convs").alias("last_touch_conversions"),
        F.count_if(F.col("lt_convs") > 0).alias("last_touch_users"),
        F.sum("ft").alias("first_touch_revenue"),
        F.sum("lt").alias("last_touch_revenue"),
        F.sum("li").alias("linear_revenue"),
        F.sum("td").alias("time_decay_revenue"),
        F.sum("pb").alias("position_based_revenue"),
    )


def model_mart(credits: DataFrame, model: str, credit_key: str = "channel", by: Sequence[str] = ()) -> DataFrame:
    """Single-model mart (G1-G4, G7): key, attributed_conversions, attributed_users,
    attributed_revenue_usd (rounded), sorted by revenue descending.

    First/last touch count the units whose first/last touch is in the key;
    the split models count every unit with a touch in the key."""
    if model in ("first_touch", "last_touch"):
        conv, users = f"{model}_conversions", f"{model}_users"
    else:
        conv, users = "attributed_conversions", "attributed_users"
    return (
        credits.filter(F.col(conv) > 0)
        .select(
            *by,
            credit_key,
            F.col(conv).cast("long").alias("attributed_conversions"),
            F.col(users).cast("long").alias("attributed_users"),
            money(F.col(f"{model}_revenue")).alias("attributed_revenue_usd"),
        )
        .orderBy(F.desc("attributed_revenue_usd"))
    )


def credit_wide(credits: DataFrame, credit_key: str = "channel", by: Sequence[str] = ()) -> DataFrame:
    """Dashboard credit table (G9): four model revenues + distinct conversions per key."""
    return credits.select(
        *by,
        credit_key,
        *[money(F.col(f"{m}_revenue")).alias(f"{m}_revenue") for m in FOUR_MODELS],
        F.col("attributed_conversions").cast("long").alias("total_conversions"),
    )


def credit_long(credits: DataFrame, credit_key: str = "channel", by: Sequence[str] = ()) -> DataFrame:
    """Wide -> long (G10): (key, model, attributed_revenue)."""
    wide = credits.select(*by, credit_key, *[F.col(f"{m}_revenue").cast("double").alias(MODEL_LABELS[m]) for m in FOUR_MODELS])
    long = wide.unpivot([*by, credit_key], [MODEL_LABELS[m] for m in FOUR_MODELS], "model", "attributed_revenue")
    return long.select(*by, credit_key, "model", money(F.col("attributed_revenue")).alias("attributed_revenue"))


def spend_by_channel(spend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total spend and platform-claimed conversions per channel."""
    return spend.groupBy(*by, "channel").agg(
        F.sum("spend_usd").alias("total_spend_usd"),
        F.sum("platform_reported_conversions").cast("long").alias("total_platform_conversions"),
    )


def attribution_comparison(
    credits: DataFrame,
    spend: DataFrame,
    platform_aov: float = PLATFORM_AOV,
    keep: str = "spend",
    by: Sequence[str] = (),
) -> DataFrame:
    """Spend, four model revenues and ROAS per channel (G8 flagship, G11).

    ``keep='spend'`` starts from spend (channels without spend vanish, as in the
    SQL mart); ``keep='credit'`` starts from credits (organic/CRM stay, NULL ROAS).
    ROAS uses unrounded revenue; rounding happens at output only."""
    s = spend_by_channel(spend, by)
    cr = credits.select(*by, F.col("channel"), *[F.col(f"{m}_revenue") for m in FOUR_MODELS])
    keys = [*by, "channel"]
    if keep == "spend":
        j = s.join(cr, keys, "left")
    elif keep == "credit":
        j = cr.join(s, keys, "left")
    else:
        raise ValueError("keep must be 'spend' or 'credit'")
    rev = {m: F.coalesce(F.col(f"{m}_revenue").cast("double"), F.lit(0.0)) for m in FOUR_MODELS}
    spend_d = F.col("total_spend_usd").cast("double")
    out = j.select(
        *by,
        "channel",
        money(F.col("total_spend_usd")).alias("total_spend_usd"),
        F.col("total_platform_conversions"),
        *[money(rev[m]).alias(f"{m}_revenue") for m in FOUR_MODELS],
        *[F.round(safe_ratio(rev[m], spend_d), 2).alias(f"{m}_roas") for m in FOUR_MODELS],
        F.round(safe_ratio(F.col("total_platform_conversions") * F.lit(platform_aov), spend_d), 2).alias("platform_reported_roas"),
    )
    return out.orderBy(F.desc_nulls_last("time_decay_roas"))


def roas_table(comparison: DataFrame) -> DataFrame:
    """ROAS per channel and model plus platform ROAS with bands."""
    return comparison.select(
        "channel",
        "total_spend_usd",
        "platform_reported_roas",
        *[F.col(f"{m}_roas") for m in FOUR_MODELS],
        roas_band("platform_reported_roas").alias("platform_band"),
        *[roas_band(F.col(f"{m}_roas")).alias(f"{m}_band") for m in FOUR_MODELS],
    )


def model_share(
    credits: DataFrame,
    model: str = "time_decay",
    channels: Sequence[str] | None = PAID_CHANNELS,
    credit_key: str = "channel",
    by: Sequence[str] = (),
) -> DataFrame:
    """One model's revenue share among the given keys, 1 decimal.

    The total is a one-row aggregate (per ``by`` key one row) joined back."""
    c = credits
    if channels is not None:
        c = c.filter(F.col(credit_key).isin(*channels))
    rev = F.col(f"{model}_revenue").cast("double")
    c = c.select(*by, credit_key, rev.alias("revenue"), F.col("attributed_conversions").cast("long").alias("total_conversions"))
    total = c.groupBy(*by).agg(F.sum("revenue").alias("_total"))
    return _with_totals(c, total, by).select(
        *by,
        credit_key,
        money(F.col("revenue")).alias("attributed_revenue"),
        "total_conversions",
        F.round(safe_ratio(F.col("revenue") * 100.0, F.col("_total")), 1).alias("share_pct"),
    )


def _with_totals(rows: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(totals, list(by)) if by else rows.crossJoin(F.broadcast(totals))


def model_share_all(credits: DataFrame, credit_key: str = "channel", by: Sequence[str] = ()) -> DataFrame:
    """Percent share of each key under all four models."""
    revs = {m: F.col(f"{m}_revenue").cast("double") for m in FOUR_MODELS}
    c = credits.select(*by, credit_key, *[revs[m].alias(m) for m in FOUR_MODELS])
    totals = c.groupBy(*by).agg(*[F.sum(m).alias(f"_t_{m}") for m in FOUR_MODELS])
    return _with_totals(c, totals, by).select(
        *by,
        credit_key,
        *[money(F.col(m)).alias(f"{m}_revenue") for m in FOUR_MODELS],
        *[F.round(safe_ratio(F.col(m) * 100.0, F.col(f"_t_{m}")), 1).alias(f"{m}_pct") for m in FOUR_MODELS],
    )


def roas_consistency(comparison: DataFrame) -> DataFrame:
    """spend x ROAS per model, summed over channels."""
    return comparison.agg(
        *[F.round(F.sum(F.col("total_spend_usd") * F.col(f"{m}_roas")), 2).alias(f"{m}_implied_revenue") for m in FOUR_MODELS],
        *[F.round(F.sum(f"{m}_revenue"), 2).alias(f"{m}_revenue") for m in FOUR_MODELS],
    )


def assisted_conversions(pairs: DataFrame, credit_key: str = "channel", by: Sequence[str] = ()) -> DataFrame:
    """Per key: orders it closed (last touch) and orders it assisted, i.e. had a
    touch strictly before the closing touch (G16).  Same bounded-window plan as
    ``attribute``: aggregate per (order, key), then a window per order."""
    ok = _order_key(pairs)
    g = pairs.groupBy(*by, "conversion_id", credit_key).agg(F.min(ok).alias("fk"), F.max(ok).alias("lk"))
    g = g.withColumn("_LK", F.max("lk").over(Window.partitionBy(*by, "conversion_id")))
    assisted = F.col("fk") < F.col("_LK")
    closed = F.col("lk") == F.col("_LK")
    return g.groupBy(*by, credit_key).agg(
        F.count(F.lit(1)).alias("touched_conversions"),
        F.count_if(closed).alias("closed_conversions"),
        F.count_if(assisted).alias("assisted_conversions"),
        F.count_if(assisted & ~closed).alias("assist_only_conversions"),
    )


def new_to_brand(touches: DataFrame, channel: str = "channel", by: Sequence[str] = ()) -> DataFrame:
    """Per channel: users it touched and users without any earlier visit, whose
    first touch of all was in the channel (G16).

    First touches come from a hash aggregate per (user, channel) and a window per
    user over at most one row per channel."""
    ok = order_key_for(touches, "event_timestamp", "event_id")
    g = touches.filter(F.col("user_id").isNotNull()).groupBy(*by, "user_id", channel).agg(F.min(ok).alias("_k"))
    first = F.col("_k") == F.min("_k").over(Window.partitionBy(*by, "user_id"))
    return g.withColumn("_new", first).groupBy(*by, channel).agg(
        F.count(F.lit(1)).alias("touched_users"),
        F.count_if("_new").alias("new_to_brand_users"),
        F.round(safe_ratio(F.count_if("_new") * 100.0, F.count(F.lit(1))), 2).alias("new_to_brand_pct"),
    )
