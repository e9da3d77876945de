"""Column-expression helpers.

Every helper returns a ``pyspark.sql.Column`` built from built-in functions,
so it stays inside whole-stage codegen; none of them needs a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values, which must be as they are for identical results.
# Canonical channel -> accepted aliases (compared after LOWER(TRIM(x))).
CHANNEL_ALIASES: dict[str, tuple[str, ...]] = {
    "Meta_Paid_Social": ("meta_paid_social", "meta", "facebook"),
    "Google_Paid_Search": ("google_paid_search", "google_search", "google paid search"),
    "TikTok_Ads": ("tiktok_ads", "tiktok", "tik tok"),
    "Google_Organic": ("google_organic", "organic search", "organic"),
    "Email_CRM": ("email_crm", "email", "crm"),
}
# The shorter alias map of the cleaning guide; other channels become INITCAP.
GUIDE_ALIASES: dict[str, tuple[str, ...]] = {
    "Meta_Paid_Social": ("meta_paid_social", "meta", "facebook"),
    "Google_Search": ("google_search", "google", "google paid search"),
    "TikTok_Ads": ("tiktok_ads", "tiktok", "tik tok"),
}
# Aliases of the spend feed.
SPEND_ALIASES: dict[str, tuple[str, ...]] = {
    "Meta_Paid_Social": ("meta_paid_social",),
    "Google_Paid_Search": ("google_paid_search",),
    "TikTok_Ads": ("tiktok_ads",),
}
# Canonical paid channels (the ones with ad spend).
PAID_CHANNELS: tuple[str, ...] = ("Meta_Paid_Social", "Google_Paid_Search", "TikTok_Ads")
# Dashboard display names: exact raw value (after lower/strip) -> label; others dropped.
DISPLAY_NAMES: dict[str, str] = {
    "meta_paid_social": "Meta Paid Social",
    "google_paid_search": "Google Paid Search",
    "tiktok_ads": "TikTok Ads",
    "email_crm": "Email / CRM",
    "google_organic": "Google Organic",
}
# Average order value assumed when turning platform-claimed conversions into revenue.
PLATFORM_AOV = 160.0
# Half-life of the time-decay model, in days.
HALF_LIFE_DAYS = 7.0
# Attribution lookback window, in days.
LOOKBACK_DAYS = 90
# ROAS band thresholds: >= 2.5 high, >= 1.5 medium, else low.
ROAS_BAND_HIGH = 2.5
ROAS_BAND_MID = 1.5
# ---------------------------------------------------------------------------

MICROS_PER_DAY = 86_400_000_000.0


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_initcap(c: Column | str) -> Column:
    """INITCAP with PostgreSQL word rules: a word starts after any
    non-alphanumeric character (Spark's ``initcap`` only splits on blanks)."""
    parts = F.split(F.lower(col_of(c)), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))),
        "",
    )


def normalise_text(c: Column | str) -> Column:
    """LOWER(TRIM(x)); NULL stays NULL. TRIM removes blanks only, as in SQL."""
    return F.lower(F.trim(col_of(c)))


def canonical_channel(
    c: Column | str,
    aliases: Mapping[str, Sequence[str]] = CHANNEL_ALIASES,
    on_unknown: str = "initcap",
) -> Column:
    """Map raw channel spellings to canonical names.

    ``on_unknown='initcap'`` keeps unknown values as INITCAP(TRIM(x)) (SQL path);
    ``'null'`` returns NULL so the caller can drop them (dashboard path).
    """
    key = normalise_text(c)
    expr = None
    for canon, names in aliases.items():
        cond = key.isin(*names)
        expr = F.when(cond, F.lit(canon)) if expr is None else expr.when(cond, F.lit(canon))
    if on_unknown == "initcap":
        other = pg_initcap(F.trim(col_of(c)))
    elif on_unknown in ("null", "drop"):
        other = F.lit(None).cast("string")
    else:
        raise ValueError(f"on_unknown must be 'initcap' or 'drop', got {on_unknown!r}")
    return expr.otherwise(other) if expr is not None else other


def mapped_value(c: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Literal dictionary lookup as a CASE chain (constant-folded, no join)."""
    expr = None
    for k, v in mapping.items():
        cond = col_of(c) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    fallback = default if default is not None else F.lit(None).cast("string")
    return expr.otherwise(fallback) if expr is not None else fallback


def wall_micros(ts: Column | str) -> Column:
    """Microseconds of a wall-clock timestamp since 1970-01-01 00:00 on the same
    wall clock.  No time zone is involved, so hours that a zone skips or repeats
    keep their order and distance."""
    t = col_of(ts).cast("timestamp_ntz")
    second = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return second * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def trunc_second(ts: Column | str) -> Column:
    """Wall-clock timestamp without its fraction of a second."""
    t = col_of(ts).cast("timestamp_ntz")
    return t - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), t) % 1)


def days_between(start: Column | str, end: Column | str) -> Column:
    """(end - start) in fractional days of the wall clock, microsecond exact."""
    return (wall_micros(end) - wall_micros(start)).cast("double") / F.lit(MICROS_PER_DAY)


def decay_weight(days: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """2^(-days / half_life)."""
    return F.pow(F.lit(2.0), -days / F.lit(float(half_life_days)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (ANSI-safe NULLIF form)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def money(c: Column) -> Column:
    """Round to cents and hand out as DOUBLE."""
    return F.round(c, 2).cast("double")


def roas_band(c: Column | str, hi: float = ROAS_BAND_HIGH, mid: float = ROAS_BAND_MID) -> Column:
    """'high' / 'medium' / 'low' band of a ROAS value; '' when it is not a number."""
    x = col_of(c).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(""))
        .when(x >= hi, F.lit("high"))
        .when(x >= mid, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


# West (2005), "Better approximations to cumulative normal functions":
# Hart's double-precision rational approximation (public published constants).
_HART_P = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_Q = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(x: Column, coeffs: Sequence[float]) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_tail(x: Column | str) -> Column:
    """Upper tail 1 - Phi(|x|) of the standard normal, without erf."""
    a = F.abs(col_of(x).cast("double"))
    e = F.exp(-a * a / F.lit(2.0))
    near = e * _horner(a, _HART_P) / _horner(a, _HART_Q)
    cf = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = a + F.lit(k) / cf
    far = e / cf / F.lit(2.506628274631)
    return F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)


def norm_cdf(x: Column | str) -> Column:
    """Standard normal CDF Phi(x) as a Column expression."""
    xc = col_of(x).cast("double")
    t = norm_tail(xc)
    return F.when(xc > 0, F.lit(1.0) - t).otherwise(t)


def norm_ppf_approx(p: float) -> float:
    """Inverse normal CDF for driver-side constants (alpha, power); Acklam's rational form."""
    import math

    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
    lo, hi = 0.02425, 1 - 0.02425
    if p < lo:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p <= hi:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    # one Newton step on the exact CDF sharpens the rational start to ~1e-15
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def order_key(ts: Column | str, event_id: Column | str) -> Column:
    """Total order (ts, event_id) packed into one DECIMAL(38,0).

    ``min``/``max`` over a struct force a sort-based aggregate; a decimal key
    keeps first/last-touch selection in a hash aggregate with map-side combine.
    key = wall_micros(ts) * 1e20 + (event_id + 2^63); |wall_micros| < 2.6e17.
    """
    micros = wall_micros(ts).cast("decimal(38,0)")
    eid = col_of(event_id).cast("decimal(20,0)") + F.lit(Decimal(2**63)).cast("decimal(20,0)")
    return (micros * F.lit(Decimal(10**20)).cast("decimal(38,0)") + eid).cast("decimal(38,0)")


def order_key_for(df, ts: str = "touchpoint_ts", event_id: str = "event_id") -> Column:
    """Order key for ``df``: the packed DECIMAL for integral ids (hash aggregate);
    a (ts, event_id) struct for string ids such as UUIDs (same order, sort aggregate)."""
    from pyspark.sql.types import IntegralType

    if isinstance(df.schema[event_id].dataType, IntegralType):
        return order_key(ts, event_id)
    return F.struct(col_of(ts).alias("ts"), col_of(event_id).alias("id"))
