from creditline.functions.columns import (  # noqa: F401
    CHANNEL_ALIASES,
    DISPLAY_NAMES,
    HALF_LIFE_DAYS,
    LOOKBACK_DAYS,
    PAID_CHANNELS,
    PLATFORM_AOV,
    canonical_channel,
    days_between,
    decay_weight,
    mapped_value,
    money,
    norm_cdf,
    norm_tail,
    normalise_text,
    order_key,
    pg_initcap,
    roas_band,
    safe_ratio,
)
