"""Data-quality checks (J1-J10).  Each ``check_*`` returns the violating rows;
an empty result means the check passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.functions.columns import days_between


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of ``cols``."""
    cond = None
    for c in cols:
        cond = F.col(c).isNull() if cond is None else cond | F.col(c).isNull()
    return df.filter(cond)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column in one pass."""
    cols = list(cols or df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def check_accepted(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Rows whose ``col`` is outside the accepted set (J3); NULL counts as outside."""
    return df.filter(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def check_causal(pairs: DataFrame, keys: Sequence[str] = ("user_id", "event_id")) -> DataFrame:
    """Pairs whose touch comes after the order, with the lateness in seconds."""
    return pairs.filter(F.col("touchpoint_ts") > F.col("conversion_ts")).select(
        *keys,
        "touchpoint_ts",
        "conversion_ts",
        (days_between("conversion_ts", "touchpoint_ts") * 86400.0).alias("seconds_after_conversion"),
    )


def dedup_removed_pct(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before/after dedup and the share removed (J5): two one-row counts joined."""
    b = before.agg(F.count(F.lit(1)).alias("total_before"))
    a = after.agg(F.count(F.lit(1)).alias("total_after"))
    return b.crossJoin(a).select(
        "total_before",
        "total_after",
        F.round((F.lit(1.0) - F.col("total_after") / F.col("total_before")) * 100.0, 2).alias("pct_removed"),
    )


def touches_per_user(df: DataFrame) -> DataFrame:
    """Average and maximum touches per user (J6, E8): two-level aggregate."""
    per = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("n"), 2).alias("avg_touchpoints_per_user"), F.max("n").alias("max_touchpoints"))


def value_counts(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    """COUNT per value."""
    return df.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("rows"))
