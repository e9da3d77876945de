"""Row-level error routing (L4): raw text columns become typed ones, rows that
break a rule go to a reject table with the reason, and the job goes on.

Every rule is one expression of the same scan; ``write_quarantined`` writes both kinds
of rows in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditline.sources.raw import write_layer

REASON = "reject_reason"


@dataclass(frozen=True)
class Rule:
    """Type of a column, whether it must be there, and bounds or values it must keep."""

    type: str
    required: bool = True
    minimum: float | None = None
    values: tuple[str, ...] = ()

    def cast(self, c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        return F.when(text != "", text).try_cast(self.type)

    def broken(self, c: str) -> Column:
        """The reason, or null."""
        text, value = F.trim(F.col(c).cast("string")), self.cast(c)
        missing = text.isNull() | (text == "")
        out = F.when(missing, F.lit(f"{c}: missing") if self.required else F.lit(None))
        out = out.when(value.isNull(), F.lit(f"{c}: not a {self.type}"))
        if self.minimum is not None:
            out = out.when(value < F.lit(self.minimum).cast(self.type), F.lit(f"{c}: below {self.minimum:g}"))
        if self.values:
            out = out.when(~F.lower(text).isin([v.lower() for v in self.values]), F.lit(f"{c}: not accepted"))
        return out


def checked(raw: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """``raw`` with ``reject_reason``: the reasons of all broken rules in the rules' order, joined by '; ', or null.  A column
    that ``raw`` lacks is missing in every row."""
    for c in rules:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    reasons = F.concat_ws("; ", *[r.broken(c) for c, r in rules.items()])
    return raw.withColumn(REASON, F.when(reasons != "", reasons))


def accepted(rows: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """The good rows of ``checked``, typed; other columns as they are."""
    return rows.where(F.col(REASON).isNull()).select(
        *[(rules[c].cast(c) if c in rules else F.col(c)).alias(c) for c in rows.columns if c != REASON])


def rejected(rows: DataFrame) -> DataFrame:
    """The bad rows of ``checked``, as they came, with the reason."""
    return rows.where(F.col(REASON).isNotNull())


def rejects_report(rows: DataFrame) -> DataFrame:
    """Rows by reason (a row with several counts under each), and the accepted ones as 'ok'."""
    each = F.explode(F.split(F.coalesce(REASON, F.lit("ok")), "; "))
    return rows.select(each.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def write_quarantined(rows: DataFrame, path: str) -> None:
    """Both kinds of rows in one pass, as ``rejected=false`` and ``rejected=true`` below ``path``."""
    write_layer(rows.withColumn("rejected", F.col(REASON).isNotNull()), path, ("rejected",))
