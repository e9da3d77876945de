"""Lazily composed layers over one dataset directory.

Each property is a DataFrame *plan*; nothing is cached or collected here, so a
query built from several layers is one Catalyst plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from creditline.functions.columns import LOOKBACK_DAYS
from creditline.operators.attribution import attribute, attribute_swept
from creditline.operators.journeys import DEFAULT_BUCKET_DAYS, dedup_touchpoints, eligible_pairs
from creditline.operators.staging import stage_conversions, stage_spend, stage_touchpoints
from creditline.sources.adapter import MarketingInputs, marketing_inputs


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str, bucket_days: int = DEFAULT_BUCKET_DAYS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.bucket_days = bucket_days

    @cached_property
    def inputs(self) -> MarketingInputs:
        return marketing_inputs(self.spark, self.sf_dir)

    @cached_property
    def touches(self) -> DataFrame:
        return stage_touchpoints(self.inputs.raw_touchpoints)

    @cached_property
    def conversions(self) -> DataFrame:
        return stage_conversions(self.inputs.raw_conversions)

    @cached_property
    def spend(self) -> DataFrame:
        return stage_spend(self.inputs.raw_ad_spend)

    @cached_property
    def deduped(self) -> DataFrame:
        return dedup_touchpoints(self.touches)

    def pairs(self, lookback_days: int | None = LOOKBACK_DAYS) -> DataFrame:
        return eligible_pairs(self.deduped, self.conversions, lookback_days, self.bucket_days)

    def credits(self, lookback_days: int | None = LOOKBACK_DAYS, **kw) -> DataFrame:
        return attribute(self.pairs(lookback_days), max_age_days=lookback_days, **kw)

    def swept(self, lookback_days: int | None = LOOKBACK_DAYS, **kw) -> DataFrame:
        """The same credits by prefix sums, without touch-order pairs."""
        return attribute_swept(self.deduped, self.conversions, lookback_days, **kw)
