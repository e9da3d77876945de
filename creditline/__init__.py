"""creditline: Spark-native marketing measurement.

Touchpoint cleaning and deduplication, causal lookback joins to orders,
multi-touch attribution, spend/ROAS comparison, geo-holdout incrementality,
budget scenarios and data-quality checks, all as DataFrame plans.
"""

__version__ = "0.1.0"
