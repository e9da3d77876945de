from creditline.plans.registry import all_oracle_sql, all_queries  # noqa: F401
