"""Transaction-risk analytics on Spark: features, rules, models, decisions, monitoring."""
