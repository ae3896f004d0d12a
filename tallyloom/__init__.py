"""Assessment analytics on Spark: readers, rules, measures, composites, reports and retrieval over DataFrames."""
