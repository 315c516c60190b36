"""Plan-quality analytics on Spark: count queries, cubes, estimators, plans and error metrics."""
