"""Early-warning analytics on Spark: activity cubes, features, scores, forecasts and evaluation."""
