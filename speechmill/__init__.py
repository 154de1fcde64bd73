"""Speech analytics on Spark: DataFrame to DataFrame."""
