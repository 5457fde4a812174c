"""Time-series analytics on Spark: a small query language compiled to DataFrame plans, plus storage and streaming."""
