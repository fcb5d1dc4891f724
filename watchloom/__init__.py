"""Behaviour analytics on Spark: DataFrame functions, SQL and Structured Streaming."""
