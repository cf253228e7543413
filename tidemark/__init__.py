"""Gauge time series on Spark: every operator is a lazy DataFrame transformation."""
