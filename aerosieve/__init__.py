"""Spark-native quality control and fusion of station time series."""
