"""Spark-native observability analytics: PromQL, LogQL and TraceQL compiled to DataFrames."""
