"""Observability analytics on Spark: logs, spans and metric samples as DataFrames."""
