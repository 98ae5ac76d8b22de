"""Telemetry analytics on Spark: metrics, logs, traces and profiles as DataFrames."""
