"""Decoy-sensor telemetry analytics on Spark DataFrames."""
