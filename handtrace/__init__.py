"""Input-device telemetry analytics on Spark DataFrames."""
