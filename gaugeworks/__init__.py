"""Telemetry health analytics for fleets of devices, written for Spark DataFrames."""
