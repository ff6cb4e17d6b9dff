"""Kilnworks: build and test telemetry analytics as PySpark DataFrame plans."""
