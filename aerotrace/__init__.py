"""Spark-native analytics for moving-object telemetry."""
