"""What a session needs beyond its own settings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def visible(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
