"""Log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line in column `value`; large files split across tasks."""
    return spark.read.text(path)
