"""Collected portal replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = "source string, region string, fetched_at timestamp, status_code int, payload string"


def read_payload_table(spark: SparkSession, path: str) -> DataFrame:
    """Replies kept as a Parquet table."""
    return spark.read.schema(PAYLOAD_SCHEMA).parquet(path)


def read_payload_files(spark: SparkSession, path: str, status_code: int = 200) -> DataFrame:
    """Replies kept as one text file each; source and region come from `source=../region=..` folders."""
    whole = spark.read.schema("value string, source string, region string").text(path, wholetext=True)
    return whole.select(
        "source",
        "region",
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.lit(status_code).alias("status_code"),
        F.col("value").alias("payload"),
    )
