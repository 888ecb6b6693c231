"""Keyed topics: reading raw records and publishing messages.

Any Spark source with the columns `topic, partition, offset, key, value` serves. On a cluster this is
the Kafka source; files with the same columns take its place where no broker is available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD_SCHEMA = "topic string, partition int, offset bigint, key binary, value binary"


def read_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Stream of a Kafka topic from the earliest offset, values left as raw bytes."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select("topic", "partition", "offset", "key", "value")


def read_record_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of record files (Parquet) with the topic columns."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def publish_records(messages: DataFrame, topic: str | None = None) -> DataFrame:
    """Messages as `(key, value)` bytes: JSON value, region as key, so a region stays in order."""
    out = messages.select(
        F.col("region").cast("binary").alias("key"), F.to_json(F.struct(*messages.columns)).cast("binary").alias("value")
    )
    return out if topic is None else out.withColumn("topic", F.lit(topic))


def write_topic(records: DataFrame, servers: str) -> None:
    """Publish a batch to Kafka; Spark's writer is at-least-once, the event id makes repeats harmless."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option(
        "kafka.enable.idempotence", "true"
    ).save()


def stream_to_files(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
