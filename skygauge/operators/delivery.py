"""What follows a send decision: channels, outcomes, state, history, metrics and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import latency_seconds, month_key, zoned_instant


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. An aggregate, not a window: copies of one key combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def channel_outbox(decisions: DataFrame, channels: Sequence[str] = fixed.CHANNELS) -> DataFrame:
    """One row per sent event and enabled channel: the work list for delivery."""
    return decisions.where("send").select(
        "event_id", "region", "offset", F.explode(F.array(*map(F.lit, channels))).alias("channel")
    )


def delivered_channels(events: DataFrame, results: DataFrame, channels: Sequence[str] = fixed.CHANNELS) -> DataFrame:
    """Add `delivered_channels` (in channel order) from `results(event_id, channel, ok)`.

    One flag per channel, so repeated results of one event never pile up in an array.
    """
    flags = results.groupBy("event_id").agg(
        *[F.max(F.col("ok") & (F.col("channel") == c)).alias(f"_ok_{c}") for c in channels]
    )
    listed = F.array_compact(F.array(*[F.when(F.col(f"_ok_{c}"), F.lit(c)) for c in channels]))
    return (
        events.join(flags, "event_id", "left")
        .withColumn("delivered_channels", listed)
        .drop(*[f"_ok_{c}" for c in channels])
    )


def state_upsert(changes: DataFrame) -> DataFrame:
    """Latest state per region from `changes(region, offset, signature, last_sent)`.

    Later non-null fields win, so a run without a delivery keeps the earlier `last_sent`.
    """

    def latest(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.col("offset")))

    return changes.groupBy("region").agg(latest("signature").alias("signature"), latest("last_sent").alias("last_sent"))


def gate_state_changes(decisions: DataFrame) -> DataFrame:
    """State fields each decided row writes: the signature if recorded, the clock if delivered."""
    return decisions.where("recorded").select(
        "region",
        "offset",
        "signature",
        F.when(F.col("send") & F.col("delivered"), F.col("clock")).alias("last_sent"),
    )


def state_lookup(regions: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """State row by region, else the newest history signature, else nothing (which means: send)."""
    when = F.struct(zoned_instant(F.col("timestamp")), "timestamp")  # by instant: offsets differ between messages
    newest_sig = history.groupBy("region").agg(F.max_by("grade_signature", when).alias("_old"))
    known = state.select("region", "signature", "last_sent", F.lit(True).alias("_known"))
    return (
        regions.select("region").distinct()
        .join(known, "region", "left")
        .join(newest_sig, "region", "left")
        .select(
            "region",
            F.when(F.col("_known"), F.col("signature")).otherwise(F.col("_old")).alias("signature"),
            "last_sent",
            F.when(F.col("_known"), F.lit("state")).when(F.col("_old").isNotNull(), F.lit("history")).otherwise(F.lit("none")).alias("source"),
        )
    )


def history_rows(graded: DataFrame) -> DataFrame:
    """Add the month partition key taken from the timestamp as written."""
    return graded.withColumn("month", month_key(F.col("timestamp")))


def upsert_history(history: DataFrame) -> DataFrame:
    """One row per (month, event_id): the one with the highest offset."""
    return newest(history, ["month", "event_id"], ["offset"])


def duplicate_events(history: DataFrame) -> DataFrame:
    return (
        history.groupBy("event_id")
        .agg(F.count("*").alias("copies"), F.max("offset").alias("last_offset"))
        .where("copies > 1")
    )


def retention(partitions: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """`partitions(month, created_at)` plus whether each is still kept. State tables are exempt."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000)
    return partitions.withColumn("keep", age < days)


def message_metrics(decided: DataFrame, processed: Column) -> DataFrame:
    """One flat metric row per message.

    `decided` carries event_id, region, timestamp, send, delivered_channels, missing, severity,
    duration_ms, indexed.
    """
    none = F.size("delivered_channels") == 0
    return decided.select(
        "event_id",
        "region",
        processed.alias("processed_at"),
        F.round("duration_ms", 1).alias("process_duration_ms"),
        latency_seconds(F.col("timestamp"), processed).alias("e2e_latency_seconds"),
        F.col("send").alias("external_attempted"),
        "delivered_channels",
        (F.col("send") & none).alias("delivery_failed"),
        (~F.col("send")).alias("suppressed"),
        F.col("missing").alias("missing_indices"),
        F.size("missing").alias("missing_count"),
        F.col("severity").alias("alert_severity"),
        F.col("indexed").alias("indexed"),
    )
