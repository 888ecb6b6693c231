"""Topic records to alerts, as one streaming query over micro-batches.

validate -> grade -> gate -> history, outbox, metrics, state, dead letters. Validation and grading are
narrow; the gate shuffles only its own narrow columns. Every output is keyed by the run (one checkpoint folder) and
the batch number, and the gate starts from the snapshot of the batch before, so a batch that runs again after a
failure writes the same rows to the same places, and a new checkpoint leaves all earlier rows.

Offsets are unique within a partition only. The gate therefore orders the rows of a batch by `seq`, a number made of
offset, topic and partition.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skygauge import fixed
from skygauge.functions.grading import (
    action_groups,
    core_missing,
    missing_names,
    severity,
    signature,
    with_grades,
)
from skygauge.functions.scalars import zoned_instant
from skygauge.operators import delivery, gate, validate
from skygauge.sources import tables


def event_clock() -> Column:
    """Clock of the gate: the message time, so that a replay decides the same."""
    return F.coalesce(zoned_instant(F.col("timestamp")), F.current_timestamp())


def with_seq(messages: DataFrame, records: DataFrame) -> DataFrame:
    """Add `seq`: by offset, then topic and partition, and unique over all of them.

    The partitions of the topics are numbered by one window over one row each.
    """
    found = records.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("_n"))
    numbered = found.select(
        F.col("topic").alias("_topic"),
        F.col("partition").alias("_partition"),
        (F.row_number().over(W.orderBy("topic", "partition")) - 1).alias("_place"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("_places"),
    )
    same = F.col("topic").eqNullSafe(F.col("_topic")) & F.col("partition").eqNullSafe(F.col("_partition"))
    return (
        messages.join(numbered, same)
        .withColumn("seq", F.col("offset") * F.col("_places") + F.col("_place"))
        .drop("_topic", "_partition", "_place", "_places")
    )


@dataclass
class AlertStream:
    """Settings and output folders of the alert stream.

    `outcomes(messages)` may give `(event_id, channel, ok)` for attempts whose result is known; an
    event without one counts as failed and is tried again. Without it, writing the outbox row is the
    delivery.
    """

    out_dir: str
    silence_seconds: float | None = fixed.MAX_SILENCE_SECONDS
    channels: tuple[str, ...] = fixed.CHANNELS
    clock: Callable[[], Column] = event_clock
    outcomes: Callable[[DataFrame], DataFrame] | None = None
    gate_options: dict = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.out_dir}/{name}"

    def process(self, batch: DataFrame, number: int, run: str | None = None) -> None:
        """One micro-batch; also usable directly on a bounded table of records, then with a `run` of its own.

        The run of a streaming query is its id, which belongs to the checkpoint folder and outlives restarts.
        """
        begun = time.monotonic()
        spark = batch.sparkSession
        run = run or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or tables.DIRECT
        now = tables.batch_time(spark, self.path("batches"), number, run)
        checked = validate.validate(batch.select("topic", "partition", "offset", "key", "value"))
        checked.persist(StorageLevel.MEMORY_AND_DISK)
        decided = None
        try:
            dead = validate.dead_letters(checked, now)
            tables.write_batch(dead, self.path("dead_letters"), number, run)
            graded = with_seq(self._graded(validate.valid_messages(checked)), checked)
            state = tables.read_state(spark, self.path("state"), number, run, self.path("history"))
            decided = self._decide(graded, state).persist(StorageLevel.MEMORY_AND_DISK)
            self._write(decided, graded, state, number, run, now, begun)
        finally:
            checked.unpersist()
            if decided is not None:
                decided.unpersist()

    def _graded(self, messages: DataFrame) -> DataFrame:
        return (
            with_grades(messages)
            .selectExpr(
                "*",
                f"{signature()} as signature",
                f"{core_missing()} as core_missing",
                f"{action_groups()}.code as action_groups",
                f"{severity()} as severity",
                f"{missing_names()} as missing",
            )
            .withColumn("clock", self.clock())
        )

    def _decide(self, graded: DataFrame, state: DataFrame) -> DataFrame:
        rows = graded.select(
            "region", F.col("seq").alias("offset"), F.col("offset").alias("at_offset"), "event_id", "clock", "signature", "core_missing"
        )
        rows = rows.withColumn("enabled", F.lit(bool(self.channels)))
        if self.outcomes is None:
            known = F.array(*map(F.lit, self.channels)) if self.channels else F.array().cast("array<string>")
            rows = rows.withColumn("reached", known)
        else:
            rows = delivery.delivered_channels(rows, self.outcomes(graded), self.channels)
            rows = rows.withColumn("reached", F.coalesce("delivered_channels", F.array().cast("array<string>"))).drop("delivered_channels")
        rows = rows.withColumn("delivered", F.size("reached") > 0)
        return gate.send_gate(rows, self.silence_seconds, state, **self.gate_options)

    def _write(
        self, decided: DataFrame, graded: DataFrame, state: DataFrame, number: int, run: str, now: Column, begun: float
    ) -> None:
        none = F.array().cast("array<string>")
        narrow = decided.select(
            "region", F.col("offset").alias("seq"), "send", "recorded", F.when(F.col("send"), F.col("reached")).otherwise(none).alias("delivered_channels")
        )
        full = graded.join(narrow, ["region", "seq"])
        history = full.select(
            "event_id", "region", "timestamp", "offset", *fixed.INDICES, *[f"{i}_grade" for i in fixed.INDICES],
            "action_groups", "severity",
            F.when(F.col("recorded"), F.col("signature")).otherwise(F.lit("")).alias("grade_signature"),
            "delivered_channels", "recorded",
        )
        tables.write_history(history, self.path("history"), number, run, now)
        sent = decided.withColumn("offset", F.col("at_offset"))
        outbox = delivery.channel_outbox(sent, self.channels) if self.channels else None
        if outbox is not None:
            tables.write_batch(outbox, self.path("outbox"), number, run)
        # The time of the batch so far, shared by its messages. A history write that fails ends the batch before this.
        each = (time.monotonic() - begun) * 1000 / max(1, decided.count())
        measured = full.withColumns({"duration_ms": F.lit(each), "indexed": F.lit(True)})
        metrics = delivery.message_metrics(measured, now)
        tables.write_metrics(metrics, self.path("metrics"), number, run)
        earlier = state.select("region", F.lit(-1).cast("bigint").alias("offset"), "signature", "last_sent")
        changes = delivery.gate_state_changes(decided).withColumn("last_sent", F.col("last_sent").cast("timestamp"))
        tables.write_state(delivery.state_upsert(earlier.unionByName(changes)), self.path("state"), number, run, now)

    def start(self, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run as a streaming query; `trigger` goes to `.trigger(..)`, all available data by default."""
        writer = records.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def first_copy_only(messages: DataFrame, time: str, delay: str) -> DataFrame:
    """Drop later copies of an event id on a stream, with state bounded by the watermark delay."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])
