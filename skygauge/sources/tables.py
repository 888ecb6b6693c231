"""Output tables: keyed history, metrics, dead letters, state snapshots and reports.

Every writer is keyed by run and micro-batch. A run is one checkpoint folder: batch numbers start again at 0 with a
new one, so the run keeps the output of an earlier checkpoint apart. A batch that runs again after a lost executor or
a restart overwrites exactly its own partition, so nothing is doubled and nothing written earlier is touched.
"Upsert" happens on read: the newest row per key wins, found by a combining aggregate. Old versions are
folded by `compact_history`, which writes a new folder and never edits one in use.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import month_key
from skygauge.operators.delivery import newest, state_lookup

#: Run of batches that are processed without a streaming query.
DIRECT = "direct"
_KEYS = "run string, batch bigint"


def _write_parts(df: DataFrame, path: str, run: str, batch: int, *parts: str) -> None:
    keyed = df.withColumns({"run": F.lit(run), "batch": F.lit(batch)})
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts, "run", "batch").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty as long as nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def batch_time(spark: SparkSession, path: str, batch: int, run: str = DIRECT) -> Column:
    """Processing time of a batch, the same again when the batch is replayed: the first run of the batch stores it."""
    at = f"{path}/run={run}/batch={batch}"
    if _read(spark, at, "processed_at timestamp").isEmpty():
        spark.range(1).select(F.current_timestamp().alias("processed_at")).write.mode("overwrite").parquet(at)
    micros = _read(spark, at, "processed_at timestamp").agg(F.unix_micros(F.min("processed_at"))).first()[0]
    return F.timestamp_micros(F.lit(micros))


def write_history(rows: DataFrame, path: str, batch: int, run: str = DIRECT, written: Column | None = None) -> None:
    """History rows of one batch, by the month of their timestamp as written."""
    at = F.current_timestamp() if written is None else written
    dated = rows.withColumns({"month": month_key(F.col("timestamp")), "written_at": at})
    _write_parts(dated, path, run, batch, "month")


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Current history: one row per (month, event_id), the latest write."""
    rows = spark.read.schema(f"{schema}, written_at timestamp, month string, {_KEYS}").parquet(path)
    return newest(rows, ["month", "event_id"], ["written_at", "batch", "offset"]).drop("written_at", "run", "batch")


def compact_history(spark: SparkSession, path: str, target: str, schema: str) -> None:
    """Write the current history to a fresh folder, one version per key."""
    current = read_history(spark, path, schema).withColumn("written_at", F.lit(0).cast("timestamp"))
    _write_parts(current.repartition("month", F.pmod(F.xxhash64("event_id"), F.lit(64))), target, "compacted", 0, "month")


def write_metrics(rows: DataFrame, path: str, batch: int, run: str = DIRECT) -> None:
    """Metric rows of one batch; append-only, replays overwrite their own batch."""
    _write_parts(rows.withColumn("month", F.date_format("processed_at", "yyyy.MM")), path, run, batch, "month")


def write_batch(rows: DataFrame, path: str, batch: int, run: str = DIRECT) -> None:
    """Append-only rows of one batch (dead letters, outbox); replays overwrite their own batch."""
    _write_parts(rows, path, run, batch)


STATE_SCHEMA = "region string, signature string, last_sent timestamp"


def write_state(rows: DataFrame, path: str, batch: int, run: str = DIRECT, written: Column | None = None) -> None:
    """Snapshot after a batch, in one of two alternating slots: the one before stays for a replay."""
    at = F.current_timestamp() if written is None else written
    rows.withColumn("written_at", at).write.mode("overwrite").parquet(f"{path}/run={run}/slot={batch % 2}")


def read_state(spark: SparkSession, path: str, batch: int, run: str = DIRECT, history: str | None = None) -> DataFrame:
    """Snapshot that a batch starts from.

    The first batch of a run starts from the newest snapshot of the other runs and, for regions that it lacks, from
    the newest recorded signature of their history. Without either it is empty.
    """
    if batch > 0:
        return _read(spark, f"{path}/run={run}/slot={(batch - 1) % 2}", STATE_SCHEMA)
    others = _read(spark, path, f"{STATE_SCHEMA}, written_at timestamp, run string, slot int").where(F.col("run") != run)
    last = others.agg(F.max("written_at").alias("_last"))
    state = others.join(last, F.col("written_at") == F.col("_last")).select("region", "signature", "last_sent")
    if history is None:
        return state
    kept = _read(spark, history, f"region string, timestamp string, grade_signature string, {_KEYS}")
    kept = kept.where((F.col("run") != run) & (F.col("grade_signature") != ""))
    regions = state.select("region").unionAll(kept.select("region"))
    return state_lookup(regions, state, kept).select("region", "signature", "last_sent")


def write_report(report: DataFrame, path: str, stamp: str) -> None:
    """One report row as JSON under its stamp."""
    report.withColumn("stamp", F.lit(stamp)).write.mode("overwrite").json(f"{path}/run={stamp}")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, stamp string").json(f"{path}/run=*")


def allowlisted(df: DataFrame, fields: tuple[str, ...] = fixed.ALARM_FIELDS) -> DataFrame:
    """Only the fields that may leave for a notification."""
    return df.select(*[f for f in fields if f in df.columns])
