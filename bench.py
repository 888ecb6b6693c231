"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line.

`alert_chain` is the comparable number: raw records to send decisions, one message per event. Its rate
is reported as messages per second.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from skygauge.plans import catalog

HEADLINE = [
    "alert_chain",
    "send_gate",
    "send_gate_orders",
    "validate_messages",
    "grade_counts",
    "grade_range_join",
    "action_groups",
    "severity_history",
    "message_metrics",
    "history_upsert",
    "portal_items",
    "asof_backward",
    "asof_forward",
    "daily_forecast_summary",
    "station_mean",
    "advisory_match",
    "advisory_texts",
    "slot_dispatch",
    "mask_secrets",
    "mask_counts",
    "short_text",
    "perf_summary",
    "api_call_stats",
    "alarm_conditions",
    "alarm_cooldown_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skygauge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="skygauge-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    messages = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "messages_per_second": round(messages / times["alert_chain"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
