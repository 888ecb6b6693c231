"""Monitoring over message metrics, offsets and log lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import float_text, lookback_days, lookback_interval, round_1dp, zoned_instant
from skygauge.operators.gate import send_gate
from skygauge.operators.ordered import exact_quantiles, interpolated, rank_pair


def one_row(*results: DataFrame) -> DataFrame:
    """One-row results side by side: stacked and folded, so no join of any kind is needed."""
    names = [c for r in results for c in r.columns]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), results)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


# -- performance report ---------------------------------------------------------------------------

_MEASURES = {"e2e_latency_seconds": "e2e", "process_duration_ms": "proc"}
_POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def perf_summary(metrics: DataFrame, now: Column, since: str) -> DataFrame:
    """One row for the window: count, throughput, percentiles of both measures, rates."""
    days = lookback_days(since)
    window = metrics.where(F.col("processed_at") >= now - lookback_interval(since))
    base = window.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("indexed"), True)).alias("_indexed"),
        F.count(F.when(F.col("missing_count") > 0, True)).alias("_missing"),
    ).select(
        "n",
        F.expr(round_1dp(f"try_divide(n, {days}D)")).alias("throughput_per_day"),
        F.bround(F.try_divide(F.col("_indexed"), F.col("n")), 4).alias("index_success_rate"),
        F.bround(F.try_divide(F.col("_missing"), F.col("n")), 4).alias("missing_rate"),
    )
    long = window.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in _MEASURES]))
    )
    ranks = {p: rank_pair(q, F.col("n")) for p, q in _POINTS.items()}
    ordered = exact_quantiles(long, ["measure"], "value", ranks)
    points = ordered.select("measure", *[interpolated(F.col(p), F.col("n"), q).alias(p) for p, q in _POINTS.items()])
    wide = points.agg(
        *[
            F.expr(f"max(case when measure = '{m}' then {round_1dp(p)} end) as {short}_{p}")
            for m, short in _MEASURES.items()
            for p in _POINTS
        ]
    )
    return one_row(base, wide)


def partition_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """End minus committed per partition, never below zero; partitions without an end are skipped."""
    return committed.join(ends, "partition").select(
        "partition", F.greatest(F.lit(0).cast("bigint"), F.col("end") - F.col("committed")).alias("lag")
    )


def perf_compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Regressions of the current report row against the previous one (which may be absent).

    Rows carry `e2e_p95, proc_p95, index_success_rate, max_lag`. Returns the findings as ordered rows.
    """
    fields = ["e2e_p95", "proc_p95", "index_success_rate", "max_lag"]
    tagged = previous.select(*fields, F.lit("p").alias("_side")).unionByName(current.select(*fields, F.lit("c").alias("_side")))

    def side(name: str, which: str) -> Column:
        return F.max(F.when(F.col("_side") == which, F.col(name))).alias(f"{which}_{name}")

    row = tagged.agg(
        F.max(F.col("_side") == "p").alias("_has"), *[side(n, w) for n in fields for w in "pc"]
    )

    def grew(short: str, name: str) -> Column:
        p, c = F.col(f"p_{short}_p95"), F.col(f"c_{short}_p95")
        pct = (c - p) / p * 100
        text = F.concat(
            F.lit(f"⚠️ {name} p95 "), F.expr(float_text(f"p_{short}_p95")), F.lit(" → "), F.expr(float_text(f"c_{short}_p95")),
            F.lit(" (+"), F.bround(pct, 0).cast("bigint").cast("string"), F.lit("%)"),
        )
        return F.when((p > 0) & (c != 0) & (pct >= fixed.REGRESS_P95_PCT), text)

    rate, lag = F.col("c_index_success_rate"), F.col("c_max_lag")
    found = F.array_compact(
        F.array(
            *[grew(short, m) for m, short in _MEASURES.items()],
            F.when(rate < fixed.MIN_INDEX_RATE, F.concat(F.lit("⚠️ 색인 성공률 "), F.expr(float_text("c_index_success_rate")), F.lit(f" < {fixed.MIN_INDEX_RATE}"))),
            F.when(lag > fixed.MAX_REPORT_LAG, F.concat(F.lit("⚠️ Kafka max lag "), lag.cast("string"), F.lit(f" > {fixed.MAX_REPORT_LAG}"))),
        )
    )
    findings = F.when(~F.coalesce("_has", F.lit(False)), F.array(F.lit(fixed.FIRST_RUN))).when(
        F.size(found) > 0, found
    ).otherwise(F.array(F.lit(fixed.NO_REGRESSION)))
    return row.select(F.posexplode(findings).alias("position", "finding"))


def latest_report(reports: DataFrame, stamp: str) -> DataFrame:
    """The newest report row (none for an empty table)."""
    rest = [c for c in reports.columns if c != stamp]
    newest = reports.agg(F.max_by(F.struct(*rest), stamp).alias("_r"), F.max(stamp).alias(stamp))
    return newest.where(F.col(stamp).isNotNull()).select(stamp, "_r.*")


# -- log lines ------------------------------------------------------------------------------------


def api_calls(lines: DataFrame, text: str = "value") -> DataFrame:
    """Call lines of a log as `(api, status, duration_ms)`; other lines are dropped."""
    line = F.col(text)
    pattern = r"api_call api=(\S+).*?duration_ms=([\d.]+)"
    return lines.where(line.rlike(pattern)).select(
        F.regexp_extract(line, pattern, 1).alias("api"),
        F.regexp_extract(line, r"status=(\S+)", 1).alias("status"),
        F.regexp_extract(line, pattern, 2).try_cast("double").alias("duration_ms"),
    )


def api_call_stats(calls: DataFrame) -> DataFrame:
    """Per API: count, median and nearest-rank p95 of the duration."""
    n = F.col("n")
    nearest = F.least(n - 1, F.rint(F.lit(0.95) * (n - 1)))
    out = exact_quantiles(calls, ["api"], "duration_ms", {"mid": rank_pair(0.5, n), "top": (nearest, nearest)})
    return out.select(
        "api",
        "n",
        F.expr(round_1dp("(mid.lo + mid.hi) / 2")).alias("p50"),
        F.expr(round_1dp("top.lo")).alias("p95"),
    )


def api_failure_rate(calls: DataFrame) -> DataFrame:
    """Per API: calls, exceptions, failures (exception or status >= 400) and their share."""
    code = F.col("status").try_cast("int")
    exception = F.col("status") == "EXC"
    return (
        calls.groupBy("api")
        .agg(
            F.count("*").alias("calls"),
            F.count(F.when(exception, True)).alias("exceptions"),
            F.count(F.when(exception | (code >= 400), True)).alias("failures"),
        )
        .withColumn("failure_rate", F.bround(F.col("failures") / F.col("calls"), 4))
    )


# -- plain analytics ------------------------------------------------------------------------------


def basic_stats(metrics: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """count, min, max, avg, sum per column as rows; sums are exact in 1/scale units."""
    long = metrics.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), F.col(c).alias("v"), F.lit(scale).alias("scale"))
                    for c, scale in columns.items()
                ]
            )
        )
    )
    units = F.sum(F.round(F.col("v") * F.col("scale"), 0).cast("decimal(20,0)"))
    return long.groupBy("measure").agg(
        F.count("v").alias("n"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
        (units.cast("double") / F.first("scale")).alias("total"),
        (units.cast("double") / (F.count("v") * F.first("scale"))).alias("mean"),
    )


def latest_failures(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """The newest failed deliveries: a top-k report, one small heap per task."""
    return metrics.where("delivery_failed").orderBy(F.desc("processed_at"), F.desc("event_id")).limit(limit)


def suppressed_ratio(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("messages"),
        F.count(F.when(F.col("suppressed"), True)).alias("suppressed"),
        F.bround(F.count(F.when(F.col("suppressed"), True)) / F.count("*"), 4).alias("ratio"),
    )


def bad_days(grades: DataFrame) -> DataFrame:
    """Days with a bad or worse grade per month and index, from `(month, day, index_name, grade)`."""
    return (
        grades.where(F.col("grade").isin("BAD", "VERY_BAD"))
        .groupBy("month", "index_name")
        .agg(F.countDistinct("day").alias("bad_days"), F.count("*").alias("bad_messages"))
    )


def failure_histogram(metrics: DataFrame, width: str = "1 hour") -> DataFrame:
    return (
        metrics.where("delivery_failed")
        .groupBy(F.window("processed_at", width).alias("_w"))
        .agg(F.count("*").alias("failures"))
        .select(F.col("_w.start").alias("bucket"), "failures")
    )


# -- alarms ---------------------------------------------------------------------------------------


def silent_regions(expected: DataFrame, history: DataFrame, now: Column, hours: int = fixed.ALARM_NO_HISTORY_HOURS) -> DataFrame:
    """Expected regions without a history row in the last hours."""
    recent = history.where(F.col("at") >= now - F.expr(f"INTERVAL {hours} HOURS")).select("region").distinct()
    return expected.select("region").distinct().join(recent, "region", "left_anti")


def alarm_snapshot(metrics: DataFrame, history: DataFrame, lag: DataFrame, status: str | None, now: Column) -> DataFrame:
    """One row with everything the alarm conditions look at."""
    since = now - F.expr(f"INTERVAL {fixed.ALARM_LOOKBACK_MINUTES} MINUTES")
    recent = history.where(F.col("at") >= now - F.expr(f"INTERVAL {fixed.ALARM_NO_HISTORY_HOURS} HOURS")).agg(
        F.count("*").alias("alert_docs_recent")
    )
    window = metrics.where(F.col("processed_at") >= since)
    failed = window.agg(F.count(F.when(F.col("delivery_failed"), True)).alias("delivery_failed_count"))
    hits = (
        window.where("missing_count > 0")
        .orderBy(F.desc("processed_at"), F.desc("event_id"))
        .limit(fixed.ALARM_HITS)
        .select(*[c for c in ("event_id", "missing_indices", "missing_count") if c in fixed.ALARM_FIELDS], "processed_at")
    )
    # At most ALARM_HITS rows and nine names: bounded by the report itself.
    seen = hits.agg(
        F.count("*").alias("missing_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing_indices")))).alias("missing_names"),
        F.slice(
            F.transform(
                F.reverse(F.array_sort(F.collect_list(F.struct("processed_at", "event_id")))), lambda h: h["event_id"]
            ),
            1,
            fixed.ALARM_EVENT_IDS,
        ).alias("event_ids"),
    )
    top = lag.agg(F.max("lag").alias("max_lag"))
    return one_row(recent, failed, seen, top).withColumn("cluster_status", F.lit(status).cast("string"))


def alarm_conditions(snapshot: DataFrame) -> DataFrame:
    """The alarms that fire for a snapshot row: code, title, and details for missing data."""

    def alarm(code: str, fires: Column, middle: Column) -> Column:
        head, tail = fixed.ALARM_TITLES[code]
        return F.when(
            F.coalesce(fires, F.lit(False)),
            F.struct(F.lit(code).alias("code"), F.concat(F.lit(head), middle, F.lit(tail)).alias("title")),
        )

    missing = F.col("missing_hits") > 0
    fired = F.array_compact(
        F.array(
            alarm("a", F.col("alert_docs_recent") == 0, F.lit(str(fixed.ALARM_NO_HISTORY_HOURS))),
            alarm("b", F.col("delivery_failed_count") > 0, F.col("delivery_failed_count").cast("string")),
            alarm("c", missing, F.col("missing_hits").cast("string")),
            alarm("d", F.col("max_lag") > fixed.ALARM_LAG, F.col("max_lag").cast("string")),
            alarm("g", F.col("cluster_status") == "red", F.col("cluster_status")),
        )
    )
    detail = F.col("code") == "c"
    return snapshot.select(F.inline(fired), "missing_names", "event_ids").select(
        "code",
        "title",
        F.when(detail, F.array_join("missing_names", "|")).alias("missing"),
        F.when(detail, F.array_join("event_ids", "|")).alias("event_ids"),
    )


def cooldown_filter(alarms: DataFrame, state: DataFrame, now: Column, minutes: int = fixed.ALARM_COOLDOWN_MINUTES) -> DataFrame:
    """Alarms not notified within the cooldown; `state(code, last_notified TEXT)`, bad text passes."""
    last = zoned_instant(F.col("last_notified"))
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last) < minutes * 60_000_000
    return alarms.join(state, "code", "left").where(~F.coalesce(quiet, F.lit(False))).drop("last_notified")


def cooldown_series(ticks: DataFrame, minutes: int = fixed.ALARM_COOLDOWN_MINUTES, **gate_options) -> DataFrame:
    """Cooldown over a whole series of firing ticks `(code, tick, at)`.

    The same state machine as the send gate: one key per code and a signature that never changes, so
    the first firing is sent and later ones once the cooldown has passed.
    """
    rows = ticks.select(
        F.col("code").alias("region"),
        F.col("tick").alias("offset"),
        F.col("at").alias("clock"),
        F.lit("on").alias("signature"),
        F.lit(False).alias("core_missing"),
        F.lit(True).alias("delivered"),
        F.lit(True).alias("enabled"),
    )
    decided = send_gate(rows, minutes * 60, **gate_options)
    return decided.select(
        F.col("region").alias("code"), F.col("offset").alias("tick"), F.col("clock").alias("at"), F.col("send").alias("notify")
    )
