"""Queries on metrics, offsets, log lines and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from skygauge.functions.scalars import latency_seconds, lookback_interval, zoned_instant
from skygauge.operators import monitor
from skygauge.plans import sql, views
from skygauge.plans.registry import query, table
from skygauge.sources.tables import allowlisted

NOW = "2024-01-30 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# -- latency --------------------------------------------------------------------------------------


@query(
    "e2e_latency",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 5 END AS kind,
      ts, date_trunc('second', ts) - to_seconds(event_id % 30) AS sent FROM events)
    SELECT event_id, CASE WHEN kind IS NOT NULL THEN round_even((epoch_us(ts) - epoch_us(sent)) / 1000.0, 0) / 1000 END AS seconds FROM t""",
)
def e2e_latency(spark, sf_dir):
    """Published times with `Z`, `+09:00` and `+0900` offsets; null, zone-less and garbage give null."""
    sent = F.date_trunc("second", "ts").cast("timestamp_ntz") - F.make_dt_interval(secs=(F.col("event_id") % 30).cast("decimal(18,6)"))
    iso, kst = (F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss") for t in (sent, sent + F.expr("INTERVAL 9 HOURS")))
    case = F.col("event_id") % 6
    published = (
        F.when(case == 0, F.lit(None).cast("string"))
        .when(case == 1, F.concat(iso, F.lit("Z")))
        .when(case == 2, F.concat(kst, F.lit("+09:00")))
        .when(case == 3, iso)
        .when(case == 4, F.lit("not a time"))
        .otherwise(F.concat(kst, F.lit("+0900")))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", latency_seconds(published, F.col("ts").cast("timestamp")).alias("seconds")
    )


def _summary_sql(where: str, days: float) -> str:
    cols = ", ".join(
        f"quantile_cont({m}, {q}) AS {s}_{p}0"
        for m, s in (("e2e_latency_seconds", "e2e"), ("process_duration_ms", "proc"))
        for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    )
    out = ", ".join(f"{sql.rounded(f'{s}_{p}0')} AS {s}_{p}" for s in ("e2e", "proc") for p in ("p50", "p95", "p99"))
    return f"""SELECT n, {sql.rounded(f'n / {days}::DOUBLE')} AS throughput_per_day, index_success_rate, missing_rate, {out}
    FROM (SELECT count(*) AS n, round_even(count(*) FILTER (indexed) / nullif(count(*), 0), 4) AS index_success_rate,
      round_even(count(*) FILTER (missing_count > 0) / nullif(count(*), 0), 4) AS missing_rate, {cols} FROM em WHERE {where})"""


@query("perf_summary", f"WITH {sql.EVENT_METRICS} {_summary_sql(f'''processed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY''', 7)}")
def perf_summary(spark, sf_dir):
    return monitor.perf_summary(views.event_metrics(spark, sf_dir), _now(), "7d")


def _offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 12).cast("int").alias("partition"), F.col("event_id").alias("o"))
    ends = rows.where("partition < 10").groupBy("partition").agg((F.max("o") + 1 - F.when(F.col("partition") == 3, 5000).otherwise(0)).alias("end"))
    committed = rows.where("o % 5 <> 0").groupBy("partition").agg((F.max("o") + 1).alias("committed"))
    return committed, ends


_LAG = """l AS (SELECT CAST(user_id % 12 AS INTEGER) AS p, event_id AS o FROM events),
  lag AS (SELECT e.p AS "partition", greatest(0, e.e - c.c) AS lag FROM
    (SELECT p, max(o) + 1 - CASE WHEN p = 3 THEN 5000 ELSE 0 END AS e FROM l WHERE p < 10 GROUP BY p) e
    JOIN (SELECT p, max(o) + 1 AS c FROM l WHERE o % 5 <> 0 GROUP BY p) c USING (p))"""


@query("partition_lag", f"WITH {_LAG} SELECT * FROM lag")
def partition_lag(spark, sf_dir):
    return monitor.partition_lag(*_offsets(spark, sf_dir))


_SPLIT = "2024-01-15 00:00:00"


@query(
    "perf_compare",
    f"""WITH {sql.EVENT_METRICS}, {_LAG},
    p AS ({_summary_sql(f"processed_at < TIMESTAMP '{_SPLIT}' AND processed_at >= TIMESTAMP '{_SPLIT}' - INTERVAL 14 DAY", 14)}),
    em2 AS (SELECT * REPLACE (process_duration_ms * 2 AS process_duration_ms) FROM em),
    c AS ({_summary_sql(f"processed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY", 7).replace('FROM em WHERE', 'FROM em2 WHERE')}),
    r AS (SELECT p.e2e_p95 AS pe, c.e2e_p95 AS ce, p.proc_p95 AS pp, c.proc_p95 AS cp, c.index_success_rate AS rate,
      (SELECT max(lag) FROM lag) AS lag FROM p, c),
    f AS (SELECT list_filter([
      CASE WHEN pe > 0 AND (ce - pe) / pe * 100 >= 50 THEN '⚠️ e2e_latency_seconds p95 ' || pe || ' → ' || ce || ' (+' || CAST(round_even((ce - pe) / pe * 100, 0) AS BIGINT) || '%)' END,
      CASE WHEN pp > 0 AND (cp - pp) / pp * 100 >= 50 THEN '⚠️ process_duration_ms p95 ' || pp || ' → ' || cp || ' (+' || CAST(round_even((cp - pp) / pp * 100, 0) AS BIGINT) || '%)' END,
      CASE WHEN rate < 0.98 THEN '⚠️ 색인 성공률 ' || rate || ' < 0.98' END,
      CASE WHEN lag > 10 THEN '⚠️ Kafka max lag ' || lag || ' > 10' END], lambda x: x IS NOT NULL) AS found FROM r),
    g AS (SELECT CASE WHEN len(found) = 0 THEN ['회귀 없음'] ELSE found END AS found FROM f)
    SELECT CAST(i AS INTEGER) AS position, found[i + 1] AS finding FROM g, range(0, 8) t(i) WHERE i < len(found)""",
)
def perf_compare(spark, sf_dir):
    metrics = views.event_metrics(spark, sf_dir)
    split = F.lit(_SPLIT).cast("timestamp_ntz")
    before = monitor.perf_summary(metrics.where(F.col("processed_at") < split), split, "14d")
    after = monitor.perf_summary(
        metrics.withColumn("process_duration_ms", F.col("process_duration_ms") * 2), _now(), "7d"
    )
    top = monitor.partition_lag(*_offsets(spark, sf_dir)).agg(F.max("lag").alias("max_lag"))
    fields = ["e2e_p95", "proc_p95", "index_success_rate"]
    current = monitor.one_row(after.select(*fields), top)
    previous = before.select(*fields, F.lit(0).cast("bigint").alias("max_lag"))
    return monitor.perf_compare(previous, current)


# -- logs -----------------------------------------------------------------------------------------

_LINES = f"""{sql.EV}, calls AS (SELECT event_type AS api, k, ((event_id * 37) % 4001)::DOUBLE AS d FROM ev WHERE event_id % 11 <> 0)"""


@query(
    "api_call_stats",
    f"""WITH {_LINES}, r AS (SELECT api, d, row_number() OVER (PARTITION BY api ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY api) AS n FROM calls),
    s AS (SELECT api, any_value(n) AS n, median(d) AS m, max(d) FILTER (i = least(n - 1, round_even(0.95::DOUBLE * (n - 1), 0))) AS t FROM r GROUP BY api)
    SELECT api, n, {sql.rounded('m')} AS p50, {sql.rounded('t')} AS p95 FROM s""",
)
def api_call_stats(spark, sf_dir):
    return monitor.api_call_stats(monitor.api_calls(views.log_lines(spark, sf_dir)))


@query(
    "api_failure_rate",
    f"""WITH {_LINES} SELECT api, count(*) AS calls, count(*) FILTER (k < 3) AS exceptions, count(*) FILTER (k < 10) AS failures,
      round_even(count(*) FILTER (k < 10) / count(*), 4) AS failure_rate FROM calls GROUP BY api""",
)
def api_failure_rate(spark, sf_dir):
    return monitor.api_failure_rate(monitor.api_calls(views.log_lines(spark, sf_dir)))


# -- plain analytics ------------------------------------------------------------------------------

_WINDOWS = {"7": 604800, "24h": 86400, "90m": 5400, "2w": 1209600}


@query(
    "lookback_counts",
    "SELECT "
    + ", ".join(f"count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL {s} SECOND) AS n_{w}" for w, s in _WINDOWS.items())
    + " FROM events",
)
def lookback_counts(spark, sf_dir):
    """All windows in one pass; the widest one is pushed down to the scan."""
    e = table(spark, sf_dir, "events").where(F.col("ts") >= _now() - lookback_interval("2w"))
    return e.agg(*[F.count(F.when(F.col("ts") >= _now() - lookback_interval(w), True)).alias(f"n_{w}") for w in _WINDOWS])


@query(
    "latency_stats",
    f"""WITH {sql.EVENT_METRICS}, s AS (SELECT 'e2e_latency_seconds' AS measure, e2e_latency_seconds AS v, 1000 AS scale FROM em
      UNION ALL SELECT 'process_duration_ms', process_duration_ms, 10 FROM em)
    SELECT measure, count(v) AS n, min(v) AS lowest, max(v) AS highest, sum(CAST(round(v * scale) AS HUGEINT))::DOUBLE / any_value(scale) AS total,
      sum(CAST(round(v * scale) AS HUGEINT))::DOUBLE / (count(v) * any_value(scale)) AS mean FROM s GROUP BY measure""",
)
def latency_stats(spark, sf_dir):
    return monitor.basic_stats(views.event_metrics(spark, sf_dir), {"e2e_latency_seconds": 1000, "process_duration_ms": 10})


@query(
    "latest_failures",
    f"""WITH {sql.EVENT_METRICS} SELECT event_id, region, strftime(processed_at, '%Y-%m-%d %H:%M:%S') AS processed_at FROM em
    WHERE delivery_failed ORDER BY em.processed_at DESC, event_id DESC LIMIT 10""",
)
def latest_failures(spark, sf_dir):
    return monitor.latest_failures(views.event_metrics(spark, sf_dir)).select(
        "event_id", "region", views.text_time("processed_at").alias("processed_at")
    )


@query(
    "failure_histogram",
    f"""WITH {sql.EVENT_METRICS} SELECT strftime(time_bucket(INTERVAL 1 HOUR, processed_at), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS failures
    FROM em WHERE delivery_failed GROUP BY 1""",
)
def failure_histogram(spark, sf_dir):
    return monitor.failure_histogram(views.event_metrics(spark, sf_dir)).withColumn("bucket", views.text_time("bucket"))


@query(
    "allowlisted_missing",
    f"""WITH {sql.EVENT_METRICS} SELECT event_id, region, array_to_string(missing_indices, '|') AS missing_indices, missing_count FROM em
    WHERE missing_count > 0""",
)
def allowlisted_missing(spark, sf_dir):
    return allowlisted(views.event_metrics(spark, sf_dir).where("missing_count > 0")).withColumn(
        "missing_indices", F.array_join("missing_indices", "|")
    )


# -- alarms ---------------------------------------------------------------------------------------


@query(
    "alarm_conditions",
    f"""WITH {sql.EVENT_METRICS}, {_LAG}, win AS (SELECT * FROM em WHERE processed_at >= TIMESTAMP '{NOW}' - INTERVAL 70 MINUTE),
    hits AS (SELECT * FROM win WHERE missing_count > 0 ORDER BY processed_at DESC, event_id DESC LIMIT 20),
    s AS (SELECT scene, status, (SELECT count(*) FROM ev WHERE ts - to_days(behind) >= TIMESTAMP '{NOW}' - INTERVAL 7 HOUR) AS recent,
      (SELECT count(*) FROM win WHERE delivery_failed) AS failed, (SELECT count(*) FROM hits) AS hit, (SELECT max(lag) FROM lag) AS lag,
      (SELECT array_to_string(list_sort(list(DISTINCT m)), '|') FROM (SELECT unnest(missing_indices) AS m FROM hits)) AS names,
      (SELECT string_agg(event_id, '|' ORDER BY processed_at DESC, event_id DESC) FROM (SELECT * FROM hits ORDER BY processed_at DESC, event_id DESC LIMIT 5)) AS ids
      FROM (VALUES ('current', 'green', 0), ('stopped', 'red', 400)) AS scenes(scene, status, behind))
    SELECT scene, 'a' AS code, '신규 이력 없음 (7시간)' AS title, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS event_ids FROM s WHERE recent = 0
    UNION ALL SELECT scene, 'b', '전달 실패 ' || failed || '건', NULL, NULL FROM s WHERE failed > 0
    UNION ALL SELECT scene, 'c', '결측 발생 ' || hit || '건', names, ids FROM s WHERE hit > 0
    UNION ALL SELECT scene, 'd', '컨슈머 랙 ' || lag || ' (> 4)', NULL, NULL FROM s WHERE lag > 4
    UNION ALL SELECT scene, 'g', 'OpenSearch 클러스터 red', NULL, NULL FROM s WHERE status = 'red'""",
)
def alarm_conditions(spark, sf_dir):
    """Over the whole history as it is, and over the same history had it ended 400 days earlier."""
    lag = monitor.partition_lag(*_offsets(spark, sf_dir))
    metrics, history = views.event_metrics(spark, sf_dir), views.events(spark, sf_dir)

    def scene(name, status, behind):
        at = history.select((F.col("ts") - F.expr(f"interval {behind} days")).alias("at"))
        found = monitor.alarm_conditions(monitor.alarm_snapshot(metrics, at, lag, status, _now()))
        return found.withColumn("scene", F.lit(name))

    return scene("current", "green", 0).unionByName(scene("stopped", "red", 400))


@query(
    "silent_regions",
    f"""WITH {sql.EV} SELECT region FROM (SELECT DISTINCT region FROM ev UNION SELECT DISTINCT o_orderpriority FROM orders)
    WHERE region NOT IN (SELECT region FROM ev WHERE event_type = 'error' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 HOUR)""",
)
def silent_regions(spark, sf_dir):
    e = views.events(spark, sf_dir)
    expected = e.select("region").unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("region")))
    history = e.where("event_type = 'error'").select("region", F.col("ts").alias("at"))
    return monitor.silent_regions(expected, history, _now())


_LAST_SQL = f"""{sql.EV}, st AS (SELECT region || ':' || event_type AS code, region, max(ts) AS t FROM ev WHERE ts <= TIMESTAMP '{NOW}' GROUP BY region, event_type),
  al AS (SELECT DISTINCT region || ':' || event_type AS code FROM ev)"""


@query(
    "alarm_cooldown",
    f"""WITH {_LAST_SQL} SELECT code, 'fired' AS title FROM al LEFT JOIN st USING (code)
    WHERE region IS NULL OR region <= 'R03' OR t <= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE""",
)
def alarm_cooldown(spark, sf_dir):
    """One tick: every (region, type) alarm fires; regions up to R03 carry an unreadable last time."""
    e = views.events(spark, sf_dir).withColumn("code", F.concat_ws(":", "region", "event_type"))
    alarms = e.select("code").distinct().withColumn("title", F.lit("fired"))
    stamp = F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    state = (
        e.where(F.col("ts") <= _now())
        .groupBy("code", "region")
        .agg(F.max("ts").alias("t"))
        .select("code", F.when(F.col("region") <= "R03", F.lit("garbage")).otherwise(stamp).alias("last_notified"))
    )
    return monitor.cooldown_filter(alarms, state, zoned_instant(F.lit(NOW.replace(" ", "T") + "+00:00")))


@query(
    "alarm_cooldown_series",
    f"""WITH RECURSIVE {sql.EV}, {sql.gate("SELECT event_type AS region, event_id AS o, ts AS clock, 'on' AS sig, false AS core, true AS ok, true AS enabled FROM ev WHERE value > 50", 3600)}
    SELECT region AS code, o AS tick, send AS notify FROM gate""",
)
def alarm_cooldown_series(spark, sf_dir):
    ticks = views.events(spark, sf_dir).where("value > 50").select(
        F.col("event_type").alias("code"), F.col("event_id").alias("tick"), F.col("ts").alias("at")
    )
    return monitor.cooldown_series(ticks).select("code", "tick", "notify")
