"""Queries on records, validation, the send gate and what follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.grading import core_missing, severity, signature, with_grades
from skygauge.functions.scalars import month_key, zoned_instant
from skygauge.operators import delivery, validate
from skygauge.operators.gate import send_gate, signature_changes
from skygauge.operators.monitor import suppressed_ratio
from skygauge.plans import sql, views
from skygauge.plans.registry import query, table
from skygauge.streaming.alerts import with_seq

_DAMAGE = """CASE WHEN msg_offset % 41 = 0 THEN 1 WHEN msg_offset % 43 = 1 THEN 2 WHEN msg_offset % 47 = 2 THEN 3
  WHEN msg_offset % 53 = 3 THEN 4 WHEN msg_offset % 59 = 4 THEN 5 WHEN msg_offset % 61 = 5 THEN 6
  WHEN msg_offset % 67 = 6 THEN 7 WHEN msg_offset % 71 = 7 THEN 8 ELSE 0 END"""
_RAW = f"{sql.MSG}, raw AS (SELECT *, {_DAMAGE} AS d FROM msg)"
_REASON = (
    "CASE d WHEN 1 THEN 'invalid json' WHEN 2 THEN 'not an object' WHEN 3 THEN 'unsupported schema_version: 99'"
    " WHEN 4 THEN 'missing required keys: region' WHEN 7 THEN 'invalid json' WHEN 8 THEN 'empty value' END"
)


@query(
    "scan_raw_messages",
    f"""WITH {_RAW} SELECT 'observations' AS topic, msg_partition AS "partition", msg_offset AS "offset", region AS record_key,
      CASE WHEN d NOT IN (1, 2, 8) THEN event_id END AS event_id, d = 8 AS empty FROM raw""",
)
def scan_raw_messages(spark, sf_dir):
    raw = views.raw_records(spark, sf_dir)
    return raw.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("record_key"),
        F.get_json_object(F.col("value").cast("string"), "$.event_id").alias("event_id"),
        F.col("value").isNull().alias("empty"),
    )


def _validated(spark, sf_dir):
    return validate.validate(views.raw_records(spark, sf_dir))


@query(
    "validate_messages",
    f"""WITH {_RAW} SELECT msg_offset AS "offset", event_id, region,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN d = 6 THEN '+00:00' ELSE '+09:00' END AS stamp,
      pm10, pm25, dust AS yellow_dust, feels_like_temp, precipitation_probability, uv_index, oak_pollen, pine_pollen, other_special_notice
      FROM raw WHERE d IN (0, 5, 6)""",
)
def validate_messages(spark, sf_dir):
    return validate.valid_messages(_validated(spark, sf_dir)).select(
        "offset",
        "event_id",
        "region",
        F.col("timestamp").alias("stamp"),
        "pm10",
        "pm25",
        "yellow_dust",
        "feels_like_temp",
        "precipitation_probability",
        "uv_index",
        "oak_pollen",
        "pine_pollen",
        "other_special_notice",
    )


@query("reject_reasons", f"WITH {_RAW} SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS n FROM raw GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return (
        _validated(spark, sf_dir)
        .groupBy(F.coalesce("reason", F.lit("valid")).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "dead_letters",
    f"""WITH {_RAW} SELECT {_REASON} AS reason, 'observations' AS source_topic, msg_partition AS source_partition,
      msg_offset AS source_offset, strftime(ts, '%Y-%m-%d %H:%M:%S') AS failed_at,
      CASE WHEN d IN (3, 4) THEN event_id END AS raw_event_id, CASE d WHEN 1 THEN '{{broken json' WHEN 2 THEN '[1, 2, 3]' END AS raw_text
      FROM raw WHERE d IN (1, 2, 3, 4, 7, 8)""",
)
def dead_letters(spark, sf_dir):
    dead = validate.dead_letters(_validated(spark, sf_dir), views.text_time("ts"))
    json_kind = F.col("reason").rlike("^(unsupported|missing)")
    return dead.select(
        "reason",
        "source_topic",
        "source_partition",
        "source_offset",
        "failed_at",
        F.when(json_kind, F.get_json_object("raw", "$.event_id")).alias("raw_event_id"),
        F.when(F.col("raw").isin("{broken json", "[1, 2, 3]"), F.col("raw")).alias("raw_text"),
    )


@query(
    "commit_positions",
    """WITH o AS (SELECT user_id % 6 AS p, event_id AS o, event_id % 4999 = 4998 AND user_id % 6 <> 0 AS failed FROM events),
    f AS (SELECT p, min(o) FILTER (failed) AS retry_from FROM o GROUP BY p)
    SELECT 'observations' AS topic, CAST(p AS INTEGER) AS "partition", max(o) FILTER (retry_from IS NULL OR o < retry_from) + 1 AS "commit",
      any_value(retry_from) AS retry_from, count(*) FILTER (retry_from IS NULL OR o < retry_from) AS processed,
      count(*) FILTER (o >= retry_from) AS waiting
    FROM o JOIN f USING (p) GROUP BY p""",
)
def commit_positions(spark, sf_dir):
    outcomes = table(spark, sf_dir, "events").select(
        F.lit("observations").alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        ((F.col("event_id") % 4999 == 4998) & (F.col("user_id") % 6 != 0)).alias("failed"),
    )
    return validate.commit_positions(outcomes)


# -- send gate ------------------------------------------------------------------------------------

_GATE_OUT = "event_id, sig AS signature, send, reason, recorded"


@query(
    "signature_changes",
    f"""WITH {sql.GRADED}, p AS (SELECT event_id, {sql.SIGNATURE} AS signature,
      lag({sql.SIGNATURE}) OVER (PARTITION BY region ORDER BY msg_offset) AS previous FROM graded)
    SELECT *, previous IS NULL OR previous <> signature AS changed FROM p""",
)
def signature_changes_query(spark, sf_dir):
    rows = views.graded(spark, sf_dir).select("event_id", "region", F.col("msg_offset").alias("offset"), F.expr(signature()).alias("signature"))
    return signature_changes(rows).select("event_id", "signature", "previous", "changed")


@query("send_gate", f"WITH RECURSIVE {sql.MSG}, {sql.gate(sql.GATE_ROWS)} SELECT {_GATE_OUT} FROM gate")
def send_gate_query(spark, sf_dir):
    return views.decisions(spark, sf_dir).select("event_id", "signature", "send", "reason", "recorded")


_PARTITION_ROWS = sql.GATE_ROWS.replace("msg_offset AS o", "(msg_offset // 6) * 6 + 5 - msg_offset % 6 AS o")


@query("send_gate_partitions", f"WITH RECURSIVE {sql.MSG}, {sql.gate(_PARTITION_ROWS)} SELECT {_GATE_OUT} FROM gate")
def send_gate_partitions(spark, sf_dir):
    """Six partitions with the same offsets: the gate follows offsets, then partitions."""
    rows = views.gate_rows(spark, sf_dir)
    rows = rows.selectExpr("* except (offset)", "'observations' as topic", "int(5 - offset % 6) as partition", "offset div 6 as offset")
    ordered = with_seq(rows, rows).drop("offset", "topic", "partition").withColumnRenamed("seq", "offset")
    return send_gate(ordered).select("event_id", "signature", "send", "reason", "recorded")


@query("send_gate_full", f"WITH RECURSIVE {sql.GRADED}, {sql.gate(sql.FULL_GATE_ROWS)} SELECT {_GATE_OUT} FROM gate")
def send_gate_full(spark, sf_dir):
    rows = views.gate_rows(spark, sf_dir, coarse=False)
    return send_gate(rows).select("event_id", "signature", "send", "reason", "recorded")


_CHAIN_SIGNATURE = ("pm10", "pm25")
_CHAIN_SIGNATURE_SQL = " || '|' || ".join(f"'{i}=' || {sql.labelled(i)}" for i in _CHAIN_SIGNATURE)
_CHAIN_ROWS = (
    f"SELECT region, msg_offset AS o, ts AS clock, {_CHAIN_SIGNATURE_SQL} AS sig, {sql.CORE} AS core,"
    f" msg_offset % 5 <> 0 AS ok, true AS enabled, event_id, {sql.SEVERITY} AS severity FROM graded"
)


@query(
    "alert_chain",
    f"""WITH RECURSIVE {sql.EVENT_MSG}, {sql.graded("emsg")}, {sql.gate(_CHAIN_ROWS, 3600)}
    SELECT event_id, region, sig AS signature, severity, send, reason, recorded FROM gate""",
)
def alert_chain(spark, sf_dir):
    """Raw records to decisions, one message per event: validate, grade, gate."""
    messages = validate.valid_messages(validate.validate(views.event_records(spark, sf_dir)))
    rows = with_grades(messages).select(
        "region",
        "offset",
        zoned_instant(F.col("timestamp")).alias("clock"),
        F.expr(signature(_CHAIN_SIGNATURE)).alias("signature"),
        F.expr(core_missing()).alias("core_missing"),
        (F.col("offset") % 5 != 0).alias("delivered"),
        F.lit(True).alias("enabled"),
        "event_id",
        F.expr(severity()).alias("severity"),
    )
    out = send_gate(rows, 3600)
    return out.select("event_id", "region", "signature", "severity", "send", "reason", "recorded")


_ORDER_SILENCE = 90 * 86400


@query(
    "send_gate_orders",
    f"""WITH RECURSIVE {sql.gate(sql.ORDER_GATE_ROWS, _ORDER_SILENCE)}
    SELECT region, o AS "offset", send, reason, recorded FROM gate""",
)
def send_gate_orders(spark, sf_dir):
    """All orders through the gate: a hot region, disabled channels and a clock that runs back and forth."""
    out = send_gate(views.order_gate_rows(spark, sf_dir), _ORDER_SILENCE)
    return out.select("region", "offset", "send", "reason", "recorded")


_STATE = f"{sql.MSG}, {sql.gate(sql.GATE_ROWS)}, state AS (SELECT region, arg_max(psig, rn) AS signature, max(plast) AS last_sent FROM gate GROUP BY region)"


def _state(spark, sf_dir):
    return delivery.state_upsert(delivery.gate_state_changes(views.decisions(spark, sf_dir)))


@query(
    "state_upsert",
    f"WITH RECURSIVE {_STATE} SELECT region, signature, strftime(last_sent, '%Y-%m-%d %H:%M:%S') AS last_sent FROM state",
)
def state_upsert(spark, sf_dir):
    return _state(spark, sf_dir).withColumn("last_sent", views.text_time("last_sent"))


@query(
    "state_lookup",
    f"""WITH RECURSIVE {sql.GRADED}, {sql.gate(sql.GATE_ROWS)}, state AS (SELECT if(region < 'R05', region || ' moved', region) AS region, arg_max(psig, rn) AS signature FROM gate GROUP BY ALL),
    old AS (SELECT if(region < 'R10', region, region || ' moved') AS region, arg_max({sql.SIGNATURE}, stamp) AS sig FROM graded GROUP BY ALL),
    r AS (SELECT DISTINCT region FROM ev UNION SELECT DISTINCT o_orderpriority FROM orders)
    SELECT region, coalesce(state.signature, old.sig) AS signature,
      CASE WHEN state.region IS NOT NULL THEN 'state' WHEN old.region IS NOT NULL THEN 'history' ELSE 'none' END AS source
    FROM r LEFT JOIN state USING (region) LEFT JOIN old USING (region)""",
)
def state_lookup(spark, sf_dir):
    known = views.events(spark, sf_dir).select("region")
    unknown = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("region"))
    # all rows stay: regions that have state, history, both or neither come from renaming some of them
    history = views.graded(spark, sf_dir).select("region", "timestamp", F.expr(signature()).alias("grade_signature"))
    history = history.withColumn("region", F.expr("if(region < 'R10', region, region || ' moved')"))
    state = _state(spark, sf_dir).withColumn("region", F.expr("if(region < 'R05', region || ' moved', region)"))
    out = delivery.state_lookup(known.unionByName(unknown), state, history)
    return out.select("region", "signature", "source")


# -- delivery -------------------------------------------------------------------------------------


@query(
    "channel_outbox",
    f"""WITH RECURSIVE {sql.MSG}, {sql.gate(sql.GATE_ROWS)}
    SELECT event_id, region, unnest({list(fixed.CHANNELS)}) AS channel FROM gate WHERE send""",
)
def channel_outbox(spark, sf_dir):
    return delivery.channel_outbox(views.decisions(spark, sf_dir)).select("event_id", "region", "channel")


_DELIVERED = "concat_ws('|', " + ", ".join(
    f"CASE WHEN send AND (o + {c}) % 5 <> 0 THEN '{name}' END" for c, name in enumerate(fixed.CHANNELS)
) + ")"


@query(
    "delivered_channels",
    f"WITH RECURSIVE {sql.MSG}, {sql.gate(sql.GATE_ROWS)} SELECT event_id, send, {_DELIVERED} AS delivered FROM gate",
)
def delivered_channels(spark, sf_dir):
    decided = views.decisions(spark, sf_dir)
    out = delivery.delivered_channels(decided, views.channel_results(delivery.channel_outbox(decided)))
    return out.select("event_id", "send", F.array_join("delivered_channels", "|").alias("delivered"))


_METRICS_SQL = f"""{sql.GRADED}, {sql.gate(sql.GATE_ROWS)}, mm AS (SELECT g.event_id, g.region, g.send, d.ts, d.slot, g.o,
    {_DELIVERED} AS delivered, {sql.missing()} AS missing, {sql.MISSING_COUNT} AS missing_count, {sql.SEVERITY} AS severity
    FROM gate g JOIN graded d USING (event_id))"""


def _metrics(spark, sf_dir):
    decided = views.decided_messages(spark, sf_dir)
    decided = delivery.delivered_channels(decided, views.channel_results(delivery.channel_outbox(decided)))
    ready = (
        decided.withColumn("duration_ms", (F.col("offset") * 13 % 4800) / 10)
        .withColumn("indexed", F.col("offset") % 50 != 0)
        .withColumn("timestamp", F.concat(F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .withColumn("_none", F.array().cast("array<string>"))
        .withColumn("delivered_channels", F.coalesce("delivered_channels", "_none"))
    )
    return delivery.message_metrics(ready, F.col("ts").cast("timestamp"))


@query(
    "message_metrics",
    f"""WITH RECURSIVE {_METRICS_SQL} SELECT event_id, region, round((o * 13 % 4800) / 10, 1) AS process_duration_ms,
      round_even((epoch_us(ts) - epoch_us(slot)) / 1000.0, 0) / 1000 AS e2e_latency_seconds, send AS external_attempted,
      delivered AS delivered_channels, send AND delivered = '' AS delivery_failed, NOT send AS suppressed, missing AS missing_indices,
      missing_count, severity AS alert_severity, o % 50 <> 0 AS indexed FROM mm""",
)
def message_metrics(spark, sf_dir):
    return (
        _metrics(spark, sf_dir)
        .drop("processed_at")
        .withColumn("delivered_channels", F.array_join("delivered_channels", "|"))
        .withColumn("missing_indices", F.array_join("missing_indices", "|"))
    )


@query(
    "suppressed_ratio",
    f"""WITH RECURSIVE {_METRICS_SQL} SELECT region, count(*) AS messages, count(*) FILTER (NOT send) AS suppressed,
      round_even(count(*) FILTER (NOT send) / count(*), 4) AS ratio FROM mm GROUP BY region""",
)
def suppressed_ratio_query(spark, sf_dir):
    return suppressed_ratio(_metrics(spark, sf_dir), ["region"])


# -- history --------------------------------------------------------------------------------------


def _history(spark, sf_dir):
    """History rows from all orders: a customer's orders of one month share an event id (replays)."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(":"), F.date_format("o_orderdate", "yyyyMM")).alias("event_id"),
        month_key(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("month"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderstatus").alias("severity"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("at"),
    )


_HISTORY = """h AS (SELECT 'C' || o_custkey || ':' || strftime(o_orderdate, '%Y%m') AS event_id, strftime(o_orderdate, '%Y.%m') AS month,
    o_orderkey AS o, o_orderstatus AS severity, o_totalprice AS value, o_orderdate AS written FROM orders)"""


@query(
    "history_upsert",
    f"""WITH {_HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY month, event_id ORDER BY o DESC) AS rn FROM h)
    SELECT month, event_id, o AS "offset", severity, value FROM r WHERE rn = 1""",
)
def history_upsert(spark, sf_dir):
    return delivery.upsert_history(_history(spark, sf_dir).drop("at"))


@query(
    "duplicate_events",
    f'WITH {_HISTORY} SELECT event_id, count(*) AS copies, max(o) AS last_offset FROM h GROUP BY event_id HAVING count(*) > 1',
)
def duplicate_events(spark, sf_dir):
    return delivery.duplicate_events(_history(spark, sf_dir))


_RETENTION_NOW = "2001-06-15 00:00:00"


@query(
    "retention_keep",
    f"""WITH {_HISTORY} SELECT month, count(*) AS n, min(written) > TIMESTAMP '{_RETENTION_NOW}' - INTERVAL 90 DAY AS keep FROM h GROUP BY month""",
)
def retention_keep(spark, sf_dir):
    parts = _history(spark, sf_dir).groupBy("month").agg(F.count("*").alias("n"), F.min("at").alias("created_at"))
    return delivery.retention(parts, F.lit(_RETENTION_NOW).cast("timestamp_ntz")).drop("created_at")
