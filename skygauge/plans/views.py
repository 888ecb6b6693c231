"""Inputs of the operators, derived by Spark from the given tables.

`events` plays the stream of observations: five event types feed five indices, users are stations and
fall into 17 regions, six hours make a slot. Every view grows with the tables and is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.grading import core_missing, missing_names, severity, signature, with_grades
from skygauge.functions.scalars import event_id
from skygauge.operators.gate import send_gate
from skygauge.operators.ordered import cut_lineage
from skygauge.plans.registry import table

K = "cast(get_json_object(props, '$.k') as bigint)"
REGION = "concat('R', lpad(cast(user_id % 17 as string), 2, '0'))"
SLOT_TEXT = "yyyy-MM-dd HH:mm:ss"
TASK_ROWS = 100_000


def text_time(column: str | Column) -> Column:
    return F.date_format(column, SLOT_TEXT)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with region, six-hour slot and the number `k` from their properties."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("region", F.expr(REGION))
        .withColumn("slot", F.window("ts", "6 hours")["start"])
        .withColumn("k", F.expr(K))
    )


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The narrow rows dealt to tasks of `TASK_ROWS` or less, by `keys` if given, before they are widened or parsed.

    A scan gives as many tasks as the file has splits, however much is made of each row.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // TASK_ROWS)), *keys)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide message per region and slot."""
    grouped = events(spark, sf_dir).groupBy("region", "slot").agg(
        *[
            F.expr(f"{text} as {name}")
            for name, text in {
                "ts": "max(ts)",
                "msg_offset": "max(event_id)",
                "msg_partition": "cast(min(user_id % 17) % 4 as int)",
                "pm10": "max_by(value, ts) filter (where event_type = 'click')",
                "pm25": "max_by(value, ts) filter (where event_type = 'view') / 2",
                "yellow_dust": "max_by(value, ts) filter (where event_type = 'error') * 2",
                "feels_like_temp": "max_by(value, ts) filter (where event_type = 'signup') / 2 - 10",
                "precipitation_probability": "max_by(case when value > 100.0D then 100.0D else value end, ts)"
                " filter (where event_type = 'purchase')",
                "uv_index": "cast(nullif(max_by(k, ts) % 13, 12) as double)",
                "oak_pollen": "cast(nullif(count(*) filter (where event_type = 'click'), 0) as double)",
                "pine_pollen": "cast(nullif(count(*) filter (where event_type = 'view'), 0) as double)",
                "_errors": "count(*) filter (where event_type = 'error')",
            }.items()
        ]
    )
    notice = (
        F.when(F.col("_errors") >= 2, F.lit("강풍 가능"))
        .when(F.col("_errors") == 1, F.lit(fixed.NOTICE_NONE))
        .otherwise(F.lit(fixed.NOTICE_UNKNOWN))
    )
    return (
        grouped.withColumn("other_special_notice", notice)
        .drop("_errors")
        .withColumn("event_id", event_id(F.col("region"), F.col("slot")))
        .withColumn("timestamp", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
    )


def graded(spark: SparkSession, sf_dir: str, advice: bool = False) -> DataFrame:
    return with_grades(messages(spark, sf_dir), advice=advice)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic records of the messages, some of them damaged by a rule on the offset."""
    fields = [
        "event_id",
        "pm10",
        "pm25",
        "yellow_dust",
        "feels_like_temp",
        "precipitation_probability",
        "uv_index",
        "oak_pollen",
        "pine_pollen",
        "other_special_notice",
    ]
    o = F.col("msg_offset")
    first_hit = F.when(o % 41 == 0, 1)
    for number, (modulus, rest) in enumerate([(43, 1), (47, 2), (53, 3), (59, 4), (61, 5), (67, 6), (71, 7)], start=2):
        first_hit = first_hit.when(o % modulus == rest, number)
    rows = messages(spark, sf_dir).withColumn("_d", F.coalesce(first_hit, F.lit(0)))
    d = F.col("_d")
    version = F.when(d == 3, F.lit(99)).when(d == 5, F.lit(None)).otherwise(F.lit(fixed.SCHEMA_VERSION))
    stamp = F.when(d == 6, F.regexp_replace("timestamp", r"\+09:00$", "Z")).otherwise(F.col("timestamp"))
    body = F.to_json(
        F.struct(
            version.alias("schema_version"),
            F.when(d == 4, F.lit("")).otherwise(F.col("region")).alias("region"),
            stamp.alias("timestamp"),
            *fields,
        )
    )
    value = (
        F.when(d == 1, F.lit("{broken json"))
        .when(d == 2, F.lit("[1, 2, 3]"))
        .when(d == 7, F.concat(body, F.lit(" xyz")))
        .when(d == 8, F.lit(None).cast("string"))
        .otherwise(body)
    )
    return rows.select(
        F.lit("observations").alias("topic"),
        F.col("msg_partition").alias("partition"),
        F.col("msg_offset").alias("offset"),
        F.col("region").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        "ts",
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic record per event, a JSON message of its own; some are broken."""
    body = f"""to_json(named_struct(
        'schema_version', {fixed.SCHEMA_VERSION}, 'event_id', concat('E', event_id), 'region', region,
        'timestamp', concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+09:00'),
        'pm10', case when event_type = 'click' then value when k % 2 = 0 then cast(k as double) end,
        'pm25', case when event_type = 'view' then value / 2 when k % 3 = 0 then k / 2.0D end,
        'yellow_dust', if(event_type = 'error', value * 2, null),
        'feels_like_temp', if(event_type = 'signup', value / 2 - 10, null),
        'precipitation_probability', if(event_type = 'purchase', value, null),
        'uv_index', k % 13, 'oak_pollen', k % 5, 'pine_pollen', cast(k % 4 as string),
        'other_special_notice', case when k % 7 = 0 then '강풍 가능' when k % 7 < 4 then '없음' else '정보없음' end))"""
    return spread(events(spark, sf_dir), "event_id").selectExpr(
        "'observations' as topic",
        "cast(user_id % 17 % 4 as int) as partition",
        "event_id as offset",
        "cast(region as binary) as key",
        f"cast(if(event_id % 41 = 0, '{{broken json', {body}) as binary) as value",
    )


COARSE_SIGNATURE = "case when pm10 is null then 'U' when pm10 <= 80 then 'L' else 'H' end"


def gate_rows(spark: SparkSession, sf_dir: str, coarse: bool = True) -> DataFrame:
    """Gate input from the messages; every fifth offset fails to be delivered."""
    g = graded(spark, sf_dir)
    return g.select(
        "region",
        F.col("msg_offset").alias("offset"),
        F.col("ts").alias("clock"),
        F.expr(COARSE_SIGNATURE if coarse else signature()).alias("signature"),
        F.expr(core_missing()).alias("core_missing"),
        (F.col("msg_offset") % 5 != 0).alias("delivered"),
        F.lit(True).alias("enabled"),
        "event_id",
    )


def order_gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate input from all orders: one region holds about a third of the rows, and the clock does not
    follow the offset."""
    o = table(spark, sf_dir, "orders")
    hot = F.col("o_custkey") % 3 == 0
    return o.select(
        F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("C"), (F.col("o_custkey") % 23).cast("string"))).alias("region"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").alias("clock"),
        F.when(F.col("o_totalprice") > 480000, F.lit("H")).when(F.col("o_totalprice") < 10000, F.lit("U")).otherwise(F.lit("L")).alias("signature"),
        (F.col("o_totalprice") < 5000).alias("core_missing"),
        (F.col("o_orderkey") % 7 != 0).alias("delivered"),
        (F.col("o_orderstatus") != "P").alias("enabled"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return send_gate(gate_rows(spark, sf_dir))


def channel_results(outbox: DataFrame) -> DataFrame:
    """Outcome of each attempt: channel number c succeeds when (offset + c) % 5 <> 0."""
    number = F.array_position(F.array(*map(F.lit, fixed.CHANNELS)), F.col("channel")) - 1
    return outbox.select("event_id", "channel", ((F.col("offset") + number) % 5 != 0).alias("ok"))


def decided_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions rejoined with the wide details they need downstream."""
    details = graded(spark, sf_dir).select(
        "event_id",
        "timestamp",
        "ts",
        "slot",
        F.expr(missing_names()).alias("missing"),
        F.expr(severity()).alias("severity"),
    )
    return decisions(spark, sf_dir).join(details, "event_id")


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message metrics with one row per event."""
    e = F.col("event_id")
    k10 = F.col("k") % 10
    names = (
        F.when(k10 == 0, F.array(F.lit("pm10"), F.lit("pm25")))
        .when(k10 == 1, F.array(F.lit("uv_index")))
        .otherwise(F.array().cast("array<string>"))
    )
    return events(spark, sf_dir).select(
        F.concat(F.col("region"), F.lit("#"), e.cast("string")).alias("event_id"),
        "region",
        F.col("ts").alias("processed_at"),
        (F.bround(F.col("value") * 10, 0) / 10).alias("process_duration_ms"),
        F.when(e % 97 != 0, ((e * 7919) % 22000) / F.lit(1000.0)).alias("e2e_latency_seconds"),
        (e % 3 != 0).alias("external_attempted"),
        ((e % 3 != 0) & (e % 5 == 0)).alias("delivery_failed"),
        (e % 3 == 0).alias("suppressed"),
        names.alias("missing_indices"),
        F.size(names).alias("missing_count"),
        (e % 50 != 0).alias("indexed"),
    )


def payloads(spark: SparkSession, sf_dir: str, xml: bool = False) -> DataFrame:
    """One portal reply per event in every layout, as JSON text or as XML text."""
    e = table(spark, sf_dir, "events").withColumn("k", F.expr(K)).withColumn("v", F.format_string("%.2f", "value"))
    pm10 = "case k % 10 when 0 then '-' when 1 then '' else v end"
    if xml:
        item = (
            "concat('<item><stationName>S', user_id, '</stationName><pm10Value>', "
            f"{pm10}, '</pm10Value><pm25Value>', k, '</pm25Value></item>')"
        )
        second = "concat('<item><stationName>T', user_id, '</stationName><pm10Value>', k, '</pm10Value></item>')"
        code = "case event_id % 7 when 0 then '03' when 2 then '0' else '00' end"
        body = (
            "concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?><response><header><resultCode>', "
            f"{code}, '</resultCode><resultMsg>X</resultMsg></header><body><items>', {item}, "
            f"if(event_id % 4 < 2, {second}, ''), '</items></body></response>')"
        )
    else:
        item = (
            "concat('{\"stationName\":\"S', user_id, '\",\"pm10Value\":\"', "
            f"{pm10}, '\",\"pm25Value\":\"', k, '\"}}')"
        )
        second = "concat('{\"stationName\":\"T', user_id, '\",\"pm10Value\":\"', k, '\"}')"
        items = (
            f"case event_id % 4 when 0 then concat('[', {item}, ',', {second}, ']')"
            f" when 1 then concat('{{\"item\":[', {item}, ',', {second}, ']}}')"
            f" when 2 then concat('{{\"item\":', {item}, '}}') else '\"\"' end"
        )
        head = (
            "case event_id % 7 when 0 then '\"header\":{\"resultCode\":\"03\"}' when 1 then '\"status\":\"00\"'"
            " when 2 then '\"header\":{\"resultCode\":\"0\"}' else '\"header\":{\"resultCode\":\"00\"}' end"
        )
        body = f"concat('{{\"response\":{{', {head}, ',\"body\":{{\"items\":', {items}, '}}}}}}')"
    return e.select("event_id", F.expr("if(event_id % 29 = 0, 503, 200)").alias("status_code"), F.expr(body).alias("payload"))


def feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(spine of all region slots, the nine source feeds with one row per region and slot)."""
    last = cut_lineage(
        events(spark, sf_dir)
        .groupBy("region", "slot", "event_type")
        .agg(F.max_by("value", "event_id").alias("v"), F.max_by("k", "event_id").alias("k"))
    )
    spine = last.select("region", "slot").distinct()

    def feed(kind: str, where: str, **columns: str) -> DataFrame:
        return last.where(f"event_type = '{kind}' and ({where})").select(
            "region", "slot", *[F.expr(text).alias(name) for name, text in columns.items()]
        )

    wind, none, unknown = "강풍 가능", fixed.NOTICE_NONE, fixed.NOTICE_UNKNOWN
    return spine, {
        "air": feed("click", "k % 10 <> 0", pm10="v", pm25="case when k % 3 <> 0 then v / 2 end"),
        "dust": feed(
            "error",
            "true",
            yellow_dust="case when k % 5 = 0 then null when k % 2 = 0 then 500.0D else 0.0D end",
            yellow_dust_advisory=f"case when k % 5 = 0 then null when k % 2 = 0 then '{fixed.ADVISORY_ISSUED}' else '{none}' end",
            yellow_dust_source="if(k % 5 = 0, 'ylwsnd_advisory_unavailable', 'ylwsnd_advisory')",
            dust_status="if(k % 5 = 0, 'unavailable', null)",
            dust_message="if(k % 5 = 0, 'denied', null)",
        ),
        "health": feed("signup", "true", oak_pollen="cast(k % 5 as double)", pine_pollen="cast(k % 4 as double)"),
        "living": feed("purchase", "k % 4 <> 0", living_temp="v / 2 - 10", living_max="case when k % 3 <> 0 then v / 2 - 5 end"),
        "uv": feed("click", "k % 6 <> 0", uv_index="cast(k % 13 as double)"),
        "pop": feed("view", "true", precipitation_probability="case when v > 100.0D then 100.0D else v end"),
        "temp": feed("error", "k % 3 <> 0", current_temperature="v / 2 - 10", temperature_source="'T1H'"),
        "notice": feed(
            "signup",
            "true",
            other_special_notice=f"case k % 3 when 0 then '{wind}' when 1 then '{none}' else '{unknown}' end",
            other_special_notice_source="'ultra_short_forecast'",
        ),
        "today": feed(
            "view",
            "k % 7 <> 0",
            today_pop="cast(k as double)",
            today_min="v / 4 - 10",
            today_max="v / 2",
            today_notice=f"case when k % 2 = 0 then '{fixed.TODAY_PREFIX}{wind}' else '{none}' end",
            today_source="'today_vilage_forecast'",
            today_period="'today_full'",
            today_date="date_format(slot, 'yyyyMMdd')",
        ),
    }


def feed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls by region and slot, where the feeds of `feeds` bring nothing for a reason."""
    last = events(spark, sf_dir).groupBy("region", "slot", "event_type").agg(F.max_by("k", "event_id").alias("k"))
    failed = {"air": ("click", 10), "uv": ("click", 6), "living": ("purchase", 4), "today": ("view", 7)}
    cases = ", ".join(
        f"struct('{feed}' as feed, event_type = '{kind}' and k % {step} = 0 as failed)" for feed, (kind, step) in failed.items()
    )
    rows = last.selectExpr("region", "slot", "k", f"inline(array({cases}))").where("failed")
    return rows.selectExpr("region", "slot", "feed", "concat(feed, ' 503 serviceKey=secret', k) as message")


def _json_reply(items: str) -> str:
    """SQL: a successful JSON reply around the text of its `items`."""
    return f"""concat('{{"response":{{"header":{{"resultCode":"00"}},"body":{{"items":', {items}, '}}}}}}')"""


def _json_item(**fields: str) -> str:
    """SQL: an item whose values are SQL expressions."""
    return "concat('{', " + ", ',', ".join(f"""'"{n}":"', {v}, '"'""" for n, v in fields.items()) + ", '}')"


def _json_list(*items: str) -> str:
    return f"concat('[', concat_ws(',', {', '.join(items)}), ']')"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of all sources for one region per event, at the slot of the event; those of a region lie together."""
    item, day = _json_item, "day"
    # the second station reports no pm25, some replies are XML
    pairs = "array(named_struct('a', string(k), 'b', '-'), named_struct('a', string(k + 1), 'b', string(k)))"
    stations = f"concat('[', array_join(transform({pairs}, s -> {item(pm10Value='s.a', pm25Value='s.b')}), ','), ']')"
    air_xml = (
        "concat('<response><header><resultCode>00</resultCode></header><body><items><item><pm10Value>', k,"
        " '</pm10Value><pm25Value>-</pm25Value></item><item><pm10Value>', k + 1, '</pm10Value><pm25Value>', k,"
        " '</pm25Value></item></items></body></response>')"
    )
    area, when = "concat('zone ', region, ' east')", f"concat(if(k % 2 = 0, {day}, '20000101'), '09')"
    named = f"if(k % 4 = 0, {item(tmArea=chr(39) * 2, issueArea=area, dataTime=when)}, {item(tmArea=area, dataTime=when)})"
    dust = _json_list(item(tmArea="'elsewhere'", dataTime=f"concat({day}, '09')"), f"if(k % 3 <> 0, {named}, null)")

    def one(text: str) -> str:
        return f"""concat('{{"item":', {text}, '}}')"""

    def forecast(category: str, value: str, time: str = "0600") -> str:
        return item(category=f"'{category}'", fcstDate=day, fcstTime=f"'{time}'", fcstValue=value)

    village = _json_list(
        forecast("POP", "k % 100", "0000"),
        forecast("POP", "k % 50", "1200"),
        forecast("TMP", "k", "0300"),
        forecast("TMP", "k + 10", "1500"),
        forecast("WSD", "k % 12"),
        forecast("PTY", "k % 2"),
    )
    observed = _json_list(item(category="'REH'", obsrValue="'7'"), item(category="'T1H'", obsrValue="k"))
    short = _json_list(
        forecast("LGT", "greatest(k % 10 - 8, 0)"),
        forecast("WSD", "k % 15"),
        forecast("WSD", "'99'"),
        forecast("PTY", "k % 3"),
        f"if(k % 4 <> 0, {forecast('T1H', 'k + 0.5')}, null)",
    )
    none = """'""'"""
    good = {
        "air": f"if(k % 7 = 3, {air_xml}, {_json_reply(stations)})",
        "dust": _json_reply(dust),
        "oak_pollen": _json_reply(one(item(today="if(k % 2 = 0, '', cast(k % 5 as string))", tomorrow="'4'"))),
        "pine_pollen": _json_reply(item(h3="'-'", h6="k % 4")),
        "living": _json_reply(one(item(h1="k", h2="k + 3"))),
        "uv": _json_reply(_json_list(item(date=f"concat({day}, '00')", h0="k % 3", h6="k % 7 + 1", h18="k % 11 + 2"))),
        "village": _json_reply(one(village)),
        "observed": _json_reply(f"if(k % 3 <> 0, {observed}, {none})"),
        "short": _json_reply(f"if(k % 13 <> 0, {one(short)}, {none})"),
    }
    failed = {
        "air": ("k % 10 = 0", 503, "busy"),
        "dust": ("k % 5 = 0", 403, "denied serviceKey=abc"),
        "living": ("k % 6 = 0", 500, "oops"),
        "uv": ("k % 8 = 1", 200, '{"response":{"header":{"resultCode":"03"}}}'),
        "village": ("k % 9 = 2", 200, "garbage"),
    }
    absent = {"pine_pollen": "k % 4 = 3", "uv": "k % 8 = 2"}

    def told(source: str) -> str:
        cond, status, body = failed.get(source, ("false", 200, ""))
        return (
            f"if({absent.get(source, 'false')}, null, named_struct('source', '{source}', 'status_code', if({cond}, {status}, 200),"
            f" 'payload', if({cond}, '{body}', {good[source]})))"
        )

    calls = events(spark, sf_dir).selectExpr("concat('E', event_id) as region", "slot", "k")
    calls = spread(calls, "region").selectExpr("*", "date_format(slot, 'yyyyMMdd') as day")
    # The texts are made in a projection of their own. As it holds a lambda (`stations`), its code is generated in small
    # methods; inside a whole stage it is one method of more than 8,000 bytes, which the JVM never compiles. The outer form
    # of explode keeps Catalyst from copying the texts into a filter on their number.
    sent = calls.selectExpr("region", "slot", f"array({', '.join(map(told, good))}) as rs")
    rows = sent.selectExpr("region", "slot", "explode_outer(rs) as r").where("r is not null")
    return rows.selectExpr("r.source as source", "region", "slot", "r.status_code as status_code", "r.payload as payload")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cell and coordinates of two thirds of the regions of `replies`."""
    return table(spark, sf_dir, "events").where("event_id % 3 <> 0").selectExpr(
        "concat('E', event_id) as region",
        "concat('A', event_id) as area_no",
        "user_id % 149 as nx",
        "user_id % 253 as ny",
        "33.0D + user_id % 6 as latitude",
        "124.0D + user_id % 8 as longitude",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log text with one call line per event and some other lines."""
    return events(spark, sf_dir).select(
        F.expr(
            """if(event_id % 11 = 0, concat('noise ', event_id),
                 concat('INFO api_call api=', event_type,
                        ' status=', case when k < 3 then 'EXC' when k < 10 then '500' else '200' end,
                        ' duration_ms=', (event_id * 37) % 4001))"""
        ).alias("value")
    )
