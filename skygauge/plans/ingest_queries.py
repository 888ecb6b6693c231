"""Queries on payloads and feeds: parsing, picks, means, merges, slots, masking and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import mask_secrets, safe_float, slot_hour
from skygauge.operators import ingest, merge
from skygauge.plans import sql, views
from skygauge.plans.registry import query, table
from skygauge.sources.topic import publish_records

# -- scalars --------------------------------------------------------------------------------------

_MARKED = {
    0: "'-'",
    1: "''",
    2: "concat(' ', v, ' ')",
    3: "concat(v, 'x')",
    4: "null",
    5: "concat('1_', cast(k as {text}))",
    6: "concat(v, 'd')",
    7: "concat('+', v, 'e1')",
}


def _marked(text_type: str) -> str:
    cases = " ".join(f"when {i} then {t.format(text=text_type)}" for i, t in _MARKED.items())
    return f"case event_id % 9 {cases} else v end"


@query(
    "safe_float",
    f"""WITH {sql.EV}, t AS (SELECT *, printf('%.2f', value) AS v FROM ev), m AS (SELECT event_id, {_marked('varchar')} AS t FROM t)
    SELECT event_id, TRY_CAST(nullif(nullif(trim(t), ''), '-') AS DOUBLE) AS number FROM m""",
)
def safe_float_query(spark, sf_dir):
    t = views.events(spark, sf_dir).withColumn("v", F.format_string("%.2f", "value"))
    return t.withColumn("t", F.expr(_marked("string"))).select("event_id", F.expr(safe_float("t")).alias("number"))


def _slot_sql(column: str, hours, delay: int) -> str:
    shifted = f"({column} - INTERVAL {delay} MINUTE)"
    allowed = f"list_max(list_filter({list(hours)}, lambda h: h <= hour({shifted})))"
    return f"strftime(date_trunc('day', {shifted}) + to_hours(CAST(coalesce({allowed}, {max(hours) - 24}) AS INTEGER)), '%Y%m%d%H')"


@query(
    "base_slot",
    f"""SELECT event_id, {', '.join(f'{_slot_sql("ts", h, d)} AS {n}_slot' for n, (h, d) in fixed.SLOT_RULES.items())} FROM events""",
)
def base_slot(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        *[
            F.date_format(slot_hour(F.col("ts"), hours, delay), "yyyyMMddHH").alias(f"{name}_slot")
            for name, (hours, delay) in fixed.SLOT_RULES.items()
        ],
    )


# The given texts hold none of the usual credential names, but some `token = "..."` assignments.
EXTRA_MASKS = ((r"""(\btoken["']?\s*[:=]\s*["']?)[^\s,&}"']+""", "***", ("token",)),)


def _mask_sql(column: str) -> str:
    out = column
    for pattern, mask, _ in [*fixed.MASK_RULES, *EXTRA_MASKS]:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '\\1{mask}', 'gi')"
    return out


@query("mask_secrets", f"SELECT doc_id, md5({_mask_sql('text')}) AS digest, {_mask_sql('text')} <> text AS masked FROM documents")
def mask_secrets_query(spark, sf_dir):
    masked = mask_secrets(F.col("text"), EXTRA_MASKS)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(masked).alias("digest"), (masked != F.col("text")).alias("masked")
    )


@query(
    "mask_counts",
    f"""SELECT 'documents' AS source, count(*) FILTER ({_mask_sql('text')} <> text) AS masked, count(*) AS n FROM documents
    UNION ALL SELECT 'pages', count(*) FILTER ({_mask_sql('html')} <> html), count(*) FROM pages
    UNION ALL SELECT 'conversations', count(*) FILTER ({_mask_sql('text')} <> text), count(*) FROM conversations""",
)
def mask_counts(spark, sf_dir):
    def texts(name, column):
        return table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(column).alias("t"))

    stacked = (
        texts("documents", "text").unionByName(texts("pages", "html")).unionByName(texts("conversations", "text"))
    )
    changed = mask_secrets(F.col("t"), EXTRA_MASKS) != F.col("t")
    return stacked.groupBy("source").agg(F.count(F.when(changed, True)).alias("masked"), F.count("*").alias("n"))


# -- payloads -------------------------------------------------------------------------------------

_PM10 = "CASE WHEN k % 10 < 2 THEN NULL ELSE CAST(printf('%.2f', value) AS DOUBLE) END"
_FIRST = f"SELECT event_id, 0 AS ord, 'S' || user_id AS station, {_PM10} AS pm10, CAST(k AS DOUBLE) AS pm25 FROM ev"
_SECOND = "SELECT event_id, 1 AS ord, 'T' || user_id AS station, CAST(k AS DOUBLE) AS pm10, CAST(NULL AS DOUBLE) AS pm25 FROM ev"


@query("portal_success", "SELECT event_id, event_id % 7 <> 0 AS success FROM events")
def portal_success(spark, sf_dir):
    return views.payloads(spark, sf_dir).select(
        "event_id", ingest.json_success(ingest.parsed(F.col("payload"))).alias("success")
    )


def _items(payloads):
    rows = ingest.explode_items(ingest.parse_payloads(payloads), ["event_id"])
    return rows.select(
        "event_id",
        "ord",
        F.col("item")["stationName"].alias("station"),
        F.expr(safe_float("item['pm10Value']")).alias("pm10"),
        F.expr(safe_float("item['pm25Value']")).alias("pm25"),
    )


@query(
    "portal_items",
    f"""WITH {sql.EV} {_FIRST} WHERE event_id % 29 <> 0 AND event_id % 7 <> 0 AND event_id % 4 < 3
    UNION ALL {_SECOND} WHERE event_id % 29 <> 0 AND event_id % 7 <> 0 AND event_id % 4 < 2""",
)
def portal_items(spark, sf_dir):
    return _items(views.payloads(spark, sf_dir))


@query(
    "portal_items_xml",
    f"""WITH {sql.EV} {_FIRST} WHERE event_id % 29 <> 0 AND event_id % 7 <> 0
    UNION ALL {_SECOND} WHERE event_id % 29 <> 0 AND event_id % 7 <> 0 AND event_id % 4 < 2""",
)
def portal_items_xml(spark, sf_dir):
    return _items(views.payloads(spark, sf_dir, xml=True))


# -- forecast items -------------------------------------------------------------------------------

_DAY_ITEM = {
    "today": "case when k % 2 = 0 then '' else v end",
    "tomorrow": "case when k % 3 = 0 then '-' else cast(k as string) end",
    "dayaftertomorrow": "case when k % 5 = 0 then null else '7' end",
    "h12": "cast(k as string)",
    "h3": "case when k % 4 = 0 then '-' else cast(k + 1 as string) end",
    "high": "'99'",
}


@query(
    "forecast_first_value",
    f"""WITH {sql.EV} SELECT event_id, CAST(CASE WHEN k % 2 <> 0 THEN CAST(printf('%.2f', value) AS DOUBLE) WHEN k % 3 <> 0 THEN k
      WHEN k % 5 <> 0 THEN 7 WHEN k % 4 <> 0 THEN k + 1 ELSE k END AS DOUBLE) AS value FROM ev""",
)
def forecast_first_value(spark, sf_dir):
    e = views.events(spark, sf_dir).withColumn("v", F.format_string("%.2f", "value"))
    item = F.create_map(*[c for name, text in _DAY_ITEM.items() for c in (F.lit(name), F.expr(text))])
    return e.select("event_id", item.alias("item")).selectExpr("event_id", f"{ingest.forecast_value('item')} as value")


_INDEX_ITEM = {
    "today": "case when k % 2 = 0 then '' else v end",
    "tomorrow": "case when k % 3 = 0 then '-' else cast(k as string) end",
    "h18": "case when k % 3 = 0 then '' else cast(k + 1 as string) end",
    "h6": "v",
    "h0": "case when k % 4 = 0 then '-' else cast(k as string) end",
}
#: What the same item says in SQL: its readable values, and the first of them.
_INDEX_SQL = """ix AS (SELECT *, CAST(printf('%.2f', value) AS DOUBLE) AS v, CASE WHEN k % 4 <> 0 THEN k END AS h0,
      CASE WHEN k % 3 <> 0 THEN k + 1 END AS h18 FROM ev),
    i AS (SELECT *, CASE WHEN k % 2 <> 0 THEN v WHEN k % 3 <> 0 THEN k WHEN h0 IS NOT NULL THEN h0 ELSE v END AS first,
      CASE WHEN k % 11 = 0 THEN NULL WHEN hour(ts) >= 18 AND h18 IS NOT NULL THEN 18 WHEN hour(ts) >= 6 OR h0 IS NULL THEN 6 ELSE 0 END AS h FROM ix)"""


def _index_items(spark, sf_dir):
    """One index reply item per event, issued at midnight; some base times cannot be read."""
    e = views.events(spark, sf_dir).withColumn("v", F.format_string("%.2f", "value"))
    item = F.create_map(*[c for name, text in _INDEX_ITEM.items() for c in (F.lit(name), F.expr(text))])
    return e.select(
        "event_id", "ts", item.alias("item"), F.expr("if(k % 11 = 0, 'soon', date_format(ts, 'yyyyMMdd00'))").alias("base")
    )


@query(
    "uv_feed",
    f"""WITH {sql.EV}, {_INDEX_SQL}
    SELECT event_id, CAST(CASE h WHEN 18 THEN h18 WHEN 6 THEN v WHEN 0 THEN h0 ELSE first END AS DOUBLE) AS uv_index,
      'h' || h AS uv_selected_hour, strftime(ts, '%Y%m%d') || lpad(CAST(h AS VARCHAR), 2, '0') AS uv_selected_time,
      CASE WHEN k % 2 <> 0 THEN v END AS uv_today, CAST(CASE WHEN k % 3 <> 0 THEN k END AS DOUBLE) AS uv_tomorrow,
      CASE WHEN k % 2 <> 0 THEN 'today,' ELSE '' END || 'tomorrow' AS uv_days,
      'h0,h6' || CASE WHEN k % 3 <> 0 THEN ',h18' ELSE '' END AS uv_hours, CAST(h0 AS DOUBLE) AS uv_h0 FROM i""",
)
def uv_feed(spark, sf_dir):
    return ingest.uv_feed(_index_items(spark, sf_dir), ["event_id"], "base", "ts").selectExpr(
        "event_id",
        "uv_index",
        "uv_selected_hour",
        "uv_selected_time",
        "uv_forecast['today'] as uv_today",
        "uv_forecast['tomorrow'] as uv_tomorrow",
        "array_join(map_keys(uv_forecast), ',') as uv_days",
        "array_join(map_keys(uv_hourly_forecast), ',') as uv_hours",
        "uv_hourly_forecast['h0'] as uv_h0",
    )


@query(
    "living_feed",
    f"""WITH {sql.EV}, {_INDEX_SQL} SELECT event_id, CAST(first AS DOUBLE) AS living_temp,
      CAST(greatest(v, h0, h18) AS DOUBLE) AS living_max, CAST(h18 AS DOUBLE) AS living_h18 FROM i""",
)
def living_feed(spark, sf_dir):
    found = ingest.living_feed(_index_items(spark, sf_dir), ["event_id"])
    return found.selectExpr("event_id", "living_temp", "living_max", "living_hourly_forecast['h18'] as living_h18")


@query(
    "asof_backward",
    f"""WITH {sql.EV}, d AS (SELECT region, date_trunc('day', ts) AS day, k % 24 AS h, arg_max(value, event_id) AS v FROM ev GROUP BY 1, 2, 3)
    SELECT region, strftime(day, '%Y%m%d') AS day,
      coalesce(arg_max(v, h) FILTER (h <= 12), arg_min(v, h)) AS value FROM d GROUP BY 1, 2""",
)
def asof_backward(spark, sf_dir):
    """Hourly values per region and day as `hN` entries of one item, picked as of noon."""
    latest = (
        views.events(spark, sf_dir)
        .withColumn("day", F.date_format("ts", "yyyyMMdd"))
        .groupBy("region", "day", (F.col("k") % 24).cast("string").alias("h"))
        .agg(F.max_by("value", "event_id").cast("string").alias("v"))
    )
    items = latest.select(
        "region",
        "day",
        F.concat("day", F.lit("00")).alias("base"),
        F.create_map(F.concat(F.lit("h"), F.col("h")), F.col("v")).alias("item"),
    )
    rows = ingest.hourly_rows(items, ["region", "day"], "base")
    noon = F.to_timestamp_ntz(F.concat(F.col("day"), F.lit("12")), F.lit("yyyyMMddHH"))
    return ingest.asof_backward(rows, ["region", "day"], "at", "value", noon)


@query(
    "asof_forward",
    f"""WITH {sql.EV}, p AS (SELECT *, strftime(ts, '%Y%m%d%H%M') AS key, strftime(slot + INTERVAL 3 HOUR, '%Y%m%d%H%M') AS now_key
        FROM ev WHERE event_type = 'purchase')
    SELECT region, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot,
      coalesce(arg_min(key, event_id) FILTER (key >= now_key), arg_min(key, event_id)) AS fcst_key,
      coalesce(arg_min(value, event_id) FILTER (key >= now_key), arg_min(value, event_id)) AS value
    FROM p GROUP BY region, p.slot""",
)
def asof_forward(spark, sf_dir):
    p = (
        views.events(spark, sf_dir)
        .where("event_type = 'purchase'")
        .select("region", "slot", "event_id", "value", F.date_format("ts", "yyyyMMddHHmm").alias("fcst_key"))
    )
    now_key = F.date_format(F.col("slot") + F.expr("INTERVAL 3 HOURS"), "yyyyMMddHHmm")
    out = ingest.asof_forward(p, ["region", "slot"], "fcst_key", "value", "event_id", now_key)
    return out.withColumn("slot", views.text_time("slot"))


@query(
    "temp_fallback",
    f"""WITH {sql.EV}, t AS (SELECT *, CASE WHEN k % 9 = 0 THEN '-' WHEN event_type = 'signup' AND k % 4 <> 0 THEN printf('%.2f', value)
        ELSE CAST(k AS VARCHAR) END AS v FROM ev WHERE event_type IN ('signup', 'view') AND k % 5 <> 0)
    SELECT region, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot,
      TRY_CAST(nullif(coalesce(arg_min(v, event_id) FILTER (event_type = 'signup'), arg_min(v, event_id) FILTER (event_type = 'view')), '-') AS DOUBLE)
        AS current_temperature
    FROM (SELECT * FROM t UNION ALL SELECT *, NULL AS v FROM ev WHERE event_type IN ('signup', 'view') AND k % 5 = 0) AS u GROUP BY region, u.slot""",
)
def temp_fallback(spark, sf_dir):
    rows = views.events(spark, sf_dir).where("event_type in ('signup', 'view')").select(
        "region",
        "slot",
        "event_id",
        F.expr("if(event_type = 'signup', 'observed', 'forecast')").alias("kind"),
        F.expr("if(k % 5 = 0, 'REH', 'T1H')").alias("category"),
        F.expr("case when event_type = 'signup' and k % 4 <> 0 then if(k % 9 = 0, '-', format_string('%.2f', value)) end").alias("obsr_value"),
        F.expr("if(k % 9 = 0, '-', cast(k as string))").alias("fcst_value"),
    )
    out = ingest.observed_else_forecast(rows, ["region", "slot"], "event_id")
    return out.withColumn("slot", views.text_time("slot"))


_CATEGORY = "case event_type when 'click' then 'LGT' when 'view' then 'WSD' when 'error' then 'PTY' when 'signup' then 'SKY' end"
_SIGNAL_VALUE = (
    "case event_type when 'click' then cast(greatest(k - 60, 0) as {text})"
    " when 'view' then cast(k % 15 as {text}) when 'error' then cast(k % 3 as {text}) else cast(k % 4 as {text}) end"
)


@query(
    "notice_signals",
    f"""WITH {sql.EV}, c AS (SELECT *, {_CATEGORY} AS c, {_SIGNAL_VALUE.format(text='varchar')} AS v FROM ev),
    g AS (SELECT region, slot AS s, coalesce(CAST(arg_min(v, event_id) FILTER (c = 'LGT') AS DOUBLE), 0) AS lgt,
      coalesce(CAST(arg_min(v, event_id) FILTER (c = 'WSD') AS DOUBLE), 0) AS wsd,
      coalesce(arg_min(v, event_id) FILTER (c = 'PTY'), '0') AS pty,
      arg_min(v, event_id) FILTER (c = 'SKY') AS sky, count(c) AS n FROM c GROUP BY region, slot)
    SELECT region, strftime(s, '%Y-%m-%d %H:%M:%S') AS slot, lgt, wsd, pty, sky,
      CASE WHEN n = 0 THEN '정보없음' ELSE coalesce(nullif(concat_ws(', ', CASE WHEN lgt > 0 THEN '낙뢰 가능' END,
        CASE WHEN wsd >= 9 THEN '강풍 가능' END, CASE WHEN pty <> '0' THEN '강수 가능' END), ''), '없음') END AS notice FROM g""",
)
def notice_signals(spark, sf_dir):
    rows = views.events(spark, sf_dir).select(
        "region",
        "slot",
        "event_id",
        F.expr(_CATEGORY).alias("category"),
        F.expr(_SIGNAL_VALUE.format(text="string")).alias("fcst_value"),
    )
    out = ingest.notice_signals(rows, ["region", "slot"], "event_id")
    return out.withColumn("slot", views.text_time("slot"))


_DAY_CATEGORY = (
    "case event_type when 'click' then 'POP' when 'view' then 'TMP' when 'error' then 'WSD'"
    " when 'signup' then 'LGT' else 'PTY' end"
)
_DAY_VALUE = (
    "case event_type when 'click' then {value} when 'view' then {value}"
    " when 'error' then cast(k % 12 as {text}) when 'signup' then cast(case when k < 5 then k else 0 end as {text})"
    " else cast(k % 4 as {text}) end"
)


def _forecast_rows(spark, sf_dir):
    """Forecast rows per region and day; days with an odd last digit are asked at the end of the day."""
    day = F.date_format("ts", "yyyyMMdd")
    return (
        views.events(spark, sf_dir)
        .select(
            "region",
            day.alias("day"),
            "event_id",
            day.alias("fcst_date"),
            F.date_format("ts", "yyyyMMddHHmm").alias("fcst_key"),
            F.expr(_DAY_CATEGORY).alias("category"),
            F.expr(_DAY_VALUE.format(value="format_string('%.2f', value)", text="string")).alias("fcst_value"),
        )
        .withColumn("now_key", F.concat("day", F.when(F.col("day").cast("int") % 2 == 0, "1200").otherwise("2359")))
    )


_DAY_SQL = f"""{sql.EV}, f AS (SELECT region, strftime(ts, '%Y%m%d') AS day, event_id, strftime(ts, '%Y%m%d%H%M') AS key,
    {_DAY_CATEGORY} AS c, {_DAY_VALUE.format(value="printf('%.2f', value)", text='varchar')} AS v,
    strftime(ts, '%Y%m%d') || CASE WHEN day(ts) % 2 = 0 THEN '1200' ELSE '2359' END AS now_key FROM ev),
  a AS (SELECT *, bool_or(key >= now_key) OVER (PARTITION BY region, day) AS some_left FROM f),
  kept AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x FROM a WHERE key >= now_key OR NOT some_left)"""


@query(
    "daily_forecast_summary",
    f"""WITH {_DAY_SQL}, s AS (SELECT region, day, max(x) FILTER (c = 'POP') AS pop_max, min(x) FILTER (c = 'POP') AS pop_min,
      max(x) FILTER (c = 'TMP') AS tmp_max, min(x) FILTER (c = 'TMP') AS tmp_min,
      coalesce(max(x) FILTER (c = 'WSD'), 0) AS wsd_max, coalesce(max(x) FILTER (c = 'LGT'), 0) AS lgt_max,
      coalesce(array_to_string(list_sort(list(DISTINCT v) FILTER (c = 'PTY')), '|'), '') AS pty, min(key) AS start, max(key) AS "end"
      FROM kept GROUP BY region, day)
    SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN lgt_max > 0 THEN '오늘 낙뢰 가능' END, CASE WHEN wsd_max >= 9 THEN '오늘 강풍 가능' END,
      CASE WHEN pty SIMILAR TO '.*[1-3].*' THEN '오늘 강수 가능' END), ''), '없음') AS notice, 'today_remaining' AS period FROM s""",
)
def daily_forecast_summary(spark, sf_dir):
    out = ingest.daily_summary(_forecast_rows(spark, sf_dir), ["region", "day"], "now_key")
    return out.withColumn("pty", F.array_join("pty", "|"))


@query(
    "daily_forecast_values",
    f"WITH {_DAY_SQL} SELECT region, day, c AS category, event_id, x AS value FROM kept WHERE c IN ('POP', 'TMP') AND x IS NOT NULL",
)
def daily_forecast_values(spark, sf_dir):
    return ingest.daily_values(_forecast_rows(spark, sf_dir), ["region", "day"], "now_key", "event_id")


# -- air quality ----------------------------------------------------------------------------------

_MEAN = "CAST(sum(CAST(round({v} * 1000000) AS HUGEINT)) AS DOUBLE) / CAST(count({v}) * 1000000 AS DOUBLE)"


def _mean_sql(column: str) -> str:
    return sql.rounded(_MEAN.format(v=column))


@query(
    "station_mean",
    f"""WITH {sql.EV}, s AS (SELECT region, slot, CASE WHEN k % 10 >= 2 THEN value END AS pm10, CASE WHEN k % 3 <> 0 THEN value / 2 END AS pm25,
        CASE WHEN k % 7 <> 0 THEN k / 1000.0::DOUBLE END AS o3 FROM ev),
    m AS (SELECT region, slot, count(*) AS station_count, {_MEAN.format(v='pm10')} AS a, {_MEAN.format(v='pm25')} AS b, {_MEAN.format(v='o3')} AS c
      FROM s GROUP BY region, slot)
    SELECT region, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, station_count, {sql.rounded('a')} AS pm10, {sql.rounded('b')} AS pm25,
      {sql.rounded('c')} AS o3 FROM m""",
)
def station_mean(spark, sf_dir):
    readings = views.events(spark, sf_dir).select(
        "region",
        "slot",
        F.expr("case k % 10 when 0 then '-' when 1 then '' else cast(value as string) end").alias("pm10"),
        F.expr("if(k % 3 = 0, null, cast(value / 2 as string))").alias("pm25"),
        F.expr("if(k % 7 = 0, '-', cast(k / 1000.0D as string))").alias("o3"),
    )
    out = ingest.station_mean(readings, ["region", "slot"], ("pm10", "pm25", "o3"))
    return out.withColumn("slot", views.text_time("slot"))


_TODAY = "20240115"


@query(
    "advisory_match",
    f"""WITH r AS (SELECT DISTINCT '/' || lang || '/' AS region FROM documents UNION SELECT '/none/'),
    a AS (SELECT page_id AS ord, url AS area, CASE WHEN page_id % 2 = 0 THEN '{_TODAY}' ELSE '20240101' END || '09' AS data_time FROM pages),
    f AS (SELECT region, min(ord) AS ord FROM r JOIN a ON contains(area, region) GROUP BY region)
    SELECT r.region, CASE WHEN left(data_time, 8) = '{_TODAY}' THEN '발생' ELSE '없음' END AS yellow_dust_advisory,
      CASE WHEN left(data_time, 8) = '{_TODAY}' THEN 500.0 ELSE 0.0 END::DOUBLE AS yellow_dust, 'ylwsnd_advisory' AS yellow_dust_source,
      area AS matched_area, data_time AS matched_time
    FROM r LEFT JOIN f USING (region) LEFT JOIN a USING (ord)""",
)
def advisory_match(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "lang", F.lit("/")).alias("region")).distinct()
    regions = named.unionByName(named.limit(1).select(F.lit("/none/").alias("region")))
    advisories = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ord"),
        F.col("url").alias("area"),
        F.concat(F.when(F.col("page_id") % 2 == 0, _TODAY).otherwise("20240101"), F.lit("09")).alias("data_time"),
    )
    return ingest.advisory_match(regions, advisories, _TODAY).drop("dust_status", "dust_message")


@query(
    "advisory_unavailable",
    """SELECT DISTINCT '/' || lang || '/' AS region, CAST(NULL AS VARCHAR) AS yellow_dust_advisory, CAST(NULL AS DOUBLE) AS yellow_dust,
      'ylwsnd_advisory_unavailable' AS yellow_dust_source, 'unavailable' AS dust_status,
      (SELECT min('http ' || (500 + page_id % 4) || ' serviceKey=***') FROM pages) AS dust_message FROM documents""",
)
def advisory_unavailable(spark, sf_dir):
    """Every call of the source failed: each page stands for a reply without items."""
    regions = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "lang", F.lit("/")).alias("region"))
    replies = table(spark, sf_dir, "pages").selectExpr(
        "page_id as ord", "explode(cast(array() as array<string>)) as area", "cast(null as string) as data_time"
    )
    failures = table(spark, sf_dir, "pages").selectExpr("concat('http ', 500 + page_id % 4, ' serviceKey=k', page_id) as message")
    return ingest.advisory_match(regions, replies, _TODAY, failures).drop("matched_area", "matched_time")


@query(
    "advisory_texts",
    "SELECT doc_id, b.text AS passage FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(d.text, b.text)",
)
def advisory_texts(spark, sf_dir):
    """Containment over long texts: which documents contain which of the given passages."""
    from skygauge.operators.ordered import contains_matches

    names = table(spark, sf_dir, "benchmark").select(F.col("text").alias("passage"))
    return contains_matches(table(spark, sf_dir, "documents"), "doc_id", "text", names, "passage")


@query(
    "pollen_risk",
    f"""WITH {sql.EV}, o AS (SELECT region, slot, arg_max(k % 5, event_id)::DOUBLE AS v FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
    p AS (SELECT region, slot, arg_max(k % 4, event_id)::DOUBLE AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT coalesce(o.region, p.region) AS region, strftime(coalesce(o.slot, p.slot), '%Y-%m-%d %H:%M:%S') AS slot,
      o.v AS oak_pollen, p.v AS pine_pollen, greatest(o.v, p.v) AS pollen_risk
    FROM o FULL JOIN p ON o.region = p.region AND o.slot = p.slot""",
)
def pollen_risk(spark, sf_dir):
    def kind(event_type, modulus):
        return (
            views.events(spark, sf_dir)
            .where(F.col("event_type") == event_type)
            .groupBy("region", "slot")
            .agg(F.max_by((F.col("k") % modulus).cast("double"), "event_id").alias("value"))
        )

    out = ingest.pollen_merge({"oak_pollen": kind("click", 5), "pine_pollen": kind("view", 4)}, ["region", "slot"])
    return out.withColumn("slot", views.text_time("slot"))


# -- merges ---------------------------------------------------------------------------------------

_TYPES = ("click", "error", "signup", "purchase", "view")
_LAST = f"""{sql.EV}, w AS (SELECT region, slot, {', '.join(
    f"arg_max(value, event_id) FILTER (event_type = '{t}') AS {t}_v, arg_max(k, event_id) FILTER (event_type = '{t}') AS {t}_k"
    for t in _TYPES)} FROM ev GROUP BY region, slot),
  x AS (SELECT *, coalesce(click_k % 10 <> 0, false) AS has_air, error_k IS NOT NULL AS has_dust,
    coalesce(purchase_k % 4 <> 0, false) AS has_living, coalesce(click_k % 6 <> 0, false) AS has_uv,
    coalesce(error_k % 3 <> 0, false) AS has_temp, coalesce(view_k % 7 <> 0, false) AS has_today,
    CASE WHEN error_k % 3 <> 0 THEN error_v / 2 - 10 END AS cur_temp,
    CASE WHEN purchase_k % 4 <> 0 THEN purchase_v / 2 - 10 END AS living_temp,
    CASE WHEN purchase_k % 4 <> 0 AND purchase_k % 3 <> 0 THEN purchase_v / 2 - 5 END AS living_max,
    CASE WHEN view_k % 7 <> 0 THEN view_v / 4 - 10 END AS today_min, CASE WHEN view_k % 7 <> 0 THEN view_v / 2 END AS today_max,
    CASE WHEN view_k % 7 <> 0 THEN view_k::DOUBLE END AS today_pop,
    CASE WHEN view_k % 7 <> 0 THEN CASE WHEN view_k % 2 = 0 THEN '오늘 강풍 가능' ELSE '없음' END END AS today_notice FROM w)"""
_BASE_SQL = {
    "oak_pollen": "(signup_k % 5)::DOUBLE",
    "pine_pollen": "(signup_k % 4)::DOUBLE",
    "pm10": "CASE WHEN has_air THEN click_v END",
    "pm25": "CASE WHEN has_air AND click_k % 3 <> 0 THEN click_v / 2 END",
    "yellow_dust": "CASE WHEN error_k % 5 = 0 THEN NULL WHEN error_k % 2 = 0 THEN 500.0 WHEN has_dust THEN 0.0 END::DOUBLE",
    "yellow_dust_advisory": "CASE WHEN error_k % 5 = 0 THEN NULL WHEN error_k % 2 = 0 THEN '발생' WHEN has_dust THEN '없음' END",
    "yellow_dust_source": "CASE WHEN error_k % 5 = 0 THEN 'ylwsnd_advisory_unavailable' WHEN has_dust THEN 'ylwsnd_advisory' END",
    "uv_index": "CASE WHEN has_uv THEN (click_k % 13)::DOUBLE END",
}
_CURRENT_FEELS = "coalesce(cur_temp, living_temp)"
_DAILY_FEELS = "coalesce(living_max, living_temp, today_max)"
_SIGNUP_NOTICE = "CASE signup_k % 3 WHEN 0 THEN '강풍 가능' WHEN 1 THEN '없음' WHEN 2 THEN '정보없음' END"
_SLOT_DAY = "strftime(slot, '%Y%m%d')"


def _warnings_sql(feels: str, replaced: str, extra: dict[str, str]) -> str:
    entries = {
        "air_quality": f"CASE WHEN NOT has_air THEN '{fixed.WARN_AIR}' END",
        "yellow_dust": f"CASE WHEN NOT has_dust THEN '{fixed.WARN_DUST}' WHEN error_k % 5 = 0 THEN 'denied' END",
        "living_index": f"CASE WHEN NOT has_living THEN CASE WHEN {feels} IS NULL THEN '{fixed.WARN_LIVING}' ELSE '{replaced}' END END",
        **extra,
    }
    return "concat_ws('|', " + ", ".join(f"'{k}=' || {v}" for k, v in entries.items()) + ")"


_UV_WARN = {"uv_index": f"CASE WHEN NOT has_uv THEN '{fixed.WARN_UV}' END"}
_TODAY_WARN = {"today_forecast": f"CASE WHEN NOT has_today THEN '{fixed.WARN_TODAY}' END"}
_TEMP_WARN = {"temperature": f"CASE WHEN NOT has_temp AND has_living THEN '{fixed.WARN_TEMPERATURE}' END"}
_CURRENT_SQL = {
    **_BASE_SQL,
    "feels_like_temp": _CURRENT_FEELS,
    "feels_like_temp_source": "CASE WHEN cur_temp IS NOT NULL THEN 'T1H' ELSE 'living_weather_index' END",
    "other_special_notice": _SIGNUP_NOTICE,
    "other_special_notice_source": "CASE WHEN signup_k IS NOT NULL THEN 'ultra_short_forecast' END",
    "precipitation_probability": "CASE WHEN view_v > 100 THEN 100.0::DOUBLE ELSE view_v END",
    "forecast_type": "'current_conditions'",
    "forecast_period": "'current'",
    "forecast_date": "CAST(NULL AS VARCHAR)",
    "min_temperature": "CAST(NULL AS DOUBLE)",
    "max_temperature": "CAST(NULL AS DOUBLE)",
    "data_warnings": _warnings_sql(_CURRENT_FEELS, fixed.WARN_LIVING_CURRENT, {**_TEMP_WARN, **_UV_WARN}),
}
_DAILY_SQL = {
    **_BASE_SQL,
    "feels_like_temp": _DAILY_FEELS,
    "feels_like_temp_source": "CASE WHEN coalesce(living_max, living_temp) IS NOT NULL THEN 'living_weather_index_today_max'"
    " ELSE 'today_max_forecast_temperature' END",
    "other_special_notice": "CASE WHEN has_today THEN today_notice ELSE '정보없음' END",
    "other_special_notice_source": "CASE WHEN has_today THEN 'today_vilage_forecast' END",
    "precipitation_probability": "today_pop",
    "forecast_type": "'daily_full_forecast'",
    "forecast_period": "CASE WHEN has_today THEN 'today_full' ELSE 'today_remaining' END",
    "forecast_date": _SLOT_DAY,
    "min_temperature": "today_min",
    "max_temperature": "today_max",
    "data_warnings": _warnings_sql(_DAILY_FEELS, fixed.WARN_LIVING_DAILY, {**_UV_WARN, **_TODAY_WARN}),
}
_MORNING_SQL = {
    **_CURRENT_SQL,
    "precipitation_probability": "today_pop",
    "forecast_type": "'morning_mixed'",
    "forecast_period": "'today_full_with_current_conditions'",
    "forecast_date": _SLOT_DAY,
    "min_temperature": "today_min",
    "max_temperature": "today_max",
    "data_warnings": _warnings_sql(_CURRENT_FEELS, fixed.WARN_LIVING_CURRENT, {**_TEMP_WARN, **_UV_WARN, **_TODAY_WARN}),
}
_DISPATCH_SQL = {
    n: f"CASE hour(slot) WHEN 0 THEN {_DAILY_SQL[n]} WHEN 6 THEN {_MORNING_SQL[n]} ELSE {_CURRENT_SQL[n]} END" for n in _CURRENT_SQL
}


def _merge_sql(columns: dict[str, str]) -> str:
    cols = ", ".join(f"{c} AS {n}" for n, c in columns.items())
    return f"WITH {_LAST} SELECT region, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, {cols} FROM x"


def _stacked(spark, sf_dir):
    return merge.stack_feeds(*views.feeds(spark, sf_dir))


def _flat(messages):
    entries = F.transform(F.map_entries("data_warnings"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return messages.withColumn("data_warnings", F.array_join(entries, "|")).withColumn("slot", views.text_time("slot"))


@query("merge_current", _merge_sql(_CURRENT_SQL))
def merge_current(spark, sf_dir):
    return _flat(merge.merge_current(_stacked(spark, sf_dir)))


@query("merge_daily", _merge_sql(_DAILY_SQL))
def merge_daily(spark, sf_dir):
    return _flat(merge.merge_daily(_stacked(spark, sf_dir)))


@query("merge_morning", _merge_sql(_MORNING_SQL))
def merge_morning(spark, sf_dir):
    return _flat(merge.merge_morning(_stacked(spark, sf_dir)))


def _failed_sql(text: str) -> str:
    """The warnings where failed calls are named."""
    for warning, feed, kind, step in (
        (fixed.WARN_AIR, "air", "click", 10), (fixed.WARN_UV, "uv", "click", 6),
        (fixed.WARN_LIVING, "living", "purchase", 4), (fixed.WARN_TODAY, "today", "view", 7),
    ):
        text = text.replace(f"'{warning}'", f"CASE WHEN {kind}_k % {step} = 0 THEN '{feed} 503 serviceKey=***' ELSE '{warning}' END")
    return text


@query("feed_failures", _merge_sql({**_DISPATCH_SQL, "data_warnings": _failed_sql(_DISPATCH_SQL["data_warnings"])}))
def feed_failures(spark, sf_dir):
    stacked = merge.stack_feeds(*views.feeds(spark, sf_dir), views.feed_failures(spark, sf_dir))
    return _flat(merge.slot_dispatch(stacked))


@query("slot_dispatch", _merge_sql(_DISPATCH_SQL))
def slot_dispatch(spark, sf_dir):
    return _flat(merge.slot_dispatch(_stacked(spark, sf_dir)))


def _collected_sql() -> str:
    has = [
        f"(coalesce(({_DISPATCH_SQL[i]}) NOT IN ('', '정보없음'), false))" if i == "other_special_notice" else f"(({_DISPATCH_SQL[i]}) IS NOT NULL)"
        for i in fixed.CONTRACT_INDICES
    ]
    return " + ".join(f"CAST({h} AS INTEGER)" for h in has)


@query(
    "publish_gate",
    f"""WITH {_LAST} SELECT region, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, {_collected_sql()} AS collected,
      CASE WHEN {_collected_sql()} >= 4 THEN region || ':' || strftime(slot, '%Y%m%d%H') END AS event_id,
      CASE WHEN {_collected_sql()} >= 4 THEN 1 END AS schema_version FROM x""",
)
def publish_gate(spark, sf_dir):
    out, rejected = merge.publish_gate(merge.slot_dispatch(_stacked(spark, sf_dir)), minimum=4)
    both = out.select("region", "slot", "collected", "event_id", "schema_version").unionByName(
        rejected.select("region", "slot", "collected"), allowMissingColumns=True
    )
    return both.withColumn("slot", views.text_time("slot"))


@query(
    "publish_records",
    f"""WITH {sql.MSG} SELECT event_id, region AS record_key, 1 AS schema_version, stamp, pm10, uv_index, other_special_notice FROM msg""",
)
def publish_records_query(spark, sf_dir):
    """Keyed JSON records, read back from their own JSON."""
    m = views.messages(spark, sf_dir).drop("ts", "slot", "msg_offset", "msg_partition").withColumn("schema_version", F.lit(1))
    body = F.col("value").cast("string")

    def number(path, kind):
        return F.get_json_object(body, path).cast(kind)

    return publish_records(m).select(
        F.get_json_object(body, "$.event_id").alias("event_id"),
        F.col("key").cast("string").alias("record_key"),
        number("$.schema_version", "int").alias("schema_version"),
        F.get_json_object(body, "$.timestamp").alias("stamp"),
        number("$.pm10", "double").alias("pm10"),
        number("$.uv_index", "double").alias("uv_index"),
        F.get_json_object(body, "$.other_special_notice").alias("other_special_notice"),
    )
