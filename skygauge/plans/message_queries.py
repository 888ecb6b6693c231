"""Queries on graded messages: grading, groups, severity, signatures, missing values, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions import render
from skygauge.functions.grading import (
    action_groups,
    band_table,
    core_missing,
    grade_by_table,
    grades_long,
    missing_count,
    missing_names,
    severity,
    severity_of_groups,
    signature,
)
from skygauge.functions.scalars import event_id, kst_of_utc, month_key
from skygauge.operators.merge import completeness
from skygauge.operators.monitor import bad_days
from skygauge.plans import sql, views
from skygauge.plans.registry import query, table

_GRADES = [f"{i}_grade" for i in fixed.INDICES]
_LONG_SQL = " UNION ALL ".join(
    f"SELECT event_id, ts, stamp, '{i}' AS index_name,"
    f" {'CAST(NULL AS DOUBLE)' if i == 'other_special_notice' else i} AS value, {i}_grade AS grade FROM graded"
    for i in fixed.INDICES
)


@query(
    "grade_wide",
    f"""WITH {sql.GRADED} SELECT event_id, {', '.join(_GRADES)}, pm10_advice, feels_like_temp_advice,
        other_special_notice_advice FROM graded""",
)
def grade_wide(spark, sf_dir):
    return views.graded(spark, sf_dir, advice=True).select(
        "event_id", *_GRADES, "pm10_advice", "feels_like_temp_advice", "other_special_notice_advice"
    )


@query("grade_long", f"WITH {sql.GRADED} SELECT event_id, index_name, value, grade FROM ({_LONG_SQL})")
def grade_long(spark, sf_dir):
    return grades_long(views.graded(spark, sf_dir), ["event_id"])


@query(
    "grade_counts",
    f"WITH {sql.GRADED} SELECT index_name, grade, count(*) AS n FROM ({_LONG_SQL}) GROUP BY index_name, grade",
)
def grade_counts(spark, sf_dir):
    return grade_long(spark, sf_dir).groupBy("index_name", "grade").agg(F.count("*").alias("n"))


_READING = {
    "click": "pm10",
    "view": "pm25",
    "error": "dust",
    "signup": "feels_like_temp",
    "purchase": "precipitation_probability",
}


@query(
    "grade_range_join",
    f"""WITH {sql.EV}, r AS (SELECT event_id, event_type, CASE WHEN k % 10 <> 0 THEN value * 2 - 20 END AS v FROM ev)
    SELECT event_id, CASE event_type {' '.join(f"WHEN '{e}' THEN '{i}'" for e, i in _READING.items())} END AS index_name,
      CASE event_type {' '.join(f"WHEN '{e}' THEN {sql.band_case(i, 'v')}" for e, i in _READING.items())} END AS grade,
      CASE event_type {' '.join(f"WHEN '{e}' THEN {sql.band_case(i, 'v', 2)}" for e, i in _READING.items())} END AS advice
    FROM r""",
)
def grade_range_join(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for pair in _READING.items() for x in pair])
    readings = views.events(spark, sf_dir).select(
        "event_id",
        name[F.col("event_type")].alias("index_name"),
        F.when(F.col("k") % 10 != 0, F.col("value") * 2 - 20).alias("value"),
    )
    return grade_by_table(readings, band_table(spark)).select("event_id", "index_name", "grade", "advice")


@query(
    "action_groups",
    f"""WITH {sql.GRADED} SELECT event_id, {sql.groups(lambda c, a, r: f"'{c}'")} AS groups,
      {sql.groups(lambda c, a, r: f"'{a}'")} AS actions, {sql.groups(lambda c, a, r: r)} AS reasons FROM graded""",
)
def action_groups_query(spark, sf_dir):
    g = views.graded(spark, sf_dir).select("event_id", F.expr(action_groups()).alias("g"))
    return g.select(
        "event_id",
        F.array_join("g.code", "|").alias("groups"),
        F.array_join("g.action", "|").alias("actions"),
        F.array_join(F.transform("g.reasons", lambda r: F.array_join(r, ", ")), "|").alias("reasons"),
    )


@query(
    "action_group_counts",
    f"""WITH {sql.GRADED}, g AS (SELECT unnest(string_split({sql.groups(lambda c, a, r: f"'{c}'")}, '|')) AS group_name FROM graded)
    SELECT group_name, count(*) AS n FROM g GROUP BY group_name""",
)
def action_group_counts(spark, sf_dir):
    return (
        views.graded(spark, sf_dir)
        .select(F.explode(F.expr(action_groups())["code"]).alias("group_name"))
        .groupBy("group_name")
        .agg(F.count("*").alias("n"))
    )


@query(
    "severity",
    f"WITH {sql.GRADED} SELECT event_id, {sql.SEVERITY} AS severity, {sql.SEVERITY} AS severity_from_groups FROM graded",
)
def severity_query(spark, sf_dir):
    coded = views.graded(spark, sf_dir).selectExpr("event_id", f"{severity()} as severity", f"{action_groups()} as g")
    return coded.selectExpr("event_id", "severity", f"{severity_of_groups('g.code')} as severity_from_groups")


@query(
    "severity_history",
    f"WITH {sql.GRADED} SELECT region, {sql.SEVERITY} AS severity, count(*) AS n FROM graded GROUP BY 1, 2",
)
def severity_history(spark, sf_dir):
    return views.graded(spark, sf_dir).groupBy("region", F.expr(severity()).alias("severity")).agg(F.count("*").alias("n"))


@query("grade_signature", f"WITH {sql.GRADED} SELECT event_id, {sql.SIGNATURE} AS signature FROM graded")
def grade_signature(spark, sf_dir):
    return views.graded(spark, sf_dir).select("event_id", F.expr(signature()).alias("signature"))


@query("core_missing", f"WITH {sql.MSG} SELECT event_id, {sql.CORE} AS core_missing FROM msg")
def core_missing_query(spark, sf_dir):
    return views.graded(spark, sf_dir).select("event_id", F.expr(core_missing()).alias("core_missing"))


@query(
    "missing_indices",
    f"WITH {sql.GRADED} SELECT event_id, {sql.missing()} AS missing, {sql.MISSING_COUNT} AS missing_count FROM graded",
)
def missing_indices(spark, sf_dir):
    return views.graded(spark, sf_dir).select(
        "event_id", F.array_join(F.expr(missing_names()), "|").alias("missing"), F.expr(missing_count()).alias("missing_count")
    )


@query(
    "missing_by_index",
    f"WITH {sql.GRADED} SELECT index_name, count(*) AS n FROM ({_LONG_SQL}) WHERE grade = 'UNKNOWN' GROUP BY index_name",
)
def missing_by_index(spark, sf_dir):
    return (
        views.graded(spark, sf_dir)
        .select(F.explode(F.expr(missing_names())).alias("index_name"))
        .groupBy("index_name")
        .agg(F.count("*").alias("n"))
    )


_CONTRACT_SQL = ["dust" if i == "yellow_dust" else i for i in fixed.CONTRACT_INDICES]
_HAS = {
    i: "other_special_notice <> '정보없음'" if i == "other_special_notice" else f"{c} IS NOT NULL"
    for i, c in zip(fixed.CONTRACT_INDICES, _CONTRACT_SQL)
}
_COLLECTED = " + ".join(f"CAST({h} AS INTEGER)" for h in _HAS.values())


@query(
    "completeness",
    f"""WITH {sql.MSG} SELECT event_id, {_COLLECTED} AS collected,
      concat_ws('|', {', '.join(f"CASE WHEN NOT ({h}) THEN '{i}' END" for i, h in _HAS.items())}) AS missing,
      {_COLLECTED} >= 3 AS publishable FROM msg""",
)
def completeness_query(spark, sf_dir):
    return completeness(views.messages(spark, sf_dir), minimum=3).select(
        "event_id", "collected", F.array_join("missing", "|").alias("missing"), "publishable"
    )


@query(
    "event_id",
    f"""WITH {sql.EV} SELECT event_id AS source_id, region || ':' || strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H') AS event_id FROM ev
    UNION ALL SELECT o_orderkey, 'O' || (o_custkey % 17) || ':' || strftime(o_orderdate + INTERVAL 9 HOUR, '%Y%m%d%H') FROM orders""",
)
def event_id_query(spark, sf_dir):
    from_events = views.events(spark, sf_dir).select(
        F.col("event_id").alias("source_id"), event_id(F.col("region"), kst_of_utc(F.col("ts"))).alias("event_id")
    )
    region = F.concat(F.lit("O"), (F.col("o_custkey") % 17).cast("string"))
    from_orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_id"), event_id(region, kst_of_utc(F.col("o_orderdate"))).alias("event_id")
    )
    return from_events.unionByName(from_orders)


@query(
    "bad_days",
    f"""WITH {sql.GRADED} SELECT replace(substr(stamp, 1, 7), '-', '.') AS month, index_name,
      count(DISTINCT substr(stamp, 1, 10)) AS bad_days, count(*) AS bad_messages
      FROM ({_LONG_SQL}) WHERE grade IN ('BAD', 'VERY_BAD') GROUP BY 1, 2""",
)
def bad_days_query(spark, sf_dir):
    stamp = F.col("timestamp")
    rows = grades_long(views.graded(spark, sf_dir), ["timestamp"])
    return bad_days(rows.select(month_key(stamp).alias("month"), F.substring(stamp, 1, 10).alias("day"), "index_name", "grade"))


@query(
    "history_months",
    f"""WITH {sql.GRADED}, h AS (SELECT replace(substr(stamp, 1, 7), '-', '.') AS month, {sql.SEVERITY} AS severity FROM graded)
    SELECT month, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS critical FROM h GROUP BY month""",
)
def history_months(spark, sf_dir):
    return (
        views.graded(spark, sf_dir)
        .groupBy(month_key(F.col("timestamp")).alias("month"))
        .agg(F.count("*").alias("n"), F.count(F.when(F.expr(severity()) == "CRITICAL", True)).alias("critical"))
    )


# -- texts ----------------------------------------------------------------------------------------


def _shown(index: str) -> str:
    unit = next(u for i, _, u in fixed.DISPLAY_ROWS if i == index)
    if index == "other_special_notice":
        return f"coalesce(nullif({index}, ''), '정보없음')"
    return (
        f"coalesce(regexp_replace(printf('%.1f', {sql.rounded(index)}), '\\.0$', '') || '{unit}', '정보없음')"
    )


def _alerts(spark, sf_dir):
    hour = F.hour("slot")
    alerts = (
        views.graded(spark, sf_dir, advice=True)
        .withColumn("action_groups", F.expr(action_groups()))
        .withColumn("forecast_type", F.when(hour == 0, "daily_full_forecast").when(hour == 6, "morning_mixed").when(hour == 12, "current_conditions").otherwise("other"))
        .withColumn("min_temperature", F.when(hour == 0, F.col("feels_like_temp") - 2))
        .withColumn("max_temperature", F.when(hour == 0, F.col("feels_like_temp") + 5))
        .withColumn(
            "data_warnings",
            F.when(F.col("pm10").isNull(), F.create_map(F.lit("air_quality"), F.lit("<denied> & more"))),
        )
    )
    return render.prepare(alerts)


@query(
    "display_rows",
    f"WITH {sql.GRADED} "
    + " UNION ALL ".join(
        f"SELECT event_id, {p} AS position, '{i}' AS index_name, '{name}' AS label, {_shown(i)} AS value,"
        f" {sql.labelled(i)} AS grade, {i}_advice AS advice FROM graded"
        for p, (i, name, _) in enumerate(fixed.DISPLAY_ROWS)
    ),
)
def display_rows(spark, sf_dir):
    return render.display_rows(_alerts(spark, sf_dir), ["event_id"])


def _risk_list(codes: str) -> str:
    lines = ", ".join(
        f"CASE WHEN {i}_grade IN ({codes}) THEN '- {n} ' || {_shown(i)} || ': ' || {sql.labelled(i)} END"
        for i, n, _ in fixed.DISPLAY_ROWS
    )
    return f"list_filter([{lines}], lambda x: x IS NOT NULL)[1:3]"


_BAD_LINES, _NORMAL_LINES = _risk_list("'BAD', 'VERY_BAD'"), _risk_list("'NORMAL'")
_RISKS = (
    f"CASE WHEN len({_BAD_LINES}) > 0 THEN {_BAD_LINES} WHEN len({_NORMAL_LINES}) > 0 THEN {_NORMAL_LINES}"
    f" ELSE ['{fixed.TEXT_MOSTLY_GOOD}'] END"
)


@query("top_risks", f"WITH {sql.GRADED} SELECT event_id, array_to_string({_RISKS}, '|') AS risks FROM graded")
def top_risks(spark, sf_dir):
    prepared = render.prepare(views.graded(spark, sf_dir))
    return prepared.selectExpr("event_id", f"array_join({render.top_risks()}, '|') as risks")


_TITLE_SQL = (
    "CASE hour(slot) WHEN 0 THEN '오늘 전체 예보 알림' WHEN 6 THEN '오늘 아침 기상 알림'"
    " WHEN 12 THEN '현재 기상 알림' ELSE '오늘 기상 예보 알림' END"
)
_GROUP_ACTIONS_SQL = sql.groups(lambda c, a, r: f"'- {a}'")
_GROUP_CODES_SQL = sql.groups(lambda c, a, r: f"'{c}'")


def _degrees(expr: str) -> str:
    return f"coalesce(regexp_replace(printf('%.1f', {sql.rounded(expr)}), '\\.0$', '') || '℃', '정보없음')"


@query(
    "short_text",
    f"""WITH {sql.GRADED}, a AS (SELECT *, string_split({_GROUP_ACTIONS_SQL}, '|') AS acts FROM graded)
    SELECT event_id, left('[' || region || ' ' || {_TITLE_SQL} || '] ' || substr(stamp, 12, 5) || chr(10) || chr(10) || '행동' || chr(10)
      || array_to_string(acts[1:2], chr(10)) || chr(10) || chr(10) || '위험/주의' || chr(10)
      || array_to_string({_RISKS}, chr(10)) || chr(10) || chr(10) || '나머지' || chr(10)
      || CASE WHEN hour(slot) = 0 AND feels_like_temp IS NOT NULL
              THEN '기온 최저 ' || {_degrees('feels_like_temp - 2')} || ', 최고 ' || {_degrees('feels_like_temp + 5')} || chr(10) ELSE '' END
      || '미세먼지 ' || {sql.labelled('pm10')} || ', 초미세먼지 ' || {sql.labelled('pm25')} || chr(10)
      || '황사 ' || {sql.labelled('dust')} || ', 강수확률 ' || {_shown('precipitation_probability')}
      || ', 자외선 ' || {_shown('uv_index')} || chr(10) || '특보 ' || {_shown('other_special_notice')}, 1000) AS text
    FROM a""",
)
def short_text(spark, sf_dir):
    return _alerts(spark, sf_dir).select("event_id", F.expr(render.short_text()).alias("text"))


@query(
    "webhook_payload",
    f"""WITH {sql.GRADED}, a AS (SELECT *, {_GROUP_CODES_SQL} AS codes,
        {sql.groups(lambda c, a, r: f"'• {c}: {a}'")} AS acts FROM graded)
    SELECT event_id, CASE WHEN codes LIKE '%외출_자제%' THEN '#ff0000' WHEN codes LIKE '%마스크_필수%' THEN '#ff6600' ELSE '#36a64f' END AS color,
      '🌍 ' || region || ' 기상지수 알림' AS title, stamp AS text,
      {' + '.join(f'CAST({i} IS NOT NULL AS INTEGER)' for i, _ in fixed.WEBHOOK_FIELDS)} AS fields,
      CASE WHEN codes = '정상' THEN '✅ 모든 지수가 정상범위입니다.' ELSE replace(acts, '|', chr(10)) END AS actions,
      epoch_us(ts) // 1000000 - 32400 AS sent_at
    FROM a""",
)
def webhook_payload(spark, sf_dir):
    p = _alerts(spark, sf_dir).select("event_id", F.expr(render.webhook_payload()).alias("p"))

    def at(path: str):
        return F.get_json_object("p", f"$.attachments{path}")

    return p.select(
        "event_id",
        at("[0].color").alias("color"),
        at("[0].title").alias("title"),
        at("[0].text").alias("text"),
        F.json_array_length(at("[0].fields")).alias("fields"),
        at("[1].text").alias("actions"),
        at("[0].ts").cast("bigint").alias("sent_at"),
    )


@query("long_text")
def long_text(spark, sf_dir):
    return _alerts(spark, sf_dir).selectExpr(
        "event_id", f"{render.subject()} as subject", f"{render.long_text()} as text", f"{render.long_html()} as html"
    )
