"""The whole chain from portal replies to published messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import event_id
from skygauge.operators import collect, merge
from skygauge.plans import sql, views
from skygauge.plans.registry import query

_UV_FAILED = '{"response":{"header":{"resultCode":"03"}}}'
_NOTICE_UNKNOWN, _NOTICE_NONE = f"'{fixed.NOTICE_UNKNOWN}'", f"'{fixed.NOTICE_NONE}'"


def _text(cases: dict[str, str]) -> str:
    found = ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for text, cond in cases.items())
    return f"coalesce(nullif(concat_ws(', ', {found}), ''), {_NOTICE_NONE})"


_NOW_TEXT = _text({fixed.SIGNAL_LIGHTNING: "k % 10 = 9", fixed.SIGNAL_WIND: "k % 15 >= 9", fixed.SIGNAL_RAIN: "k % 3 <> 0"})
_DAY_TEXT = _text(
    {fixed.TODAY_PREFIX + fixed.SIGNAL_WIND: "k % 12 >= 9", fixed.TODAY_PREFIX + fixed.SIGNAL_RAIN: "k % 2 = 1"}
)


def _warnings(feels: str, replaced: str, *more: str) -> str:
    entries = (
        "CASE WHEN k % 10 = 0 THEN 'air_quality=http 503 busy' END",
        "CASE WHEN k % 5 = 0 THEN 'yellow_dust=http 403 denied serviceKey=***' END",
        f"CASE WHEN k % 6 = 0 THEN 'living_index=' || CASE WHEN {feels} IS NULL THEN 'http 500 oops' ELSE '{replaced}' END END",
        *more,
    )
    return f"concat_ws('|', {', '.join(entries)})"


_UV_WARN = f"CASE k % 8 WHEN 1 THEN 'uv_index=not successful {_UV_FAILED}' WHEN 2 THEN 'uv_index={fixed.WARN_UV}' END"
_TEMP_WARN = f"CASE WHEN cur IS NULL AND living IS NOT NULL THEN 'temperature={fixed.WARN_TEMPERATURE}' END"
_TODAY_WARN = "CASE WHEN NOT today THEN 'today_forecast=unreadable garbage' END"

_SQL = f"""WITH {sql.EV}, x AS (SELECT 'E' || event_id AS region, event_id, user_id, slot, hour(slot) AS h, k, k % 9 <> 2 AS today,
    CASE WHEN k % 3 <> 0 THEN k WHEN k % 13 <> 0 AND k % 4 <> 0 THEN k + 0.5 END::DOUBLE AS cur,
    CASE WHEN k % 6 <> 0 THEN k END::DOUBLE AS living FROM ev),
  f AS (SELECT *, CASE WHEN h = 0 THEN coalesce(living + 3, CASE WHEN today THEN k + 10 END) ELSE coalesce(cur, living) END::DOUBLE AS feels FROM x),
  m AS (SELECT region, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, region || ':' || strftime(slot, '%Y%m%d%H') AS event_id,
    strftime(slot, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS "timestamp", 'current_weather' AS data_type,
    CASE WHEN event_id % 3 <> 0 THEN 'A' || event_id END AS area_no, CASE WHEN event_id % 3 <> 0 THEN user_id % 149 END AS nx,
    CASE WHEN k % 10 <> 0 THEN k + 0.5 END::DOUBLE AS pm10, CASE WHEN k % 10 <> 0 THEN k END::DOUBLE AS pm25,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 <> 0 AND k % 2 = 0 THEN 500.0 ELSE 0.0 END::DOUBLE AS yellow_dust,
    CASE WHEN k % 5 = 0 THEN 'ylwsnd_advisory_unavailable' ELSE 'ylwsnd_advisory' END AS yellow_dust_source,
    CASE WHEN k % 2 = 0 THEN 4 ELSE k % 5 END::DOUBLE AS oak_pollen, CASE WHEN k % 4 <> 3 THEN k % 4 END::DOUBLE AS pine_pollen,
    CASE WHEN k % 8 NOT IN (1, 2) THEN CASE h WHEN 0 THEN k % 3 WHEN 18 THEN k % 11 + 2 ELSE k % 7 + 1 END END::DOUBLE AS uv_index,
    feels AS feels_like_temp,
    CASE WHEN h = 0 THEN CASE WHEN living IS NOT NULL THEN 'living_weather_index_today_max' ELSE 'today_max_forecast_temperature' END
      WHEN cur IS NOT NULL THEN 'T1H' ELSE 'living_weather_index' END AS feels_like_temp_source,
    CASE WHEN h = 0 THEN CASE WHEN today THEN {_DAY_TEXT} ELSE {_NOTICE_UNKNOWN} END
      WHEN k % 13 = 0 THEN {_NOTICE_UNKNOWN} ELSE {_NOW_TEXT} END AS other_special_notice,
    CASE WHEN today THEN CASE h WHEN 12 THEN k % 50 WHEN 18 THEN k % 100 ELSE greatest(k % 100, k % 50) END END::DOUBLE
      AS precipitation_probability,
    CASE WHEN h = 6 THEN 'today_max_forecast_probability' END AS precipitation_probability_source,
    CASE h WHEN 0 THEN CASE WHEN today THEN 'today_full' ELSE 'today_remaining' END
      WHEN 6 THEN 'today_full_with_current_conditions' ELSE 'current' END AS forecast_period,
    CASE WHEN today AND h <= 6 THEN k END::DOUBLE AS min_temperature, CASE WHEN today AND h <= 6 THEN k + 10 END::DOUBLE AS max_temperature,
    CASE h WHEN 0 THEN {_warnings('feels', fixed.WARN_LIVING_DAILY, _UV_WARN, _TODAY_WARN)}
      WHEN 6 THEN {_warnings('feels', fixed.WARN_LIVING_CURRENT, _TEMP_WARN, _UV_WARN, _TODAY_WARN)}
      ELSE {_warnings('feels', fixed.WARN_LIVING_CURRENT, _TEMP_WARN, _UV_WARN)} END AS data_warnings FROM f),
  c AS (SELECT *, {' + '.join(
      f"CAST({i} IS NOT NULL{f' AND {i} <> {_NOTICE_UNKNOWN}' if i == 'other_special_notice' else ''} AS INTEGER)"
      for i in fixed.CONTRACT_INDICES)} AS collected FROM m)
  SELECT * EXCLUDE (event_id), CASE WHEN collected >= 6 THEN event_id END AS event_id FROM c"""


@query("collect_chain", _SQL)
def collect_chain(spark, sf_dir):
    """Every event is a region with its own replies of all sources, in every layout and with every kind of failure."""
    messages = collect.collect(views.replies(spark, sf_dir), views.places(spark, sf_dir))
    checked = merge.completeness(messages, minimum=6)
    both = checked.withColumn("event_id", F.when(F.col("publishable"), event_id(F.col("region"), F.col("slot"))))
    entries = F.transform(F.map_entries("data_warnings"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return both.select(
        "region",
        views.text_time("slot").alias("slot"),
        "event_id",
        "timestamp",
        "data_type",
        "area_no",
        "nx",
        "pm10",
        "pm25",
        "yellow_dust",
        "yellow_dust_source",
        "oak_pollen",
        "pine_pollen",
        "uv_index",
        "feels_like_temp",
        "feels_like_temp_source",
        "other_special_notice",
        "precipitation_probability",
        "precipitation_probability_source",
        "forecast_period",
        "min_temperature",
        "max_temperature",
        F.array_join(entries, "|").alias("data_warnings"),
        "collected",
    )
