"""Merging source feeds to one wide message per region and slot, and the publish gate.

Feeds are stacked and merged by one aggregate on (region, slot): one shuffle for any number of feeds,
with map-side combining, where a chain of joins would need one per feed.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import event_id, mask_secrets
from skygauge.functions.text import present, quote

KEYS = ["region", "slot"]

# Columns each feed may bring; all are one row per (region, slot).
FEED_COLUMNS = {
    "air": {"pm10": "double", "pm25": "double"},
    "dust": {
        "yellow_dust": "double",
        "yellow_dust_advisory": "string",
        "yellow_dust_source": "string",
        "dust_status": "string",
        "dust_message": "string",
    },
    "health": {"oak_pollen": "double", "pine_pollen": "double"},
    "living": {"living_temp": "double", "living_max": "double"},
    "uv": {"uv_index": "double"},
    "pop": {"precipitation_probability": "double"},
    "temp": {"current_temperature": "double", "temperature_source": "string"},
    "notice": {"other_special_notice": "string", "other_special_notice_source": "string"},
    "today": {
        "today_pop": "double",
        "today_min": "double",
        "today_max": "double",
        "today_notice": "string",
        "today_source": "string",
        "today_period": "string",
        "today_date": "string",
    },
}


#: Feeds whose failure the message names; a failed feed has no values, only a text.
NAMED_FAILURES = ("air", "dust", "living", "uv", "today")


def stack_feeds(spine: DataFrame, feeds: Mapping[str, DataFrame], failures: DataFrame | None = None) -> DataFrame:
    """One row per spine key: every feed's columns, `has_<feed>` (it brought data) and `error_<feed>`.

    The outcome of a feed at a key is a value (its row in `feeds`), nothing, or a failure: a row of
    `failures(region, slot, feed, message)`. Outcomes fold in the same single aggregate as the values;
    secrets are masked before that, and of several failures of a feed the first by text is named.
    """
    wanted = {c: t for cols in FEED_COLUMNS.values() for c, t in cols.items()}

    def widened(df: DataFrame, feed: str, error: str = "cast(null as string)") -> DataFrame:
        own = set(df.columns) & set(FEED_COLUMNS.get(feed, ()))
        cols = [c if c in own else f"cast(null as {t}) as {c}" for c, t in wanted.items()]
        return df.selectExpr(*KEYS, f"{feed if feed == '_feed' else quote(feed)} as _feed", f"{error} as _error", *cols)

    parts = [widened(spine, "spine"), *(widened(df, n) for n, df in feeds.items())]
    if failures is not None:
        masked = failures.select(*KEYS, F.col("feed").alias("_feed"), mask_secrets(F.coalesce("message", F.lit(""))).alias("_text"))
        parts.append(widened(masked, "_feed", "_text"))
    brought = "_error is null"
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*KEYS)
        .agg(
            F.expr("max(_feed = 'spine') as _wanted"),
            *[F.expr(f"coalesce(max(_feed = '{n}' and {brought}), false) as has_{n}") for n in FEED_COLUMNS],
            *[F.expr(f"min(if(_feed = '{n}', _error, null)) as error_{n}") for n in NAMED_FAILURES],
            # one row per feed and key, so max is just "the value"
            *[F.max(c).alias(c) for c in wanted],
        )
        .where("_wanted")
        .drop("_wanted")
    )


def _absent(feed: str, otherwise: str) -> str:
    """SQL: what is said of a feed that brought nothing."""
    return f"coalesce(nullif(error_{feed}, ''), {quote(otherwise)})"


def _warnings(entries: Mapping[str, str]) -> str:
    """SQL: MAP of the sources that are absent or replaced, in the given order; entry texts may be null."""
    found = present(f"if({t} is null, null, struct({quote(k)} as key, {t} as value))" for k, t in entries.items())
    return f"map_from_entries({found})"


def _common_warnings(feels: str, replaced: str) -> dict[str, str]:
    return {
        "air_quality": f"if(has_air, null, {_absent('air', fixed.WARN_AIR)})",
        "yellow_dust": f"case when not has_dust then {_absent('dust', fixed.WARN_DUST)} when dust_status = 'unavailable' then dust_message end",
        "living_index": f"if(has_living, null, if({feels} is null, {_absent('living', fixed.WARN_LIVING)}, {quote(replaced)}))",
    }


_UV_WARNING = f"if(has_uv, null, {_absent('uv', fixed.WARN_UV)})"
_TODAY_WARNING = f"if(has_today, null, {_absent('today', fixed.WARN_TODAY)})"
_TODAY_DATE = "coalesce(today_date, date_format(slot, 'yyyyMMdd'))"
_PASSED = {
    c: c
    for c in (
        "oak_pollen",
        "pine_pollen",
        "pm10",
        "pm25",
        "yellow_dust",
        "yellow_dust_advisory",
        "yellow_dust_source",
        "uv_index",
    )
}


def current_columns() -> dict[str, str]:
    """Current conditions: observed temperature, else the living index, with a source label."""
    feels = "coalesce(current_temperature, living_temp)"
    source = (
        "if(current_temperature is not null, coalesce(temperature_source, 'ultra_short_temperature'),"
        " 'living_weather_index')"
    )
    warnings = {
        **_common_warnings(feels, fixed.WARN_LIVING_CURRENT),
        "temperature": f"if(not has_temp and has_living, {quote(fixed.WARN_TEMPERATURE)}, null)",
        "uv_index": _UV_WARNING,
    }
    return {
        **_PASSED,
        "feels_like_temp": feels,
        "feels_like_temp_source": source,
        "other_special_notice": "other_special_notice",
        "other_special_notice_source": "other_special_notice_source",
        "precipitation_probability": "precipitation_probability",
        "forecast_type": "'current_conditions'",
        "forecast_period": "'current'",
        "forecast_date": "cast(null as string)",
        "min_temperature": "cast(null as double)",
        "max_temperature": "cast(null as double)",
        "data_warnings": _warnings(warnings),
    }


def daily_columns() -> dict[str, str]:
    """Whole day: hourly living maximum, else the living value, else today's maximum temperature."""
    living = "coalesce(living_max, living_temp)"
    feels = f"coalesce({living}, today_max)"
    warnings = {
        **_common_warnings(feels, fixed.WARN_LIVING_DAILY),
        "uv_index": _UV_WARNING,
        "today_forecast": _TODAY_WARNING,
    }
    return {
        **_PASSED,
        "feels_like_temp": feels,
        "feels_like_temp_source": f"if({living} is not null, 'living_weather_index_today_max', 'today_max_forecast_temperature')",
        "other_special_notice": f"if(has_today, today_notice, {quote(fixed.NOTICE_UNKNOWN)})",
        "other_special_notice_source": "today_source",
        "precipitation_probability": "today_pop",
        "forecast_type": "'daily_full_forecast'",
        "forecast_period": "coalesce(today_period, 'today_remaining')",
        "forecast_date": _TODAY_DATE,
        "min_temperature": "today_min",
        "max_temperature": "today_max",
        "data_warnings": _warnings(warnings),
    }


def morning_columns() -> dict[str, str]:
    """Current conditions with rain and temperatures taken from today's summary.

    Replaced, not coalesced: an absent summary leaves them missing.
    """
    base = current_columns()
    absent = f"map('today_forecast', {_absent('today', fixed.WARN_TODAY)})"
    warnings = base["data_warnings"]
    return {
        **base,
        "precipitation_probability": "today_pop",
        "forecast_type": "'morning_mixed'",
        "forecast_period": "'today_full_with_current_conditions'",
        "forecast_date": _TODAY_DATE,
        "min_temperature": "today_min",
        "max_temperature": "today_max",
        "data_warnings": f"if(has_today, {warnings}, map_concat({warnings}, {absent}))",
    }


def _project(stacked: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return stacked.selectExpr(*KEYS, *[f"{c} as {n}" for n, c in columns.items()])


def merge_current(stacked: DataFrame) -> DataFrame:
    return _project(stacked, current_columns())


def merge_daily(stacked: DataFrame) -> DataFrame:
    return _project(stacked, daily_columns())


def merge_morning(stacked: DataFrame) -> DataFrame:
    return _project(stacked, morning_columns())


def slot_dispatch(stacked: DataFrame) -> DataFrame:
    """Hour 0 gives the daily message, 6 the morning one, any other hour the current one.

    Chosen column by column in one projection, so the feeds are read and merged once.
    """
    daily, morning, current = daily_columns(), morning_columns(), current_columns()

    def pick(name: str) -> str:
        if daily[name] == morning[name] == current[name]:
            return current[name]
        return f"case hour(slot) when 0 then {daily[name]} when 6 then {morning[name]} else {current[name]} end"

    return _project(stacked, {n: pick(n) for n in current})


# -- contract and publishing ----------------------------------------------------------------------


def _has(index: str) -> str:
    if index == "other_special_notice":
        return f"coalesce({index} not in ('', {quote(fixed.NOTICE_UNKNOWN)}), false)"
    return f"{index} is not null"


def collected_count() -> str:
    """SQL: how many of the nine indices have a value."""
    return " + ".join(f"if({_has(i)}, 1, 0)" for i in fixed.CONTRACT_INDICES)


def missing_contract_indices() -> str:
    """SQL: names of the missing indices in contract order."""
    return present(f"if({_has(i)}, null, {quote(i)})" for i in fixed.CONTRACT_INDICES)


def completeness(messages: DataFrame, minimum: int = 1) -> DataFrame:
    counted = messages.selectExpr("*", f"{collected_count()} as collected", f"{missing_contract_indices()} as missing")
    return counted.withColumn("publishable", F.col("collected") >= minimum)


def publish_gate(messages: DataFrame, minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """(messages to publish, rejected messages): stamped with event id and schema version."""
    checked = completeness(messages, minimum)
    stamped = (
        checked.where("publishable")
        .drop("publishable", "source_details")
        .withColumn("event_id", event_id(F.col("region"), F.col("slot")))
        .withColumn("schema_version", F.lit(fixed.SCHEMA_VERSION))
    )
    return stamped, checked.where("not publishable").select(*KEYS, "collected", "missing")


def require_published(published: DataFrame) -> DataFrame:
    """`published` as it is; when it is read and has no row, the query fails: a run that publishes nothing is no success.

    The count is a one-row side of the same query, so an empty run is noticed where the rows are written.
    """
    none = published.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    raised = none.select(F.raise_error(F.lit("no message was published")).cast("boolean").alias("_raised"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in published.schema]
    return published.unionAll(raised.where("_raised").select(*columns))
