"""The collect chain: portal replies to one message per region and slot.

`replies(source, region, slot, status_code, payload)` holds at most one reply per source, region and slot. The sources
are those of `SOURCES`. The replies are read once and each is parsed once: what it says is found inside its row and kept
in a few narrow columns (`readings`), and one aggregate on (region, slot) puts these side by side (`stack_readings`).
Replies that are already partitioned by region, or by region and slot, meet without a shuffle.

Outcomes: a reply that cannot be used is a failure of its feed, with its text (status, start of the body) masked. The
advisory source is the exception of the contract: its failure is the state "unavailable". A reply that is absent is
no failure. Values that cannot be read stay missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import mask_secrets, safe_float
from skygauge.functions.text import listed, quote
from skygauge.operators import ingest, merge

KEYS = merge.KEYS

SOURCES = ("air", "dust", "oak_pollen", "pine_pollen", "living", "uv", "village", "observed", "short")

#: Source of a failed reply -> feed whose warning names it.
FAILURE_OF = {"air": "air", "living": "living", "uv": "uv", "village": "today"}

#: So much of the body of a failed reply is told.
BODY_CHARS = 120

PLACE_COLUMNS = ("area_no", "nx", "ny", "latitude", "longitude")


#: Sources whose reply describes one area in its first item.
_INDEX_SOURCES = ("oak_pollen", "pine_pollen", "living", "uv")


def _by_source(**cases: str) -> str:
    return "case source " + " ".join(f"when {quote(s)} then {text}" for s, text in cases.items()) + " end"


def _category(items: str, name: str) -> str:
    return f"filter({items}, i -> i['category'] = {quote(name)})"


def _first(items: str, field: str) -> str:
    return f"get({items}, 0)[{quote(field)}]"


def _values(name: str) -> str:
    """Readable values of a category among the items of the day."""
    return f"transform({_category('_today', name)}, i -> {safe_float("i['fcstValue']")})"


def readings(replies: DataFrame) -> DataFrame:
    """`source, region, slot` and what the reply says. Narrow; every reply is parsed once.

    | source | `v1` .. `v4` | `found` | `found2` | `notice` |
    | --- | --- | --- | --- | --- |
    | air | pm10, pm25 | any station | | |
    | dust | 500 or 0, null when unavailable | always | | |
    | oak_pollen, pine_pollen, uv | value | any item | | |
    | living | first value, largest hour | any item | | |
    | village | rain ahead; the day's largest rain, least and largest temperature | any rain | that day | of the day |
    | observed | first temperature | | any temperature | |
    | short | first temperature | always | any temperature | now |

    `failure` is the masked text of a reply that cannot be used, for the sources whose failures are told.
    """
    told = F.col("error").isNotNull() & F.col("source").isin("dust", *FAILURE_OF)
    text = F.expr(f"concat_ws(' ', error, substring(payload, 1, {BODY_CHARS}))")
    area = "coalesce(nullif(i['tmArea'], ''), i['issueArea'], '')"
    parsed = (
        ingest.parse_payloads(replies)
        .withColumn("failure", F.when(told, mask_secrets(text)))
        .selectExpr(
            "source",
            *KEYS,
            "error",
            "failure",
            "items",
            "date_format(slot, 'yyyyMMdd') as _day",
            "date_format(slot, 'yyyyMMddHHmm') as _now",
            f"if(source in ({listed(map(quote, _INDEX_SOURCES))}), get(items, 0), null) as _item",
        )
    )
    picked = parsed.selectExpr(
        *("source", *KEYS, "error", "failure", "items", "_day", "_now", "_item"),
        f"if(source = 'village', {_category('items', 'POP')}, null) as _pops",
        "if(source = 'village', filter(items, i -> i['fcstDate'] = _day), null) as _today",
        f"if(source in ('observed', 'short'), {_category('items', 'T1H')}, null) as _temps",
        f"if(source = 'dust', get(filter(items, i -> contains({area}, region)), 0)['dataTime'], null) as _issued",
        f"if(source = 'uv', {ingest.base_time("_item['date']")}, null) as _base",
        f"if(source in ('living', 'uv'), {ingest.hours('_item')}, null) as _hours",
    )
    ahead = "filter(_pops, i -> concat(coalesce(i['fcstDate'], ''), coalesce(i['fcstTime'], '')) >= _now)"
    value = ingest.forecast_value("_item")
    dust = f"if(coalesce(substring(_issued, 1, 8) = _day, false), {fixed.ADVISORY_DUST}D, {fixed.ADVISORY_CLEAR}D)"
    temperature = safe_float("get(transform(_temps, i -> coalesce(i['obsrValue'], i['fcstValue'])), 0)")
    raining = "not in ('0', '', 'None')"
    named = picked.selectExpr(
        *("source", *KEYS, "failure", "items"),
        _by_source(
            air=ingest.mean_of_items("items", "pm10Value"),
            dust=f"if(error is null, {dust}, null)",
            oak_pollen=value,
            pine_pollen=value,
            living=value,
            uv=f"coalesce({ingest.hour_in_force('_hours', '_base', 'cast(slot as timestamp_ntz)')}.value, {value})",
            village=safe_float(f"coalesce(get({ahead}, 0), get(_pops, 0))['fcstValue']"),
            observed=temperature,
            short=temperature,
        )
        + " as v1",
        _by_source(
            air=ingest.mean_of_items("items", "pm25Value"),
            living=f"coalesce(array_max(transform(_hours, h -> h.value)), {value})",
            village=f"array_max({_values('POP')})",
        )
        + " as v2",
        f"if(source = 'village', {_values('TMP')}, null) as _tmp",
        "coalesce(" + _by_source(dust="true", short="true", village="size(_pops) > 0") + ", size(items) > 0) as found",
        "coalesce(size(_today) > 0, size(_temps) > 0, false) as found2",
        _by_source(village=f"array_max({_values('LGT')})", short=safe_float(_first(_category("items", "LGT"), "fcstValue"))) + " as _lgt",
        _by_source(village=f"array_max({_values('WSD')})", short=safe_float(_first(_category("items", "WSD"), "fcstValue"))) + " as _wsd",
        _by_source(
            village=f"exists({_category('_today', 'PTY')}, i -> coalesce(i['fcstValue'], 'None') {raining})",
            short=f"coalesce({_first(_category('items', 'PTY'), 'fcstValue')}, '0') {raining}",
        )
        + " as _rain",
    )
    signals = ("coalesce(_lgt, 0.0D)", "coalesce(_wsd, 0.0D)", "_rain")
    now = f"if(exists(items, i -> i['category'] is not null), {ingest.signal_text(*signals)}, {quote(fixed.NOTICE_UNKNOWN)})"
    return named.selectExpr(
        *("source", *KEYS, "v1", "v2", "found", "found2", "failure"),
        "array_min(_tmp) as v3",
        "array_max(_tmp) as v4",
        _by_source(village=f"if(found2, {ingest.signal_text(*signals, fixed.TODAY_PREFIX)}, null)", short=now) + " as notice",
    )


def stack_readings(found: DataFrame) -> DataFrame:
    """The table `merge.stack_feeds` makes, from `readings`: one row per key, its values, `has_<feed>` and `error_<feed>`."""

    def of(source: str, column: str) -> str:
        return f"max(if(source = {quote(source)}, {column}, null))"

    def has(column: str, *sources: str) -> str:
        return f"coalesce(max(source in ({listed(map(quote, sources))}) and {column}), false)"

    sums = {
        "has_air": has("found", "air"),
        "has_dust": has("found", "dust"),
        "has_health": has("found", "oak_pollen", "pine_pollen"),
        "has_living": has("found", "living"),
        "has_uv": has("found", "uv"),
        "has_pop": has("found", "village"),
        "has_temp": has("found2", "observed", "short"),
        "has_notice": has("found", "short"),
        "has_today": has("found2", "village"),
        **{f"error_{feed}": of(source, "failure") for source, feed in FAILURE_OF.items()},
        "pm10": of("air", "v1"),
        "pm25": of("air", "v2"),
        "yellow_dust": of("dust", "v1"),
        "dust_message": of("dust", "failure"),
        "oak_pollen": of("oak_pollen", "v1"),
        "pine_pollen": of("pine_pollen", "v1"),
        "living_temp": of("living", "v1"),
        "living_max": of("living", "v2"),
        "uv_index": of("uv", "v1"),
        "precipitation_probability": of("village", "v1"),
        "_observed": has("found2", "observed"),
        "_observed_value": of("observed", "v1"),
        "_short_value": of("short", "v1"),
        "other_special_notice": of("short", "notice"),
        "today_pop": of("village", "v2"),
        "today_min": of("village", "v3"),
        "today_max": of("village", "v4"),
        "today_notice": of("village", "notice"),
    }
    # the texts that follow from these are not carried through the aggregate
    issued, none = quote(fixed.ADVISORY_ISSUED), quote(fixed.ADVISORY_NONE)
    unavailable = "dust_message is not null"
    told = {
        "error_dust": "cast(null as string)",
        "yellow_dust_advisory": f"case yellow_dust when {fixed.ADVISORY_DUST}D then {issued} when {fixed.ADVISORY_CLEAR}D then {none} end",
        "yellow_dust_source": f"if(has_dust, if({unavailable}, 'ylwsnd_advisory_unavailable', 'ylwsnd_advisory'), null)",
        "dust_status": f"if({unavailable}, 'unavailable', null)",
        "current_temperature": "if(_observed, _observed_value, _short_value)",
        "temperature_source": "if(has_temp, 'T1H', null)",
        "other_special_notice_source": "if(has_notice, 'ultra_short_forecast', null)",
        "today_source": "if(has_today, 'today_vilage_forecast', null)",
        "today_period": "if(has_today, 'today_full', null)",
        "today_date": "if(has_today, date_format(slot, 'yyyyMMdd'), null)",
    }
    merged = found.groupBy(*KEYS).agg(*[F.expr(f"{text} as {name}") for name, text in sums.items()])
    kept = [*KEYS, *(n for n in sums if not n.startswith("_"))]
    return merged.selectExpr(*kept, *[f"{text} as {name}" for name, text in told.items()])


def collect(replies: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """One contract message per region and slot that has any reply.

    `places(region, area_no, nx, ny, latitude, longitude)` has one row per region; a region without one has null fields.
    """
    messages = merge.slot_dispatch(stack_readings(readings(replies))).withColumns(
        {
            "timestamp": F.expr("concat(date_format(slot, \"yyyy-MM-dd'T'HH:mm:ss\"), '+09:00')"),
            "data_type": F.lit("current_weather"),
            "precipitation_probability_source": F.expr("if(hour(slot) = 6, 'today_max_forecast_probability', null)"),
        }
    )
    if places is None:
        return messages
    return messages.join(places.select("region", *PLACE_COLUMNS), "region", "left")
