"""From portal payloads to one value per region and slot.

As-of picks and "first in input order" picks are `min_by`/`max_by` aggregates: they combine on the map
side, need no sort or range join, and a region with most of the rows costs one partial result per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import mask_secrets, mean_1dp, safe_float, scaled_units
from skygauge.functions.text import listed, present, quote
from skygauge.operators.ordered import contains_matches

ITEM = "map<string,string>"


# -- payloads -------------------------------------------------------------------------------------


def parsed(payload: Column) -> Column:
    """Text that cannot begin a JSON value is not handed to the parser: each failure there costs an exception."""
    return F.when(payload.rlike(r'^[ \t\n\r\uFEFF]*[\[{"0-9tfn-]'), F.try_parse_json(payload))


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def json_success(doc: Column) -> Column:
    """`response.status` is "00", or `header.resultCode` is "0" or "00"."""
    status = _text(doc, "$.response.status") == "00"
    code = _text(doc, "$.response.header.resultCode").isin("0", "00")
    return F.coalesce(status, F.lit(False)) | F.coalesce(code, F.lit(False))


def json_items(doc: Column) -> Column:
    """ARRAY<MAP> of items for a bare list, `items.item` list, `items.item` object or single object."""
    inner, outer = "$.response.body.items.item", "$.response.body.items"

    single = F.array(F.try_variant_get(doc, inner, ITEM), F.try_variant_get(doc, outer, ITEM))
    return F.coalesce(
        F.try_variant_get(doc, outer, f"array<{ITEM}>"),
        F.try_variant_get(doc, inner, f"array<{ITEM}>"),
        # an object whose `item` is empty text or null is the portals' empty reply, not an item itself
        F.slice(F.filter(single, lambda m: m.isNotNull() & ~F.map_contains_key(m, "item")), 1, 1),
        F.array().cast(f"array<{ITEM}>"),
    )


XML_SCHEMA = (
    "header struct<resultCode:string,resultMsg:string>,"
    f"body struct<items:struct<item:array<{ITEM}>>>"
)


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Adds `error` and `items` to `payloads(.., status_code, payload)`.

    HTTP errors win, then JSON, then XML for text that is not JSON; a reply without the success code
    is an error row with no items.
    """
    out = payloads.withColumn("_doc", parsed(F.col("payload"))).withColumn(
        "_xml",
        F.when(
            F.col("_doc").isNull() & F.ltrim("payload", F.lit(" \t\n\r")).startswith("<"),
            F.from_xml("payload", XML_SCHEMA, {"mode": "PERMISSIVE"}),
        ),
    )
    ok = F.when(F.col("_doc").isNotNull(), json_success(F.col("_doc"))).otherwise(
        F.coalesce(F.col("_xml.header.resultCode").isin("0", "00"), F.lit(False))
    )
    error = (
        F.when(F.col("status_code") >= 400, F.concat(F.lit("http "), F.col("status_code").cast("string")))
        .when(F.col("_doc").isNull() & F.col("_xml").isNull(), F.lit("unreadable"))
        .when(~ok, F.lit("not successful"))
    )
    items = F.when(F.col("_doc").isNotNull(), json_items(F.col("_doc"))).otherwise(
        F.coalesce(F.col("_xml.body.items.item"), F.array().cast(f"array<{ITEM}>"))
    )
    return (
        out.withColumn("error", error)
        .withColumn("items", F.when(F.col("error").isNull(), items).otherwise(F.array().cast(f"array<{ITEM}>")))
        .drop("_doc", "_xml")
    )


def explode_items(parsed_payloads: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per item with its place in the payload (`ord`), which later "first" picks need."""
    # The outer form keeps Catalyst from copying the whole parsing expression into a pre-filter.
    return parsed_payloads.select(*keep, F.posexplode_outer("items").alias("ord", "item")).where("ord is not null")


# -- forecast items -------------------------------------------------------------------------------


def hours(item: str) -> str:
    """SQL: ARRAY<STRUCT<hour, value>> of the readable `hN` entries."""
    hour_key = quote(r"^h\d+$")
    return (
        f"transform(filter(map_entries({item}), e -> e.key rlike {hour_key} and try_cast(substring(e.key, 2) as int) is not null"
        f" and {safe_float('e.value')} is not null),"
        f" e -> named_struct('hour', try_cast(substring(e.key, 2) as int), 'value', {safe_float('e.value')}))"
    )


def forecast_value(item: str, missing_as_zero: bool = False) -> str:
    """SQL: first readable value of an item map: the days in order, then the hours ascending.

    An item with no readable value is missing; `missing_as_zero` gives 0 instead.
    """
    days = listed(safe_float(f"{item}[{quote(k)}]") for k in fixed.DAY_KEYS)
    return f"coalesce({days}, array_min({hours(item)}).value{', 0.0D' if missing_as_zero else ''})"


def base_time(text: str) -> str:
    """SQL: time of a `yyyyMMddHH` text; null if it cannot be read."""
    return f"cast(try_to_timestamp(if({text} rlike '^[0-9]{{10}}$', {text}, null), 'yyyyMMddHH') as timestamp_ntz)"


def hour_in_force(hours: str, base: str, now: str) -> str:
    """SQL: the entry of `hours` that is the latest at or before `now`, else the earliest; none without a base time."""
    past = f"array_max(filter({hours}, h -> try_add({base}, make_dt_interval(0, h.hour)) <= {now}))"
    return f"if({base} is null, null, coalesce({past}, array_min({hours})))"


def given_values(item: str, hourly: bool) -> str:
    """SQL: MAP of the day entries of an item, or of its `hN` entries by rising hour, that are given at all.

    An entry that cannot be read, as `-`, is in the map with null; an absent or empty one is not.
    """
    if hourly:
        found = f"filter(map_entries({item}), e -> e.key rlike {quote(r'^h[0-9]+$')} and e.value <> '')"
        numbered = f"transform({found}, e -> struct(cast(substring(e.key, 2) as double) as hour, e.key as key, {safe_float('e.value')} as value))"
        return f"map_from_entries(transform(array_sort({numbered}), e -> struct(e.key as key, e.value as value)))"
    days = present(
        f"if({item}[{quote(d)}] <> '', struct({quote(d)} as key, {safe_float(f'{item}[{quote(d)}]')} as value), null)"
        for d in fixed.DAY_KEYS
    )
    return f"map_from_entries({days})"


def uv_feed(items: DataFrame, keys: Sequence[str], base: str, now: str) -> DataFrame:
    """One row per item: the hourly value in force at `now`, else the first readable value, and the values given.

    `items(keys, item, base, now)`: `base` is a `yyyyMMddHH` text, `now` a timestamp without zone. The hour is chosen
    inside the row, without exploding it: the latest at or before `now`, else the earliest. A base time that cannot be
    read chooses no hour. An item without a readable value is missing, not 0.
    """
    read = items.selectExpr(
        *keys,
        "item",
        f"{base_time(base)} as _base",
        f"{now} as _now",
        f"{hours('item')} as _hours",
    )
    chosen = read.withColumn("_at", F.expr(hour_in_force("_hours", "_base", "_now")))
    return chosen.selectExpr(
        *keys,
        f"coalesce(_at.value, {forecast_value('item')}) as uv_index",
        "concat('h', _at.hour) as uv_selected_hour",
        "date_format(try_add(_base, make_dt_interval(0, _at.hour)), 'yyyyMMddHH') as uv_selected_time",
        f"{given_values('item', False)} as uv_forecast",
        f"{given_values('item', True)} as uv_hourly_forecast",
    )


def living_feed(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per item: the first readable value (`living_temp`), and the largest hourly one, else the first (`living_max`)."""
    first = forecast_value("item")
    return items.selectExpr(
        *keys,
        f"{first} as living_temp",
        f"coalesce(array_max(transform({hours('item')}, h -> h.value)), {first}) as living_max",
        f"{given_values('item', True)} as living_hourly_forecast",
    )


def hourly_rows(items: DataFrame, keep: Sequence[str], base: str) -> DataFrame:
    """Expand `hN` entries to rows at base time + N hours; a bad base time gives no rows."""
    start = F.to_timestamp_ntz(F.when(F.col(base).rlike(r"^\d{10}$"), F.col(base)), F.lit("yyyyMMddHH"))
    return (
        items.withColumn("_base", start)
        .where("_base is not null")
        .select(*keep, "_base", F.expr(f"inline({hours('item')})"))
        .withColumn("at", F.col("_base") + F.make_dt_interval(hours=F.col("hour")))
        .drop("_base")
    )


def asof_backward(rows: DataFrame, keys: Sequence[str], at: str, value: str, now: Column) -> DataFrame:
    """Latest value at or before `now` per key, else the earliest one."""
    past = F.when(F.col(at) <= now, F.col(at))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.coalesce(F.max_by(F.col(value), past), F.min_by(F.col(value), F.col(at))).alias(value)
    )


def asof_forward(rows: DataFrame, keys: Sequence[str], key: str, value: str, order: str, now_key: Column) -> DataFrame:
    """First row in input order whose time key is not before `now_key`, else the first row.

    `key` and `now_key` are digit keys of one width (`yyyyMMddHHmm`), `value` a number, `order` an
    integer. All picks are numbers, which keeps the aggregate a hash aggregate.
    """
    coming = F.when(F.col(key) >= now_key, F.col(order))
    key_number = F.col(key).try_cast("bigint")

    def pick(column: Column) -> Column:
        none_ahead = F.count(coming) == 0
        return F.when(none_ahead, F.min_by(column, F.col(order))).otherwise(F.min_by(column, coming))

    return rows.groupBy(*keys).agg(
        pick(key_number).cast("string").alias(key), pick(F.col(value)).alias(value)
    )


def observed_else_forecast(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Current temperature: the first T1H observation, else the first T1H forecast.

    `rows(keys, order, kind 'observed'|'forecast', category, obsr_value, fcst_value)`, text values. An
    unreadable first observation stays missing; it does not fall through to the forecast.
    """
    read = rows.selectExpr(
        *keys, order, "if(category = 'T1H', kind, null) as _kind", f"{safe_float('coalesce(obsr_value, fcst_value)')} as _v"
    )
    first = {k: f"min_by(_v, {order}) filter (where _kind = '{k}')" for k in ("observed", "forecast")}
    return read.groupBy(*keys).agg(
        F.expr(f"if(count_if(_kind = 'observed') > 0, {first['observed']}, {first['forecast']}) as current_temperature")
    )


def signal_text(lightning: str, wind: str, rain: str, prefix: str = "") -> str:
    found = listed(
        f"if({cond}, {quote(prefix + text)}, null)"
        for cond, text in (
            (f"{lightning} > 0", fixed.SIGNAL_LIGHTNING),
            (f"{wind} >= 9", fixed.SIGNAL_WIND),
            (rain, fixed.SIGNAL_RAIN),
        )
    )
    return f"coalesce(nullif(concat_ws(', ', {found}), ''), {quote(fixed.NOTICE_NONE)})"


def notice_signals(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First value per category, then the signal text; a key with no items at all is unknown.

    `rows(keys, order, category, fcst_value)`, a key without items has one row with null category.
    """
    # Wrapped in a struct, a first value that is null stays the first value.
    first = [
        F.expr(f"min_by(struct(fcst_value), {order}) filter (where category = '{c}').fcst_value as {c.lower()}")
        for c in ("LGT", "WSD", "PTY", "SKY")
    ]
    text = signal_text("lgt", "wsd", "pty not in ('0', '', 'None')")
    return (
        rows.groupBy(*keys)
        .agg(*first, F.count("category").alias("_n"))
        .selectExpr(
            *keys,
            f"{safe_float('lgt', 0)} as lgt",
            f"{safe_float('wsd', 0)} as wsd",
            "coalesce(pty, '0') as pty",
            "sky",
            "_n",
        )
        .selectExpr(
            *keys, "lgt", "wsd", "pty", "sky", f"if(_n = 0, {quote(fixed.NOTICE_UNKNOWN)}, {text}) as notice"
        )
    )


def _today(rows: DataFrame, now_key: str, include_elapsed: bool) -> DataFrame:
    """Today's rows with the number read once (`_v`) and whether they are still ahead (`_ahead`)."""
    ahead = "true" if include_elapsed else f"fcst_key >= {now_key}"
    return rows.where(f"fcst_date = substring({now_key}, 1, 8)").selectExpr(
        "*", f"{safe_float('fcst_value')} as _v", f"{ahead} as _ahead"
    )


def daily_summary(rows: DataFrame, keys: Sequence[str], now_key: str, include_elapsed: bool = False) -> DataFrame:
    """Representative values of today's forecast rows.

    `rows(keys, now_key, fcst_date, fcst_key, category, fcst_value)`. Only the remaining rows count, or
    all of today's when none remain or `include_elapsed`. Both readings are computed in the same
    single aggregate and the right one is chosen afterwards, so no window or second pass is needed.
    """
    measures = {
        "pop_max": ("max(_v)", "category = 'POP'"),
        "pop_min": ("min(_v)", "category = 'POP'"),
        "tmp_max": ("max(_v)", "category = 'TMP'"),
        "tmp_min": ("min(_v)", "category = 'TMP'"),
        "wsd_max": ("max(_v)", "category = 'WSD'"),
        "lgt_max": ("max(_v)", "category = 'LGT'"),
        # a handful of codes, whatever the number of rows
        "pty": ("collect_set(coalesce(fcst_value, 'None'))", "category = 'PTY'"),
        "start": ("min(fcst_key)", "true"),
        "end": ("max(fcst_key)", "true"),
    }
    both = [
        F.expr(f"{agg} filter (where {cond}{extra}) as {name}_{which}")
        for name, (agg, cond) in measures.items()
        for which, extra in (("all", ""), ("left", " and _ahead"))
    ]
    grouped = _today(rows, now_key, include_elapsed).groupBy(*keys).agg(F.max("_ahead").alias("_any"), *both)
    chosen = grouped.selectExpr(*keys, *[f"if(_any, {n}_left, {n}_all) as {n}" for n in measures])
    filled = chosen.withColumns(
        {"wsd_max": F.expr("coalesce(wsd_max, 0.0D)"), "lgt_max": F.expr("coalesce(lgt_max, 0.0D)"), "pty": F.array_sort("pty")}
    )
    rainy = "exists(pty, v -> v not in ('0', '', 'None'))"
    return filled.selectExpr(
        "*",
        f"{signal_text('lgt_max', 'wsd_max', rainy, fixed.TODAY_PREFIX)} as notice",
        f"'{'today_full' if include_elapsed else 'today_remaining'}' as period",
    )


def daily_values(rows: DataFrame, keys: Sequence[str], now_key: str, order: str, include_elapsed: bool = False) -> DataFrame:
    """The POP and TMP values behind a daily summary, one row each in input order.

    Kept as rows rather than arrays, so a key with very many forecasts is never gathered.
    """
    today = _today(rows, now_key, include_elapsed)
    left = today.groupBy(*keys).agg(F.max("_ahead").alias("_any"))
    return (
        today.where("category in ('POP', 'TMP') and _v is not null")
        .join(left, list(keys))
        .where("_ahead or not _any")
        .select(*keys, "category", order, F.col("_v").alias("value"))
    )


# -- air quality ----------------------------------------------------------------------------------


def station_mean(rows: DataFrame, keys: Sequence[str], pollutants: Sequence[str] = fixed.POLLUTANTS, scale: int = 1_000_000) -> DataFrame:
    """Mean per pollutant over stations that report it; `station_count` counts all stations."""
    read = rows.selectExpr(*keys, *[f"{safe_float(p)} as {p}" for p in pollutants])
    sums = [F.expr(f"sum({scaled_units(p, scale)}) as _s_{p}") for p in pollutants]
    # only what enters the sum is counted: `inf`, `nan` and values beyond the decimal are no readings
    counts = [F.expr(f"count({scaled_units(p, scale)}) as _n_{p}") for p in pollutants]
    grouped = read.groupBy(*keys).agg(F.count("*").alias("station_count"), *sums, *counts)
    return grouped.selectExpr(
        *keys, "station_count", *[f"{mean_1dp(f'_s_{p}', scale, f'_n_{p}')} as {p}" for p in pollutants]
    )


def mean_of_items(items: str, field: str, scale: int = 1_000_000) -> str:
    """SQL: what `station_mean` gives for one field, over the items of one reply."""
    units = scaled_units(safe_float(f"i[{quote(field)}]"), scale)
    start = "named_struct('s', cast(0 as decimal(30,0)), 'n', 0L)"
    added = "named_struct('s', cast(a.s + u as decimal(30,0)), 'n', a.n + 1)"
    read = f"filter(transform({items}, i -> {units}), u -> u is not null)"
    return f"aggregate({read}, {start}, (a, u) -> {added}, a -> {mean_1dp('a.s', scale, 'a.n')})"


def advisory_match(regions: DataFrame, advisories: DataFrame, today: str, failures: DataFrame | None = None) -> DataFrame:
    """Yellow-dust state per region from advisory rows whose area contains the region name.

    `regions(region)`, `advisories(ord, area, data_time, count)`. The first match decides: issued
    today gives 500.0, an earlier one 0.0; a region with no match is 0.0.

    `failures(message)` has the calls of this source that failed. If it has any and there are no
    advisories, nothing is known: value and advisory are null, `dust_status` is `unavailable` and
    `dust_message` the first failure's text, masked. An outage never reads as "none".
    """
    pairs = contains_matches(advisories, "ord", "area", regions, "region")
    first = pairs.groupBy("region").agg(F.min("ord").alias("ord"))
    hit = first.join(advisories.select("ord", "area", "data_time"), "ord", "left")
    message = F.lit(None).cast("string")
    if failures is not None:
        said = failures.agg(F.min(F.coalesce("message", F.lit(""))).alias("message")).scalar()
        message = F.when(advisories.agg(F.count(F.lit(1))).scalar() == 0, mask_secrets(said))
    found = regions.select("region").distinct().join(hit, "region", "left").withColumn("dust_message", message)
    issued = F.coalesce(F.substring("data_time", 1, 8) == today, F.lit(False))
    known = F.col("dust_message").isNull()

    def state(of_today: object, otherwise: object) -> Column:
        return F.when(known, F.when(issued, F.lit(of_today)).otherwise(F.lit(otherwise)))

    return found.select(
        "region",
        state(fixed.ADVISORY_ISSUED, fixed.ADVISORY_NONE).alias("yellow_dust_advisory"),
        state(fixed.ADVISORY_DUST, fixed.ADVISORY_CLEAR).alias("yellow_dust"),
        F.when(known, F.lit("ylwsnd_advisory")).otherwise("ylwsnd_advisory_unavailable").alias("yellow_dust_source"),
        F.col("area").alias("matched_area"),
        F.col("data_time").alias("matched_time"),
        F.when(~known, F.lit("unavailable")).alias("dust_status"),
        "dust_message",
    )


def pollen_merge(kinds: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Per-kind values side by side and `pollen_risk`, the largest one present.

    `kinds[name](keys, value)` with one row per key. One union and one aggregate instead of a chain of
    full outer joins.
    """
    stacked = None
    for name, df in kinds.items():
        part = df.select(*keys, F.lit(name).alias("_kind"), "value")
        stacked = part if stacked is None else stacked.unionByName(part)
    return (
        stacked.groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_kind") == n, F.col("value"))).alias(n) for n in kinds])
        .withColumn("pollen_risk", F.greatest(*kinds) if len(kinds) > 1 else F.col(next(iter(kinds))))
    )
