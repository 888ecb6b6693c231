"""Message validation: ordered checks, first failure wins, rejected rows keep their source position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.scalars import evaluate_once, safe_float, utc_suffix
from skygauge.functions.text import any_of, listed, quote
from skygauge.operators.ordered import CHUNK, CHUNK_ROWS, with_chunk

NUMERIC_FIELDS = (
    "oak_pollen",
    "pine_pollen",
    "pm10",
    "pm25",
    "yellow_dust",
    "feels_like_temp",
    "precipitation_probability",
    "uv_index",
    "min_temperature",
    "max_temperature",
)
TEXT_FIELDS = (
    "other_special_notice",
    "forecast_type",
    "forecast_period",
    "forecast_date",
)
EMPTY, NOT_JSON, NOT_OBJECT = "empty value", "invalid json", "not an object"
BAD_VERSION, MISSING_KEYS, BAD_TIME = "unsupported schema_version: ", "missing required keys: ", "bad timestamp"


_BARE = r"ltrim(' \t\n\r', text)"
# All fields are read as text, so that no type can spoil a record; only the version keeps its type.
_FIELDS = ", ".join(
    ["`schema_version`: variant"]
    + [f"`{n}`: string" for n in (*fixed.REQUIRED_KEYS, *NUMERIC_FIELDS, *TEXT_FIELDS, "data_warnings", "_end")]
)
_READ_SCHEMA = f"array<struct<{_FIELDS}>>"


_JSON_NUMBER = r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"


def _is_number(kind: str) -> str:
    return f"({kind} in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith({kind}, 'DECIMAL'))"


def _kind_if_unclear(key: str) -> str:
    """JSON type of a field whose text may be a string or something else; null for plain text.

    A text that is no number, no literal and no list or object can only have been a string. The others
    are rare in these fields, and only for them the record is parsed again with its types.
    """
    text = f"_text_{key}"
    unclear = f"{text} in ('true', 'false') or substring({text}, 1, 1) in ('[', '{{') or {text} rlike {quote(_JSON_NUMBER)}"
    return f"case when {unclear} then schema_of_variant(try_variant_get(try_parse_json(text), '$.{key}', 'variant')) end"


def _falsy(key: str) -> str:
    """Absent, null, false, zero, or an empty string, list or object."""
    kind, text = f"_kind_{key}", f"_text_{key}"
    return (
        f"case when {text} is null or {text} = '' then true when {kind} is null or {kind} = 'STRING' then false"
        f" else {text} in ('false', '[]', '{{}}') or coalesce(try_cast({text} as double) = 0, false) end"
    )


def validate(records: DataFrame) -> DataFrame:
    """`records(topic, partition, offset, key, value BINARY)` plus `text`, `reason` and message fields.

    `reason` is null for a valid message. Numbers follow the missing-value rule: absent or unreadable
    stays null. Narrow throughout, and each step is evaluated once per row.

    A JSON reader stops at the end of the first value. To see that nothing follows the message, it is
    read as the first element of a two-element array whose second element holds the text's own digest:
    anything after the message breaks the array, lengthens it or hides the digest.
    """
    raw_text = "cast(value as string)"
    named = evaluate_once(
        records,
        {"text": f"make_valid_utf8({raw_text})", "_utf8": f"is_valid_utf8({raw_text})", "_digest": "md5(value)"},
    )
    pair = f"""from_json(concat('[', text, ',{{"_end":"', _digest, '"}}]'), {quote(_READ_SCHEMA)}, map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false'))"""
    read = evaluate_once(named, {"_pair": f"if(startswith({_BARE}, '{{'), {pair}, null)"})
    flat = evaluate_once(
        read,
        {
            "_whole": "coalesce(size(_pair) = 2 and element_at(_pair, -1)._end = _digest, false)",
            "_version_kind": "schema_of_variant(_pair[0].schema_version)",
            "_version": "try_variant_get(_pair[0].schema_version, '$', 'string')",
            **{f"_text_{n}": f"_pair[0].{n}" for n in (*fixed.REQUIRED_KEYS, *TEXT_FIELDS, "data_warnings")},
            "_numbers_text": f"array({listed(f'_pair[0].{n}' for n in NUMERIC_FIELDS)})",
        },
    ).drop("_pair")
    typed = evaluate_once(
        flat,
        {
            **{f"_kind_{k}": _kind_if_unclear(k) for k in fixed.REQUIRED_KEYS},
            "_numbers": f"transform(_numbers_text, x -> {safe_float('x')})",
        },
    )
    version_ok = (
        "case when _version_kind is null or _version_kind = 'VOID' then true"
        " when _version_kind = 'BOOLEAN' then _version = 'true'"
        f" when {_is_number('_version_kind')} then coalesce(try_cast(_version as double) = {fixed.SCHEMA_VERSION}, false)"
        " else false end"
    )
    lacking = f"concat_ws(', ', {listed(f'if({_falsy(k)}, {quote(k)}, null)' for k in fixed.REQUIRED_KEYS)})"
    # Anything not starting as an object is rare; only then is the text checked as JSON of another kind.
    other_json = """coalesce(size(json_object_keys(concat('{"v":', text, ',"', _digest, '":0}'))) = 2, false)"""
    reason = f"""case when value is null then {quote(EMPTY)}
        when not _utf8 then {quote(NOT_JSON)}
        when not startswith({_BARE}, '{{') then if({other_json}, {quote(NOT_OBJECT)}, {quote(NOT_JSON)})
        when not _whole then {quote(NOT_JSON)}
        when not ({version_ok}) then concat({quote(BAD_VERSION)}, coalesce(_version, _version_kind))
        when {any_of(_falsy(k) for k in fixed.REQUIRED_KEYS)} then concat({quote(MISSING_KEYS)}, {lacking})
        when coalesce(_kind_timestamp, 'STRING') <> 'STRING' then {quote(BAD_TIME)} end"""
    fields = {
        "event_id": "_text_event_id",
        "region": "_text_region",
        "timestamp": utc_suffix("_text_timestamp"),
        **{n: f"_numbers[{i}]" for i, n in enumerate(NUMERIC_FIELDS)},
        **{n: f"_text_{n}" for n in TEXT_FIELDS},
        "data_warnings": "from_json(_text_data_warnings, 'map<string,string>')",
    }
    return evaluate_once(typed, {"reason": reason}).selectExpr(
        *[f"`{c}`" for c in records.columns],
        "text",
        "reason",
        *[f"if(reason is null, {c}, null) as {n}" for n, c in fields.items()],
    )


def valid_messages(validated: DataFrame) -> DataFrame:
    return validated.where("reason is null").drop("reason", "text", "value", "key")


def dead_letters(validated: DataFrame, failed_at: Column) -> DataFrame:
    """Rejected records: reason, source position, time and the raw text."""
    return validated.where("reason is not null").select(
        "reason",
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        failed_at.alias("failed_at"),
        F.col("text").alias("raw"),
    )


def commit_positions(outcomes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`outcomes(topic, partition, offset, failed)` to the position each partition may commit.

    Records after the first failure wait; the position is one past the last success before it, null when there is
    none. A partition is cut into chunks of its offsets, and each chunk is summed up alone: its first failure, the last
    record before that, and how many stand before and after it. Chunks combine in order, since only the first one
    with a failure ends what may be committed. The input is read once and nothing is joined to it.
    """
    keys, chunk = ["topic", "partition"], ["topic", "partition", CHUNK]
    rows = with_chunk(outcomes.select(*keys, "offset", "failed"), "offset", chunk_rows)
    first = F.min(F.when(F.col("failed"), F.col("offset"))).over(W.partitionBy(*chunk))
    ready = F.col("_first").isNull() | (F.col("offset") < F.col("_first"))
    sums = rows.withColumn("_first", first).groupBy(*chunk).agg(
        F.first("_first").alias("_first"),
        F.max(F.when(ready, F.col("offset"))).alias("_last"),
        F.count(F.when(ready, True)).alias("_ready"),
        F.count("*").alias("_n"),
    )
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    open_ = F.min("_first").over(before).isNull()
    return (
        sums.withColumn("_open", open_)
        .groupBy(*keys)
        .agg(
            (F.max(F.when(F.col("_open"), F.col("_last"))) + 1).alias("commit"),
            F.min("_first").alias("retry_from"),
            F.coalesce(F.sum(F.when(F.col("_open"), F.col("_ready"))), F.lit(0)).alias("processed"),
            F.sum(F.when(F.col("_open"), F.col("_n") - F.col("_ready")).otherwise(F.col("_n"))).alias("waiting"),
        )
    )
