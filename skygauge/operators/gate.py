"""Send gate: decide per region, in offset order, which graded messages are notified.

The rule is sequential. With `psig` the last recorded signature and `plast` the last delivered time:

    send   = not core_missing and (psig is null or psig <> sig or clock - plast >= silence)
    psig'  = sig   if not send, or delivered, or no channel is enabled
    plast' = clock if send and delivered

Three facts make it parallel without changing one decision:

1. A failed attempt changes nothing and every other row leaves `psig = sig` behind, so `psig` before a
   row is the signature of the latest *marking* row (core missing, delivered or no channel): a carry,
   not a recursion.
2. Rows whose signature differs are sent regardless of time. The delivered ones ("anchors") reset
   `plast`, so the rest of the recursion lives inside one run between anchors.
3. Inside a run `plast` only grows, by at least `silence` a step. Rows less than `silence` after their
   anchor are settled at once; the others form a chain "first delivered row at least `silence` after
   the last one". Short runs are folded row by row in the JVM; runs above `fold_rows` build next
   pointers and follow them by doubling, so no task ever walks a long run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.operators.ordered import CHUNK_ROWS, carry, cut_lineage, next_at_least, with_chunk

FOLD_ROWS = 20_000
RUN = ["region", "_run"]


def send_gate(
    rows: DataFrame,
    silence_seconds: float | None = fixed.MAX_SILENCE_SECONDS,
    state: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Add `send`, `reason`, `recorded` to each row.

    `rows(region, offset, clock, signature, core_missing, delivered, enabled)` with (region, offset)
    unique; `delivered` says whether a channel succeeds when tried, `enabled` whether any channel is
    on. `state(region, signature, last_sent)` is where earlier batches ended. Extra columns pass
    through. Only these narrow columns are shuffled; rejoin wide details on the event id afterwards.
    """
    silence = int(round((silence_seconds or 0) * 1_000_000))
    extra = [c for c in rows.columns if c not in {"region", "offset", "clock", "signature", "core_missing", "delivered", "enabled"}]
    live = rows.select(
        "region", "offset", "clock", "signature", "core_missing", "delivered", "enabled", *extra,
        F.unix_micros(F.col("clock").cast("timestamp")).alias("_at"),
        F.lit(False).alias("_seed"),
        F.when(F.col("core_missing") | F.col("delivered") | ~F.col("enabled"), F.col("signature")).alias("_mark"),
    )
    if state is not None:
        live = live.unionByName(_seed_rows(state, live), allowMissingColumns=True)
    # Rows and chunk summaries are two readings of the input; without the cut each would parse and grade it anew.
    chunked = cut_lineage(with_chunk(live, "offset", chunk_rows))
    classified = cut_lineage(_classify(chunked, silence))
    if not silence:
        return _finish(classified.withColumn("_beat", F.lit(False)), extra)
    heartbeats = _heartbeats(classified.where("_open"), silence, chunk_rows, fold_rows)
    return _finish(classified.join(heartbeats, ["region", "offset"], "left"), extra)


_BEFORE = "over (partition by region, _chunk order by offset rows between unbounded preceding and 1 preceding)"
_CHUNKS_BEFORE = "over (partition by region order by _chunk rows between unbounded preceding and 1 preceding)"


def _classify(rows: DataFrame, silence: int) -> DataFrame:
    """Settle everything but the chains: `_changed`, and `_open` with its `_run` and `_anchor_at`.

    One exchange on (region, chunk). In a chunk all rows after its first marking row are settled
    locally; only that first one (`_tent`) can become an anchor or not depending on what earlier chunks
    carry in, and that is decided on the summary with one row per chunk.
    """
    scanned = (
        rows.selectExpr("*", f"last(_mark, true) {_BEFORE} as _local")
        .selectExpr(
            "*",
            "(_seed and _at is not null) or"
            " (not _seed and not core_missing and delivered and _local is not null and _local <> signature) as _anchor",
            "not _seed and not core_missing and delivered and _local is null as _tent",
        )
        .selectExpr(
            "*",
            *[
                f"last(if({flag}, {value}, null), true) {_BEFORE} as {name}"
                for flag, value, name in (
                    ("_anchor", "offset", "_a_off"),
                    ("_anchor", "_at", "_a_at"),
                    ("_tent", "offset", "_t_off"),
                    ("_tent", "_at", "_t_at"),
                )
            ],
        )
    )
    chunks = (
        scanned.groupBy("region", "_chunk")
        .agg(
            F.expr("max_by(_mark, offset) filter (where _mark is not null) as mark"),
            F.expr("max(offset) filter (where _anchor) as a_off"),
            F.expr("max_by(_at, offset) filter (where _anchor) as a_at"),
            F.expr("max(offset) filter (where _tent) as t_off"),
            F.expr("max_by(_at, offset) filter (where _tent) as t_at"),
            F.expr("max_by(signature, offset) filter (where _tent) as t_sig"),
        )
        .selectExpr("*", f"last(mark, true) {_CHUNKS_BEFORE} as _sig_in")
        .selectExpr("*", "t_off is not null and (_sig_in is null or _sig_in <> t_sig) as _t_real")
        .selectExpr("*", "coalesce(a_off, if(_t_real, t_off, null)) as o", "coalesce(a_at, if(_t_real, t_at, null)) as t")
        .selectExpr(
            "region", "_chunk", "_sig_in", "_t_real",
            f"last(o, true) {_CHUNKS_BEFORE} as _off_in", f"last(t, true) {_CHUNKS_BEFORE} as _at_in",
        )
    )
    kept = [c for c in rows.columns if c != "_mark"]
    return (
        scanned.join(chunks, ["region", "_chunk"], "left")
        .selectExpr(
            *kept,
            "coalesce(_local, _sig_in) as _psig",
            "coalesce(_a_off, if(_t_real, _t_off, null), _off_in) as _run",
            "coalesce(_a_at, if(_t_real, _t_at, null), _at_in) as _anchor_at",
        )
        .where("not _seed")
        .selectExpr("*", "not core_missing and (_psig is null or _psig <> signature) as _changed")
        # A row already `silence` past its anchor, with an unchanged signature, depends on the chain.
        .selectExpr("*", f"coalesce(not core_missing and not _changed and _at - _anchor_at >= {silence}, false) as _open")
        .drop("_seed", "_psig")
    )


def _seed_rows(state: DataFrame, live: DataFrame) -> DataFrame:
    """Earlier state as one row per region ahead of every offset."""
    return state.select(
        "region",
        F.lit(-1).cast(live.schema["offset"].dataType).alias("offset"),
        F.lit(False).alias("core_missing"),
        F.lit(False).alias("delivered"),
        F.lit(True).alias("enabled"),
        F.unix_micros(F.col("last_sent").cast("timestamp")).alias("_at"),
        F.lit(True).alias("_seed"),
        F.col("signature").alias("_mark"),
    )


def _finish(rows: DataFrame, extra: list[str]) -> DataFrame:
    decided = rows.withColumn("send", F.col("_changed") | F.coalesce(F.col("_beat"), F.lit(False)))
    reason = (
        "case when core_missing then 'core_missing' when _changed then 'change'"
        " when send then 'heartbeat' else 'suppressed' end as reason"
    )
    return decided.selectExpr(
        "region", "offset", "clock", "signature", "core_missing", "delivered", "enabled", *extra, "send", reason,
        "not send or not enabled or delivered as recorded",
    )


def recorded(attempted: Column, enabled: Column, delivered: Column) -> Column:
    """A grade counts as told unless an attempt on enabled channels failed on all of them."""
    return ~attempted | ~enabled | delivered


def _heartbeats(open_rows: DataFrame, silence: int, chunk_rows: int, fold_rows: int) -> DataFrame:
    """`(region, offset, _beat)` for the open rows that are sent."""
    narrow = open_rows.select(*RUN, "offset", "_at", "_anchor_at", "delivered")
    sizes = narrow.groupBy(*RUN).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).head()[0] or 0) <= fold_rows:
        return _fold_runs(narrow, silence)
    tagged = narrow.join(sizes.where(F.col("_n") > fold_rows).select(*RUN, F.lit(True).alias("_long")), RUN, "left")
    tagged = cut_lineage(tagged)
    short = _fold_runs(tagged.where("_long is null"), silence)
    return short.unionByName(_follow_runs(tagged.where("_long").drop("_long"), silence, chunk_rows))


def _fold_runs(rows: DataFrame, silence: int) -> DataFrame:
    """Runs of bounded length: one ordered fold per run in the JVM, run by run in parallel."""
    ordered = rows.groupBy(*RUN).agg(
        F.min("_anchor_at").alias("_start"),
        F.sort_array(F.collect_list(F.struct("offset", "_at", "delivered"))).alias("_rows"),
    )
    fold = f"""aggregate(_rows,
        named_struct('at', _start, 'sent', cast(array() as array<bigint>)),
        (s, r) -> if(r._at - s.at >= {silence}L,
                     named_struct('at', if(r.delivered, r._at, s.at), 'sent', array_append(s.sent, r.offset)), s),
        s -> s.sent)"""
    return ordered.selectExpr("region", f"explode({fold}) as offset", "true as _beat")


def _follow_runs(rows: DataFrame, silence: int, chunk_rows: int) -> DataFrame:
    """Runs of any length: find the chain by doubling, then look up the last link before each row."""
    chain = _doubling_chain(rows, silence, chunk_rows)
    marked = rows.join(chain, [*RUN, "offset"], "left").withColumn("_link", F.when(F.col("_picked"), F.col("_at")))
    scanned = carry(marked, RUN, "offset", {"_last": ("last", F.col("_link"))}, chunk_rows)
    due = F.col("_at") - F.coalesce("_last", "_anchor_at") >= silence
    return scanned.where(due).select("region", "offset", F.lit(True).alias("_beat"))


def _doubling_chain(rows: DataFrame, silence: int, chunk_rows: int) -> DataFrame:
    """Chain of runs of any length in about log2(chain length) rounds of joins."""
    peaks = carry(rows.where("delivered"), RUN, "offset", {"_peak": ("max", F.col("_at"))}, chunk_rows)
    # Only a row later than all before it can be the first to pass a limit.
    records = cut_lineage(
        peaks.where(F.col("_peak").isNull() | (F.col("_at") > F.col("_peak"))).select(*RUN, "offset", "_at", "_anchor_at")
    )
    starts = records.select(*RUN, F.col("_anchor_at").alias("at")).distinct()
    nodes = records.select(*RUN, F.col("_at").alias("at"))
    lookups = nodes.unionByName(starts).select(*RUN, (F.col("at") + silence).alias("at"), F.col("at").alias("tag"))
    hops = next_at_least(nodes, lookups, RUN, max(1, silence // 1024))
    step = cut_lineage(hops.where("hit is not null").select(*RUN, F.col("tag").alias("at"), F.col("hit").alias("to")))
    reached = starts
    while True:
        fresh = reached.join(step, [*RUN, "at"]).select(*RUN, F.col("to").alias("at"))
        reached = cut_lineage(reached.unionByName(fresh))
        onward = step.select(*RUN, F.col("at").alias("to"), F.col("to").alias("_to2"))
        step = cut_lineage(step.join(onward, [*RUN, "to"]).select(*RUN, "at", F.col("_to2").alias("to")))
        if step.isEmpty():
            break
    return records.join(reached.withColumnRenamed("at", "_at"), [*RUN, "_at"]).select(
        *RUN, "offset", F.lit(True).alias("_picked")
    )


def signature_changes(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The change rule alone: `rows(region, offset, signature)` plus `previous` and `changed`."""
    out = carry(rows, ["region"], "offset", {"previous": ("last", F.col("signature"))}, chunk_rows)
    return out.withColumn(
        "changed", F.col("previous").isNull() | (F.col("previous") != F.col("signature"))
    ).drop("_chunk")
