"""Ordered operators that stay parallel inside one key.

A window `PARTITION BY key ORDER BY offset` puts a whole key into one task. Here a key is cut into
chunks of its order column; each chunk is scanned on its own, one summary row per chunk is carried
forward across the (far smaller) summary table, and the carried value is joined back. A key that
holds most of the rows therefore spreads over many tasks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 18
CHUNK = "_chunk"

#: Spark's setting that removes the shuffle files of a query when it ends, not when the driver collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session (tests) may go without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skygauge-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the reliable checkpoint folder and continue from there.

    What follows reads the checkpoint, so the shuffle files that led to it are removed at once: an iteration of many
    steps keeps the files of one step, not of all.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan reads the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def with_chunk(df: DataFrame, order: str, chunk_rows: int) -> DataFrame:
    """Chunk number of the order column; unique integers per key bound a chunk to `chunk_rows`."""
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(chunk_rows)))


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, tuple[str, Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each row and name, combine an expression over all earlier rows of its key.

    `values` maps an output name to `("last" | "max", expression)`: the last non-null value, or the
    running maximum, over rows with a smaller `order`. Null when there is none.
    """
    rows = df if CHUNK in df.columns else with_chunk(df, order, chunk_rows)
    keys = list(keys)
    before = W.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    chunks_before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)

    def over(kind: str, expr: Column, window) -> Column:
        return (F.last(expr, ignorenulls=True) if kind == "last" else F.max(expr)).over(window)

    def tail(kind: str, expr: Column) -> Column:
        if kind == "max":
            return F.max(expr)
        return F.max_by(expr, F.when(expr.isNotNull(), F.col(order)))

    scanned = rows.withColumns({f"_in_{n}": over(k, e, before) for n, (k, e) in values.items()})
    tails = rows.groupBy(*keys, CHUNK).agg(*[tail(k, e).alias(f"_t_{n}") for n, (k, e) in values.items()])
    carried = tails.select(
        *keys, CHUNK, *[over(k, F.col(f"_t_{n}"), chunks_before).alias(f"_out_{n}") for n, (k, _) in values.items()]
    )
    joined = scanned.join(carried, [*keys, CHUNK], "left")

    def merged(name: str, kind: str) -> Column:
        inside, outside = F.col(f"_in_{name}"), F.col(f"_out_{name}")
        return F.coalesce(inside, outside) if kind == "last" else F.greatest(inside, outside)

    return joined.withColumns({n: merged(n, k) for n, (k, _) in values.items()}).drop(
        *[f"{p}{n}" for n in values for p in ("_in_", "_out_")]
    )


def next_at_least(points: DataFrame, lookups: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """As-of join forward: for each lookup the smallest point of its key that is >= the lookup.

    `points(keys, at)` and `lookups(keys, at, tag)`, integer `at`. Both are cut into cells of width
    `cell`; inside a cell one descending scan answers every lookup, and a lookup with no point left
    in its cell takes the first point of the next occupied cell. No range join, no pair expansion.
    Returns `keys, at, tag, hit`.
    """
    keys = list(keys)
    both = (
        points.select(*keys, "at", F.col("at").alias("_point"), F.lit(None).cast("bigint").alias("tag"))
        .unionByName(lookups.select(*keys, "at", F.lit(None).cast("bigint").alias("_point"), "tag"))
        .withColumn("_cell", F.floor(F.col("at") / F.lit(cell)))
    )
    # Descending, points before lookups at the same `at`: the last point seen is the nearest one.
    seen = W.partitionBy(*keys, "_cell").orderBy(F.desc("at"), F.col("_point").isNull()).rowsBetween(
        W.unboundedPreceding, 0
    )
    heads = both.groupBy(*keys, "_cell").agg(F.min("_point").alias("_head"))
    after = W.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)
    later = heads.select(*keys, "_cell", F.last("_head", ignorenulls=True).over(after).alias("_later"))
    return (
        both.withColumn("_here", F.last("_point", ignorenulls=True).over(seen))
        .where("_point is null")
        .join(later, [*keys, "_cell"], "left")
        .select(*keys, "at", "tag", F.coalesce("_here", "_later").alias("hit"))
    )


#: Buckets of a power of two in the first step of the selection, and buckets of each of those in the second.
LEADING, FURTHER = 1 << 10, 1 << 20
_ENDLESS = 1 << 32


def _radix(value: str) -> tuple[Column, Column]:
    """Leading and further digits of a double, as two whole numbers that keep its order.

    The power of two and ten bits of the mantissa lead, the next twenty bits follow. Where the logarithm rounds to the
    neighbouring power, the mantissa leaves [1, 2) by as little and lands in the same bucket. Infinite values and NaN
    (after all others, as Spark orders it) have buckets of their own.
    """
    size = f"abs({value})"
    plain = f"({size} > 0 and {size} < double('infinity'))"
    power = f"floor(log2(if({plain}, {size}, 1D)))"
    cells = f"((if({plain}, {size}, 1D) / pow(2D, {power}) - 1D) * {LEADING})"
    lead = f"if({plain}, ({power} + 1100) * {LEADING} + floor({cells}) + 1, if({value} = 0, 0L, {_ENDLESS}L))"
    rest = f"if({plain}, floor(({cells} - floor({cells})) * {FURTHER}), 0L)"
    flip = f"if({value} < 0, -1L, 1L)"
    return F.expr(f"if(isnan({value}), {2 * _ENDLESS}L, {flip} * ({lead}))"), F.expr(f"if(isnan({value}), 0L, {flip} * {rest})")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """Exact order statistics per key by radix selection, without ordering or collecting a key anywhere.

    `ranks` maps an output name to the zero-based lower and upper row index as expressions over
    `n` (the number of non-null values of the key); the result column is the struct `(lo, hi)` of the
    values at these positions. Equal values are counted first, on the map side, and that histogram is
    written once. A first pass over it sums counts by the leading digits of the values; a second one reads
    only the buckets that hold a wanted position and sums them by further digits. What is left shares
    thirty bits and its power of two, which a few million different doubles do at most, whatever the data.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = cut_lineage(counted.groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    lead, rest = _radix("_v")
    digits = counted.withColumn("_lead", lead)
    positions = F.array(*[p.cast("bigint") for pair in ranks.values() for p in pair])

    def holding(cells: DataFrame, within: list[str], cell: str) -> DataFrame:
        """The cells that hold a wanted position, each with the number of values before it (`_start`)."""
        sums = cells.groupBy(*within, cell, *(["n", "_base"] if "n" in cells.columns else [])).agg(F.sum("_c").alias("_sum"))
        if "n" not in cells.columns:
            sums = sums.withColumns({"n": F.sum("_sum").over(W.partitionBy(*within)), "_base": F.lit(0).cast("bigint")})
        earlier = W.partitionBy(*within).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
        starts = sums.withColumn("_start", F.col("_base") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        wanted = starts.withColumn("_pos", positions).where("exists(_pos, p -> p >= _start and p < _start + _sum)")
        return wanted.select(*within, cell, "n", F.col("_start").alias("_base"))

    leading = holding(digits, keys, "_lead")
    inside = cut_lineage(digits.join(leading, [*keys, "_lead"]).withColumn("_rest", rest))
    last = holding(inside, [*keys, "_lead"], "_rest")
    few = inside.drop("n", "_base").join(last, [*keys, "_lead", "_rest"])
    earlier = W.partitionBy(*keys, "_lead", "_rest").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = few.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))

    def at(position: Column) -> Column:
        p = position.cast("bigint")
        return F.max(F.when((p >= F.col("_from")) & (p < F.col("_from") + F.col("_c")), F.col("_v")))

    return placed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.struct(at(lo).alias("lo"), at(hi).alias("hi")).alias(name) for name, (lo, hi) in ranks.items()],
    )


def interpolated(pair: Column, n: Column, q: float) -> Column:
    """Linear interpolation between the two order statistics around position q*(n-1)."""
    position = F.lit(q) * (n - 1)
    part = position - F.floor(position)
    return pair["lo"] + (pair["hi"] - pair["lo"]) * part


def rank_pair(q: float, n: Column) -> tuple[Column, Column]:
    position = F.lit(q) * (n - 1)
    return F.floor(position), F.ceil(position)


MAX_BLOCK = 32


def contains_matches(areas: DataFrame, area_id: str, area: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs (area_id, name) where the area text contains the name, without pairing all with all.

    A text is cut once into aligned blocks of q characters, and a name of at least 2q - 1 characters
    offers its q-grams at the offsets 0 .. q-1: wherever the name stands, one whole block of the text
    lies on one of them. Blocks and q-grams meet in an equi-join, and only the pairs found there are
    checked against the whole text. q is the largest power of two the name allows, up to MAX_BLOCK, so
    a text yields about its own length in blocks for each q in use (at most six).
    """
    keyed = (
        names.select(F.col(name).alias("_name"))
        .where(F.length("_name") > 0)
        .distinct()
        .withColumn("_half", F.greatest(F.lit(1), F.floor((F.length("_name") + 1) / 2)))
        .withColumn("_q", F.lit(1))
    )
    size = 2
    while size <= MAX_BLOCK:
        keyed = keyed.withColumn("_q", F.when(F.col("_half") >= size, F.lit(size)).otherwise(F.col("_q")))
        size *= 2
    keyed = keyed.select(
        "_name",
        "_q",
        F.explode(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_q")), lambda d: F.substring(F.col("_name"), d, F.col("_q"))))
        ).alias("_key"),
    )
    blocks = None
    for (q,) in keyed.select("_q").distinct().collect():  # six values at most
        cut = areas.select(
            area_id,
            F.lit(q).alias("_q"),
            F.explode_outer(F.array_distinct(F.regexp_extract_all(F.col(area), F.lit(f"(?s).{{{q}}}"), F.lit(0)))).alias("_key"),
        )
        blocks = cut if blocks is None else blocks.unionByName(cut)
    if blocks is None:
        return areas.select(area_id, F.lit(None).cast("string").alias(name)).limit(0)
    likely = blocks.join(keyed, ["_q", "_key"]).select(area_id, "_name").distinct()
    return (
        areas.select(area_id, F.col(area).alias("_area"))
        .join(likely, area_id)
        .where(F.contains("_area", "_name"))
        .select(area_id, F.col("_name").alias(name))
        .distinct()
    )
