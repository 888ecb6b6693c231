"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit hash. A source with target T and size S gives each document `repeats = floor(T / S)`
times, and once more the documents whose hash lies below a threshold; a larger budget only raises the threshold,
so its documents are a superset. The threshold comes from histograms: sizes are summed by source and leading hash
bits, the bucket in which the budget ends is found, and only documents of that bucket are counted again by their
next bits. Documents are never sorted, and nothing but sums by bucket is shuffled.

What the threshold leaves open (less than one document) is closed by the one document above the threshold whose
size comes nearest to it, if that brings the source nearer to its target; ties go to the smaller hash.

Targets: the weights 5, 2, 1 go round the sources in code-point order, null last. All sizes together are shared by
weight; a target stops at `most` times the size of its source and the rest is shared by weight among the others.
That is one level L with target = min(most * size, L * weight), found by one running sum over the sources.

Defined cases: a null text has size 0 and is taken 0 words; a source of size 0 has target 0; rows with the same
`doc_id` and text share their fate; an empty table gives an empty result; columns named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skygauge.llm.common import field, hash60, n_words, packed, sized
from skygauge.operators.ordered import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
BITS = 60
#: Bits that each round of the histogram adds. The first bounds the buckets of a source at 4,096.
ROUNDS = (12, 16, 16, 16)
ADDED = ("size", "source_size", "target", "repeats", "threshold", "closing", "copies", "taken")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size) with `target`. One row a source: these small rows are numbered in one task."""
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_turn", (F.row_number().over(in_order) - 1) % len(weights)).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_turn") + 1).cast("long")
    )
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.expr(f"cast({most} * source_size as double) / _weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    summed = (
        ranked.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_capped", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_level", F.expr("cast(_all - _capped as double) / cast(_weights - _used as double)"))
    )
    # sources in order of most * size / weight: the first that its level leaves below its bound sets the level
    level = F.first(
        F.expr(f"case when _level * _weight <= {most} * source_size then _level end"), ignorenulls=True
    ).over(by_ratio.rowsBetween(W.unboundedPreceding, 0))
    return summed.select(
        "source",
        "source_size",
        F.coalesce(level * F.col("_weight"), F.lit(float(most)) * F.col("source_size")).alias("target"),
    )


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """By source: `source_size`, `target`, `repeats`, `threshold` and `closing`. `rows` has `source`, `size` and `h`."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(sizes, weights, most)
    found = found.withColumn(
        "repeats",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
    ).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size"))
    found = found.withColumn("prefix", F.lit(0).cast("long"))
    found = cut_lineage(found)
    done = 0
    for step in ROUNDS:
        deep = done + step
        edge = sized(found.select(F.col("source").alias("_s"), F.col("prefix").alias("_p")).where("_p is not null"))
        inside = F.expr(f"source <=> _s and shiftright(h, {BITS - done}) = _p") if done else F.expr("source <=> _s")
        buckets = (
            rows.join(edge, inside, "left_semi")
            .groupBy("source", F.shiftright("h", BITS - deep).alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        summed = buckets.withColumn("upto", F.sum("n").over(upto)).withColumnRenamed("source", "_s")
        # first bucket that goes over what is left; none: the threshold lies behind the last one
        joined = summed.join(found.select("source", "left"), F.expr("source <=> _s")).where("upto > left")
        first = joined.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("b"))
        found = (
            found.join(first.withColumnRenamed("source", "_s"), F.expr("source <=> _s"), "left")
            .withColumn("prefix", F.when(F.col("prefix").isNotNull(), F.col("b.bucket")))
            .withColumn("left", F.when(F.col("b").isNotNull(), F.expr("left - (b.upto - b.n)")).otherwise(F.col("left")))
            .drop("b", "_s")
        )
        found = cut_lineage(found)
        done = deep
    found = found.select(
        "source", "source_size", "target", "repeats", "left", F.coalesce("prefix", F.lit(1 << BITS)).alias("threshold")
    )
    # what is still left is closed by the document above the threshold whose size comes nearest to it, if any does
    edge = sized(found.where("left > 0").selectExpr("source as _s", "left", "threshold"))
    above = rows.join(edge, F.expr("source <=> _s and h >= threshold and size > 0 and size < 2 * left"))
    one = above.groupBy("source", "h").agg(F.abs(F.sum("size") - F.max("left")).alias("off"), F.max("left").alias("left"))
    closing = one.where("off < left").groupBy(F.col("source").alias("_s")).agg(F.min(F.struct("off", "h"))["h"].alias("closing"))
    return cut_lineage(found.join(closing, F.expr("source <=> _s"), "left").drop("_s", "left"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """`docs` with `size`, `source_size`, `target`, `repeats`, `threshold`, `copies` and `taken` (copies * size)."""
    rows = packed(docs.drop(*[c for c in ADDED if c not in (doc_id, text, source)])).select(
        "row",
        F.col(field(source)).alias("source"),
        n_words(field(text)).alias("size"),
        hash60(field(doc_id), field(text)).alias("h"),
    )
    found = plan(cut_lineage(rows.select("source", "size", "h")), weights, most).withColumnRenamed("source", "planned")
    extra = F.when(F.expr("h < threshold or h = closing"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(F.col("repeats") + extra, F.lit(most))).otherwise(F.lit(0)).cast("long")
    return (
        rows.join(sized(found), F.col("source").eqNullSafe(F.col("planned")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row.*", *ADDED)
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: every document as often as it is taken."""
    rows = packed(mixed.where("copies > 0"))
    rows = rows.select("row", F.explode(F.expr("sequence(1L, row.copies)")))
    return rows.select(*[F.col(field(c)).alias(c) for c in columns])
