"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.operators.ordered import cut_lineage


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """`links` has nodes `a`, `b` (bigint). Returns `node, root`: every linked node but the roots, and the smallest
    node it can reach. Each step replaces links by links to smaller nodes; the table never outgrows twice its size.

    The smallest neighbours are a sum by node, combined before the shuffle and written, so that the join back to a
    node with very many links meets one row of it and can be split.
    """
    now = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(now.select("u", "v"))
        low = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = cut_lineage(both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct())
        low = cut_lineage(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = cut_lineage(small.unionAll(low.select("v", F.col("m").alias("u"))).distinct())
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
