"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

The hash has 60 bits and covers all columns of the key. A bucket is a bit prefix; while its bytes exceed
the limit it splits on the next bit. The result equals the closed form "the shortest prefix whose bytes fit",
so it does not depend on the order of rows or on partitions. The directory is built from sums of bytes by
prefix (combined before the shuffle): `STEP` bits a round, and only rows of buckets that are still too large
take part in the next round. Nothing but these sums is ever gathered.

Rows whose 60 bits agree (identical rows, since the key should tell different rows apart) cannot be split by
more bits. They are dealt to overflow pages of one bucket, `prefix+partition.page`, each within the limit.
A single row larger than the limit has a shard of its own and `fits` is false.

Defined cases: null text has zero bytes; null keys hash as a value of their own; an empty table gives an empty
result; columns named like the added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skygauge.llm.common import field, hash60, n_bytes, packed, sized
from skygauge.operators.ordered import cut_lineage

BITS = 60
STEP = 10
LIMIT_BYTES = 8 << 20
ADDED = ("n_bytes", "shard", "shard_bytes", "fits")
#: Most directory entries of a round that are broadcast; a larger round joins by shuffle.
DIRECTORY_ROWS = 500_000


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, BITS - depth)


def directory(keys: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """`(depth, table)` a round: `at` (prefix of that depth) leads to `leaf`, `leaf_depth`, `leaf_bytes`, `leaf_rows`.

    `keys` has `h` and `bytes`. Buckets that still exceed the limit are absent from a round and go to the next.
    """
    rounds, open_rows, done = [], keys, 0
    while done < BITS:
        deep = min(done + STEP, BITS)
        sums = open_rows.groupBy(_prefix(F.col("h"), deep).alias("at")).agg(
            F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")
        )
        up = sums.select(
            "at",
            "b",
            "n",
            F.explode(F.sequence(F.lit(0 if done == 0 else done + 1), F.lit(deep))).alias("leaf_depth"),
        ).withColumn("leaf", F.expr(f"shiftright(at, {deep} - leaf_depth)"))
        fits = F.sum("b") <= limit
        if deep == BITS:
            fits = fits | (F.max("leaf_depth") == BITS)
        buckets = up.groupBy("leaf_depth", "leaf").agg(
            F.sum("b").alias("leaf_bytes"), F.sum("n").alias("leaf_rows"), fits.alias("fit")
        )
        buckets = cut_lineage(buckets)
        # a leaf fits and its parent does not; its directory entries are the prefixes of the round's depth below it
        parent = buckets.where("fit").select((F.col("leaf_depth") + 1).alias("pd"), F.col("leaf").alias("pl"))
        leaves = buckets.where("fit").join(
            parent, F.expr("leaf_depth = pd and shiftright(leaf, 1) = pl"), "left_anti"
        )
        below = f"shiftleft(1L, {deep} - leaf_depth)"
        found = leaves.selectExpr(
            f"explode(sequence(leaf * {below}, (leaf + 1) * {below} - 1)) as at", "leaf_depth", "leaf", "leaf_bytes", "leaf_rows"
        )
        rounds.append((deep, cut_lineage(found)))
        left = cut_lineage(buckets.where(f"leaf_depth = {deep} and not fit").select(F.col("leaf").alias("at")))
        if left.isEmpty():
            break
        open_rows = open_rows.join(sized(left), _prefix(F.col("h"), deep) == F.col("at"), "left_semi")
        done = deep
    return rounds


def shard(
    docs: DataFrame, key: tuple[str, ...] = ("doc_id", "text"), text: str = "text", limit: int = LIMIT_BYTES
) -> DataFrame:
    """`docs` with `n_bytes`, `shard` (bits of the prefix; `+page` for overflow), `shard_bytes` and `fits`."""
    rows = packed(docs.drop(*[c for c in ADDED if c not in (*key, text)])).select(
        "row", hash60(*map(field, key)).alias("h"), n_bytes(field(text)).alias("n_bytes")
    )
    rounds = directory(cut_lineage(rows.select("h", F.col("n_bytes").alias("bytes"))), limit)
    out = rows
    entry = ("leaf_depth", "leaf", "leaf_bytes", "leaf_rows")
    for i, (deep, found) in enumerate(rounds):
        side = found.withColumnsRenamed({c: f"{c}{i}" for c in ("at", *entry)})
        out = out.join(sized(side, DIRECTORY_ROWS), _prefix(F.col("h"), deep) == F.col(f"at{i}"), "left")
    # a row finds its leaf in exactly one round
    out = out.select("row", "h", "n_bytes", *[F.coalesce(*[F.col(f"{c}{i}") for i in range(len(rounds))]).alias(c) for c in entry])
    bits = F.expr("if(leaf_depth = 0, '', lpad(bin(leaf), leaf_depth, '0'))")
    over = (F.col("leaf_bytes") > limit) & (F.col("leaf_rows") > 1)
    parts = [out.where(~over).select("row", "n_bytes", bits.alias("shard"), F.col("leaf_bytes").alias("shard_bytes"))]
    if rounds and rounds[-1][0] == BITS:
        parts.append(_overflow(out.where(over), bits, limit))
    whole = reduce(DataFrame.unionByName, parts).withColumn("fits", F.col("shard_bytes") <= limit)
    return whole.select("row.*", *ADDED)


def _overflow(rows: DataFrame, bits: Column, limit: int) -> DataFrame:
    """Identical rows: numbered inside their input partition, as many to a page as fit."""
    numbered = rows.withColumn("part", F.spark_partition_id()).withColumn(
        "rn", F.row_number().over(W.partitionBy("h", "part").orderBy("n_bytes")) - 1
    )
    page = F.expr(f"part || '.' || (rn div greatest(1, {limit} div greatest(1, n_bytes)))")
    # sums over the same rows: a second reading of them could number the partitions differently
    paged = numbered.withColumn("page", page).withColumn("shard_bytes", F.sum("n_bytes").over(W.partitionBy("h", "page")))
    return paged.select("row", "n_bytes", F.concat(bits, F.lit("+"), F.col("page")).alias("shard"), "shard_bytes")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; rows of a shard meet in one task, which the byte limit bounds."""
    sharded.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
