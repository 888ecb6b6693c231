"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has one bit per hash bit: 1 if it is set in over half of the hashes of the text's word shingles. Texts
with equal fingerprints are one class from the start, by one aggregate, so copies are never paired. Classes are
indexed by the bytes of their fingerprint at fixed positions. Pairs that meet in a list are tallied: the number of
positions with equal bytes must reach the minimum that linked fingerprints share, and what remains is verified by
its differing bits. Links give components, and a component is a group.

A list of one byte value at one position would hold 1/256 of all classes, so its pairs would grow with the square of
the input. Lists are therefore keyed by several positions at once.

`exact_links`: 64 bits, at most 2 differing. At most two of the four byte pairs can differ, so two linked
fingerprints agree in one of the six sets of two byte pairs, and in 6 of 8 bytes. Lists of over `LIST` classes are
not paired: there each class files itself under its fingerprint and under those one bit away, since two fingerprints
differ in at most two bits exactly if they share such a neighbour. Links go to the smallest class of a neighbour.
Every link is kept or replaced by a path, and the work per class is fixed. `exact_groups` and `one_of_each` use these links.

`near_links` (for `near_groups` alone, no query): texts whose sets of distinct 5-word shingles have a Jaccard similarity of 0.8 or more, computed exactly on
64-bit shingle hashes. Texts with equal sets are one class. All sets are put into one order, shingles that repeat in a
sample last (any order gives the same links; this one keeps lists short). Two sets of similarity 0.8 or more share at
least 4/9 of the sum of their sizes, so the first shingle they share stands among the first fifth of both and among
the first ninth of the smaller: classes are indexed by these. Pairs that meet are dropped only where it is certain that
they are below 0.8: by the places of the shared shingle, or by more differing bits of a parity bitmap of 1,024 bits
than shingles may differ. For every other pair the similarity is computed from the texts.

In a list of over `HUB_LIST` classes each class is first compared with two hubs, the smallest and the largest one. Then
only classes that are not linked to the same one within a few steps are paired. If over `NEAR_LIST` classes of a list are outside its
largest such group, the list is filed anew under the next shared shingle too, up to `DEPTH` shingles, where everything left is paired (two
different sets of similarity 0.8 share at least four shingles, so no pair is lost on the way).

Defined cases: a null or empty text has fingerprint zero and is linked like any other (`near_links`: the empty set,
equal only to itself); a text of fewer words than a
shingle is one shingle; null ids are never the smallest; repeated rows are copies; an empty table gives an empty
result; further columns are not carried.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import field, packed, sized
from skygauge.llm.components import components
from skygauge.operators.ordered import cut_lineage

SEED = 42

LIST = 64
LINK_BITS = 2
LINK_SHARED = 6
_PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))
LINK_KEYS = tuple(a + b for a, b in combinations(_PAIRS, 2))

#: Lists of over `HUB_LIST` classes are first compared with two hubs; those with over `NEAR_LIST` classes outside their
#: largest group are filed anew.
HUB_LIST = 16
NEAR_LIST = 256
#: How often labels are passed on before pairs are formed; it spares pairs and decides nothing.
STEPS = 2
#: At most this many shingles in one key; not over four, see above.
DEPTH = 2
BITMAP = 1024
#: About this many texts are read for the order of shingles, and so many repeated shingles are kept.
SAMPLE = 5_000
COMMON = 10_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, A-Z lower-cased; repeats stay."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        rows = [b" ".join(found)]
    else:
        rows = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """`bits / 64` words. Word 0 counts the bits of the hashes, each further word the bits of a remix of them."""
    out = np.zeros(bits // 64, np.uint64)
    n = len(hashes)
    if not n:
        return out
    for k in range(len(out)):
        h = hashes if k == 0 else _remix(hashes, k)
        ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")
    return out


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def exact_fingerprint(text: str, words: int) -> Column:
    """64-bit fingerprint of a text column as `bigint`."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        found = [fingerprint(shingle_hashes(t, words), 64)[0] for t in texts]
        return pd.Series(np.array(found, np.uint64).astype(np.int64))

    return prints(F.col(text))


def shingle_set(text: str, words: int) -> Column:
    """The distinct shingle hashes of a text column as `array<bigint>`."""

    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).astype(np.int64) for t in texts], dtype=object)

    return sets(F.col(text))


def _common(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that repeat in a sample of the texts, ascending, and how often each does."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.select(F.col(text).alias("text")).where(f"pmod(xxhash64(text, 'order'), {share}) = 0").distinct()
    seen = sample.select(F.explode(shingle_set("text", words)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = seen.where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes = np.array([r["h"] for r in found], np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in found], np.int64)[order]


def near_class(text: str, words: int, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """`node` (hash of the shingle set), `n` (its size), `first` (its start in the common order) and `bits` (parity bitmap)."""
    late, count = common

    @F.pandas_udf("struct<node bigint, n bigint, first array<bigint>, bits array<bigint>>")
    def classes(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = np.unique(shingle_hashes(t, words))
            n = len(h)
            node = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64)
            odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(late, h), len(late) - 1)
                h = h[np.argsort(np.where(late[at] == h, count[at], 0), kind="stable")]
            out.append((node, n, h[: n - (4 * n + 4) // 5 + DEPTH].astype(np.int64), bits))
        return pd.DataFrame(out, columns=["node", "n", "first", "bits"])

    return classes(F.col(text))


def _byte(p: int, word: str) -> str:
    return f"(shiftrightunsigned({word.format(p // 8)}, {56 - 8 * (p % 8)}) & 255)"


def _filed(classes: DataFrame, keys: tuple[tuple[int, ...], ...], word: str) -> DataFrame:
    """The index: `list, key, node, n` for lists of `n` > 1 classes."""
    key = [" | ".join(f"shiftleft({_byte(p, word)}, {8 * i})" for i, p in enumerate(at)) for at in keys]
    posts = classes.selectExpr(
        "node", "inline(array(" + ", ".join(f"struct({i} as list, {k} as key)" for i, k in enumerate(key)) + "))"
    )
    lists = cut_lineage(posts.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut_lineage(posts.join(sized(lists), ["list", "key"]))


def _other(filed: DataFrame) -> DataFrame:
    return filed.selectExpr("list as list2", "key as key2", "n as n2", "node as b")


def _shared(positions: int, mine: str, other: str) -> str:
    return " + ".join(f"int({_byte(p, mine)} = {_byte(p, other)})" for p in range(positions))


def exact_links(classes: DataFrame) -> DataFrame:
    """Links `a, b` of classes (`node`: the fingerprint) that differ in at most `LINK_BITS` bits."""
    filed = _filed(classes, LINK_KEYS, "node")
    short = (
        filed.where(f"n <= {LIST}")
        .withColumnRenamed("node", "a")
        .join(_other(filed).where(f"n2 <= {LIST}"), F.expr("list = list2 and key = key2 and a < b"))
        .where(f"{_shared(8, 'a', 'b')} >= {LINK_SHARED}")
        .where(f"bit_count(a ^ b) <= {LINK_BITS}")
    )
    return short.select("a", "b").unionAll(_neighbours(filed.where(f"n > {LIST}"))).distinct()


def _neighbours(filed: DataFrame) -> DataFrame:
    """The links inside long lists, by the neighbour one bit away that linked classes share."""
    free = [", ".join(str(63 - 8 * p - i) for p in range(8) if p not in key for i in range(8)) for key in LINK_KEYS]
    bits = "case list " + " ".join(f"when {i} then array({f})" for i, f in enumerate(free)) + " end"
    near = filed.selectExpr(
        "list", "key", "node as a", f"explode(concat(array(node), transform({bits}, i -> node ^ shiftleft(1L, i)))) as near"
    )
    low = near.groupBy("list", "key", "near").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n"))
    low = cut_lineage(low.where("_n > 1").drop("_n"))
    return near.join(low, ["list", "key", "near"]).where("a <> b").select("a", "b")


def _bits_close(a: str, b: str) -> str:
    """SQL: no more bits of the bitmaps differ than shingles may at a similarity of 0.8; a sure filter."""
    differ = " + ".join(f"bit_count(bits_{a}[{w}] ^ bits_{b}[{w}])" for w in range(BITMAP // 64))
    return f"9 * ({differ}) <= n_{a} + n_{b}"


def _alike(close: DataFrame, sets) -> DataFrame:
    """Those of the distinct pairs `a, b` whose similarity is 0.8 or more, computed from the sets."""
    close = cut_lineage(close)
    if close.isEmpty():
        return close
    held = sets(close.selectExpr("explode(array(a, b)) as node").distinct())
    met = held.selectExpr("node as a", "set as x").join(close, "a").join(held.selectExpr("node as b", "set as y"), "b")
    return cut_lineage(met.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b"))


def near_links(classes: DataFrame, sets) -> DataFrame:
    """Links `a, b` that connect classes (`near_class`) exactly as all pairs of similarity 0.8 or more do.

    `sets` gives `node`, `set` for a table of `node`.
    """
    posts = classes.selectExpr("node", "n", "posexplode(slice(first, 1, int(n - (4 * n + 4) div 5 + 1))) as (pos, key)")
    links = None
    for level in range(1, DEPTH + 1):
        # the smaller class of a pair has its shared shingle early
        posts = posts.withColumn("early", F.expr(f"pos <= n - (8 * n + 8) div 9 + {level - 1}"))
        lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max("early").alias("any"))
        lists = cut_lineage(lists.where("held > 1 and any").drop("any"))
        posts = cut_lineage(posts.join(lists, "key"))
        long = posts.where(f"held > {HUB_LIST}").select("key", "node")
        hubs = long.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        star = long.join(hubs, "key").selectExpr("node", "explode(array(low, high)) as hub").where("node <> hub")
        star = star.selectExpr("least(node, hub) as a", "greatest(node, hub) as b").distinct()
        side = lambda c: classes.selectExpr(f"node as {c}", f"n as n_{c}", f"bits as bits_{c}")
        star = side("a").join(star, "a").join(side("b"), "b").where(_bits_close("a", "b")).select("a", "b")
        star = _alike(star, sets)
        links = star if links is None else links.unionAll(star)
        # smallest nodes passed on along the links: classes of one label are connected
        both = cut_lineage(links.selectExpr("a as node", "b as other").unionAll(links.selectExpr("b", "a")))
        label = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        for _ in range(STEPS):
            passed = both.join(label.withColumnRenamed("node", "other"), "other")
            label = cut_lineage(passed.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("root")))
        left = posts.select("key", "node", "n", "pos", "early").join(label, "node", "left")
        left = cut_lineage(left.withColumn("root", F.coalesce("root", "node")))
        parts = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
        parts = parts.groupBy("key").agg(F.sum("c").alias("held"), F.max("c").alias("top"), F.max_by("root", "c").alias("main"))
        parts = cut_lineage(parts.where("held > top").selectExpr("key", "main", "held - top as minor"))
        left = cut_lineage(left.join(parts, "key"))
        now = left if level == DEPTH else left.where(f"minor <= {NEAR_LIST}")
        # the bitmaps go into the join, so that only pairs which may be similar come out of it
        now = now.join(classes.select("node", "bits"), "node")
        one = now.where("root <> main").selectExpr("key", *[f"{c} as {c}_a" for c in ("node", "n", "pos", "early", "root", "bits")])
        two = now.selectExpr("key as key_b", *[f"{c} as {c}_b" for c in ("node", "n", "pos", "early", "root", "bits")])
        places = f"9 * ({level - 1} + least(n_a - pos_a, n_b - pos_b)) >= 4 * (n_a + n_b)"
        meet = f"key = key_b and root_a <> root_b and (early_a or early_b) and {places} and {_bits_close('a', 'b')}"
        pairs = one.join(two, F.expr(meet)).selectExpr("least(node_a, node_b) as a", "greatest(node_a, node_b) as b")
        links = links.unionAll(_alike(pairs.distinct(), sets))
        long = left.where(f"minor > {NEAR_LIST}").select("key", "node", "n", "pos")
        if level == DEPTH or long.isEmpty():
            break
        start = classes.selectExpr("node", "first")
        further = long.join(start, "node").selectExpr(
            "node", "n", "key", "pos as before", f"posexplode(slice(first, 1, int(n - (4 * n + 4) div 5 + {level + 1}))) as (pos, next)"
        )
        posts = further.where("pos > before").selectExpr("node", "n", "pos", "xxhash64(key, next) as key")
    return links.distinct()


def _grouped(rows: DataFrame, link, *carried: str) -> DataFrame:
    """`rows` (node, doc_id, carried columns) with `component`, the smallest node of the group."""
    classes = cut_lineage(rows.select("node", *carried).dropDuplicates(["node"]))
    found = components(link(classes))
    return cut_lineage(
        classes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    )


def _exact(docs: DataFrame, doc_id: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows (`doc_id, text_hash, node`) and the `component` of each node, by `exact_links`."""
    found = F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), exact_fingerprint(text, words).alias("node")
    rows = cut_lineage(docs.select(*found))
    return rows, _grouped(rows, exact_links)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row a document: `doc_id`, `fingerprint` (16 hex digits), `component_id` (smallest id of its group)."""
    rows, by_node = _exact(docs, doc_id, text, words)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(by_node, "node")
    least = cut_lineage(least.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut_lineage(by_node.join(least, "component").select("node", "component_id"))
    return rows.join(named, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """One row a document: `doc_id`, `text_hash`, `component` of near-duplicates."""
    found = near_class(text, words, _common(docs, text, words))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), found.alias("c"))
    rows = cut_lineage(rows.select("doc_id", "text_hash", "c.*"))

    def sets(nodes: DataFrame) -> DataFrame:
        held = rows.join(nodes, "node").groupBy("node").agg(F.min("text_hash").alias("h"))
        texts = docs.select(F.col(text).alias("text")).join(sized(cut_lineage(held)), F.expr("xxhash64(text) = h"))
        return cut_lineage(texts.dropDuplicates(["node"]).select("node", shingle_set("text", words).alias("set")))

    by_node = _grouped(rows, lambda classes: near_links(classes, sets), "n", "first", "bits")
    return rows.join(by_node, "node").select("doc_id", "text_hash", "component")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The document with the smallest id (null last, then by text hash) of each group of `exact_groups`, with all columns.

    Rows repeated as a whole are one document.
    """
    rows, by_node = _exact(docs, doc_id, text, words)
    found = rows.join(by_node, "node").select("doc_id", "text_hash", "component")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    best = found.groupBy("component").agg(F.min(order).alias("x"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_copies"))
    best = best.selectExpr("x.doc_id as _id", "x.text_hash as _hash").join(
        rows, F.expr("_id <=> doc_id and _hash = text_hash")
    )
    best = cut_lineage(best.select("_id", "_hash", "_copies"))
    met = packed(docs).join(
        best, F.col(field(doc_id)).eqNullSafe(F.col("_id")) & (F.xxhash64(field(text)) == F.col("_hash"))
    )
    single = met.where("_copies = 1").select("row.*")
    return single.unionAll(met.where("_copies > 1").dropDuplicates(["_id", "_hash"]).select("row.*"))
