"""Line deduplication by pairwise alignment.

Documents that overlap are found through the hashes of their lines. A block that goes has `BLOCK_WORDS` words or more,
so the hashed unit is the shortest run of neighbouring lines with that many words: a long line alone, a short line with
those after it and with those before it. Such a run is rarer than its lines, and every line of a common block is in
one that both documents hold. Each run pairs a document with the first document that holds it (smallest id), so the
pairs grow with the lines, never with the square of a run's holders, a frequent run costs one pair a document like any
other, and a run always stays in its first holder. The runs that a pair shares are aligned by patience diff (runs unique
in both, longest increasing row of them, then the same between its members and outward from them; repeated ones by
their occurrence); blocks that have moved cross that alignment and are aligned again by themselves. The aligned runs
are the common blocks, and their lines are deleted from the later document.

Lines are compared without white space at their ends; lines without a word are neither compared nor deleted, and do
not part a block. Runs repeated inside a document are listed once with their positions, so they multiply nothing.

Documents are ordered by id, null last, then by a hash of the text; rows that agree in both are one document, of which
every row gets the same result. Ids are integers.

Defined cases: a null text stays null and has no lines; an empty text one line without words; texts of one line are
documents of one line; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from skygauge.llm.common import field, packed
from skygauge.operators.ordered import cut_lineage

BLOCK_WORDS = 10
_WORD = r"[^\x20\x09-\x0D]"
#: Order of documents in one number: the id, then 15 digits of the text hash.
_ORDER = (
    "coalesce(cast({id} as decimal(20, 0)), 10000000000000000000) * cast(1000000000000000 as decimal(16, 0))"
    " + cast(pmod(xxhash64({text}), 1000000000000000) as decimal(16, 0))"
)


def _rising(values: list[int]) -> list[int]:
    """Indexes of a longest increasing run."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    run, at = [], ends[-1] if ends else -1
    while at >= 0:
        run.append(at)
        at = back[at]
    return run[::-1]


def _by_occurrence(mine: list, other: list, a: int, c: int) -> list[tuple[int, int]]:
    """Indexes (from `a` and `c` on) of what both lists hold, each occurrence paired with the one of its number."""
    seen: Counter = Counter()
    place = {}
    for j, (_, x) in enumerate(other, c):
        place[x, seen[x]] = j
        seen[x] += 1
    seen.clear()
    found = []
    for i, (_, x) in enumerate(mine, a):
        if (x, seen[x]) in place:
            found.append((i, place[x, seen[x]]))
        seen[x] += 1
    return found


def align(mine: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Patience alignment of two lists of (position, line): pairs of positions, rising in both."""
    out = []
    todo = [(0, len(mine), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and mine[a][1] == other[c][1]:
            out.append((mine[a][0], other[c][0]))
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1][1] == other[d - 1][1]:
            b, d = b - 1, d - 1
            out.append((mine[b][0], other[d][0]))
        if a >= b or c >= d:
            continue
        left, right = Counter(x for _, x in mine[a:b]), Counter(x for _, x in other[c:d])
        place = {x: j for j, (_, x) in enumerate(other[c:d], c) if right[x] == 1}
        unique = [(i, place[x]) for i, (_, x) in enumerate(mine[a:b], a) if left[x] == 1 and x in place]
        if not unique:
            unique = _by_occurrence(mine[a:b], other[c:d], a, c)
        anchors = [unique[k] for k in _rising([j for _, j in unique])]
        if not anchors:
            continue
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
        out += [(mine[i][0], other[j][0]) for i, j in anchors]
    return sorted(out)


def runs(text: str, least: int) -> list[tuple[int, int, int]]:
    """`(key, at, n)`: the shortest runs of `n` lines with `least` words from and up to each line; `at` counts lines with
    words, the key is a hash of the lines."""
    hashes, ends = [], [0]
    for line in text.encode().split(b"\n"):
        held = len(line.split())  # bytes: only ASCII white space separates
        if held:
            hashes.append(xxhash.xxh64_intdigest(line.strip()))
            ends.append(ends[-1] + held)
    found = set()
    for i in range(len(hashes)):
        j = bisect_left(ends, ends[i] + least, i + 1)
        if j < len(ends):
            found.add((i, j))
        j = bisect_left(ends, ends[i + 1] - least + 1, 0, i + 1) - 1
        if j >= 0:
            found.add((j, i + 1))
    key = lambda i, j: xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "big") for h in hashes[i:j]))
    return [(key(i, j) - (1 << 63), i, j - i) for i, j in sorted(found)]


def common_blocks(keys: list[int], lengths: list[int], mine: list, other: list) -> list[int]:
    """Lines of the later document that aligned runs cover; `mine` and `other` list the places of each key."""
    length = dict(zip(keys, lengths))
    own = sorted((int(p), length[x], x) for x, ps in zip(keys, mine) for p in ps)
    first = sorted((int(p), length[x], x) for x, ps in zip(keys, other) for p in ps)
    left = list(enumerate(x for _, _, x in own))
    fixed = list(enumerate(x for _, _, x in first))
    gone: set[int] = set()
    while met := {i for i, _ in align(left, fixed)}:
        for i in met:
            gone.update(range(own[i][0], own[i][0] + own[i][1]))
        left = [r for r in left if r[0] not in met]
    return sorted(gone)


@F.pandas_udf(ArrayType(IntegerType()))
def _covered(keys: pd.Series, lengths: pd.Series, mine: pd.Series, other: pd.Series) -> pd.Series:
    found = [common_blocks(list(a), list(b), c, d) for a, b, c, d in zip(keys, lengths, mine, other)]
    return pd.Series(found, dtype=object)


def _listed(least: int):
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for row, text in enumerate(batch.column("text")):
                found = runs(text.as_py(), least)
                if found:
                    key, at, n = zip(*found)
                    doc = batch.column("doc").take(pa.array([row] * len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())],
                        names=["doc", "key", "at", "n"],
                    )

    return batches


def covered_lines(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """`doc` (order number) and `gone` (numbers of its lines that go, among those with words)."""
    doc = F.expr(_ORDER.format(id=f"`{doc_id}`", text=f"`{text}`"))
    texts = docs.select(doc.alias("doc"), F.col(text).alias("text")).where("text is not null")
    kind = texts.schema["doc"].dataType.simpleString()
    lines = cut_lineage(texts.mapInArrow(_listed(least), f"doc {kind}, key bigint, at int, n int"))
    firsts = lines.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    firsts = cut_lineage(firsts.where("first < last").select("key", "first"))
    held = lines.join(firsts, "key")
    listed = cut_lineage(held.groupBy("key", "doc", "first").agg(F.collect_set("at").alias("ats"), F.max("n").alias("n")))
    first = listed.where("doc = first").select("key", F.col("ats").alias("first_ats"))
    pairs = (
        listed.where("doc > first")
        .join(first, "key")
        .groupBy("first", "doc")
        .agg(F.collect_list(F.struct("key", "n", "ats", "first_ats")).alias("x"))
    )
    gone = _covered(*[F.col("x")[c] for c in ("key", "n", "ats", "first_ats")])
    return pairs.select("doc", F.explode(gone).alias("at")).groupBy("doc").agg(F.collect_set("at").alias("gone"))


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = BLOCK_WORDS,
) -> DataFrame:
    """`docs` with the text left, `n_lines` (lines with words) and `n_removed`."""
    base = docs.drop("n_lines", "n_removed")
    gone = cut_lineage(covered_lines(base, doc_id, text, least))
    whole = field(text)
    met = (
        packed(base)
        .withColumn("doc", F.expr(_ORDER.format(id=field(doc_id), text=whole)))
        .join(gone, "doc", "left")
    )
    kept = F.expr(
        f"""transform(array(split({whole}, '\n')), l -> transform(
          array(filter(sequence(0, size(l) - 1), i -> l[i] rlike r'{_WORD}')), w ->
          array_join(transform(array_except(sequence(0, size(l) - 1), transform(gone, g -> w[g])), i -> l[i]), '\n'))[0])[0]"""
    )
    worded = F.size(F.filter(F.split(whole, "\n"), lambda x: x.rlike(_WORD)))
    left = F.when(F.col("gone").isNull(), F.col(whole)).otherwise(kept)
    return met.select(
        *[left.alias(c) if c == text else F.col(field(c)).alias(c) for c in base.columns],
        F.when(F.col(whole).isNull(), 0).otherwise(worded).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
