"""Document fingerprints by Order MinHash, in Spark's own functions only.

The symbols of a text are its words, or, if its words have over `LONG` characters on average (no blanks in the script,
or no language at all), pieces of `PIECE` characters. A k-mer is `K` consecutive symbols; k-mers that repeat are told apart by
their occurrence number, so that a text which repeats a phrase differs from one that has it once. Occurrences get a
hash, whose leading bits deal them into `BINS` independent orders. In each order the two minimal occurrences are
selected, put back in the order in which they stand in the text, and hashed as a tuple. The signature is the list of
tuple hashes, the likeness of two signatures the share of equal tuples among the orders that either text fills. Equal
tuples need the same k-mers, equally often, in the same order: moving a passage costs likeness, as an edit distance does.

One sort numbers the occurrences and a second one selects the minima of all orders, so the work on a text of n symbols is
n log n and its memory a few arrays of n numbers, whatever repeats in it. Nothing of a text is cut.

`edited` pairs each document with the next one in descending order of ids. Ranges of the order are found from a sample of
at most `SAMPLE_ROWS` keys, which balances the work and decides nothing: rows are dealt to a range, and inside it `lead`
sees the next row. The first row of each range is sent to the range before it too (at most `RANGES` rows).

Defined cases: a null text is an empty one; a text without a symbol has the empty fingerprint, likeness 1 with another
empty one and 0 with any other; fewer symbols than `K` make one k-mer. Each row is a document; rows with one id (null ids
come last) follow by the hash of their text; equal rows follow each other. After the last row comes the first. An
empty table gives an empty result; further columns are not carried. Texts that differ in white space alone have one
fingerprint.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skygauge.llm.common import BLANKS, SPACE

K = 3
BINS = 64
#: The order is cut into at most this many ranges, found from a sample of at most `SAMPLE_ROWS` keys.
RANGES = 1_024
SAMPLE_ROWS = 16_384

LONG = 24
PIECE = 6

#: A packed occurrence is a hash in the upper 38 bits and the place in the text in the lower ones.
PLACE_BITS = 26
_PLACE = (1 << PLACE_BITS) - 1
_BIN_BITS = BINS.bit_length() - 1
#: Marks the places of further occurrences.
_NONE = "(-9223372036854775807L - 1)"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _symbols(text: str) -> str:
    words = f"split(x, r'{SPACE}')"
    pieces = f"regexp_extract_all(x, r'(?s).{{1,{PIECE}}}', 0)"
    cut = _let(words, "w", f"if(char_length(x) > {LONG} * size(w), {pieces}, w)")
    return _let(f"trim(BOTH r'{BLANKS}' FROM coalesce({text}, ''))", "x", f"if(x = '', cast(array() as array<string>), {cut})")


def signature(text: str) -> str:
    """`array<bigint>` of a text expression: for each order that it fills, the order's number and 32 bits of its tuple."""
    held = lambda x: f"shiftright({x}, {PLACE_BITS})"
    order = lambda x: f"shiftrightunsigned({x}, {64 - _BIN_BITS})"
    grams = "arrays_zip(" + ", ".join(f"slice(s, {k}, size(s) - {K - 1})" for k in range(1, K + 1)) + ")"
    placed = (
        f"if(size(s) < {K}, array(xxhash64(s) & {~_PLACE}L), transform({grams}, (x, i) -> (xxhash64(x) & {~_PLACE}L) | i))"
    )
    # p is sorted, so equal k-mers are neighbours; the first keeps its hash, the others get one with their number
    again = lambda h, number, place: f"((xxhash64({h}, {number}) & {~_PLACE}L) | ({place} & {_PLACE}))"
    near = f"zip_with(p, concat(array(cast(null as bigint)), p), (x, y) -> if({held('x')} <=> {held('y')}, {_NONE}, x))"
    # q has the indices of all but the first of each, in runs of neighbours
    others = f"filter(sequence(1, size(p) - 1), i -> {held('p[i]')} = {held('p[i - 1]')})"
    runs = "filter(sequence(0, size(q) - 1), t -> if(t = 0, true, q[t] <> q[t - 1] + 1))"
    last = "q[if(j + 1 < size(r), r[j + 1], size(q)) - 1]"
    number = again(held("p[i]"), "i - q[b] + 1", "p[i]")
    repeats = _let(runs, "r", f"flatten(transform(r, (b, j) -> transform(sequence(q[b], {last}), i -> {number})))")
    firsts = f"array_remove(n, {_NONE})"
    every = f"sort_array(concat({firsts}, {_let(others, 'q', repeats)}))"
    chosen = _let(f"slice({near}, 1, size(p))", "n", f"if(array_contains(n, {_NONE}), {every}, n)")
    # sorted by order and hash: the two minima of an order stand first in it
    two = f"filter(o, (x, i) -> not ({order('x')} <=> {order('get(o, i - 2)')}))"
    paired = f"if(i + 1 < size(m), {order('x')} = {order('m[i + 1]')}, false)"
    pair = f"xxhash64({held('{}')}, {held('{}')})"
    in_text = f"if((x & {_PLACE}) < (m[i + 1] & {_PLACE}), {pair.format('x', 'm[i + 1]')}, {pair.format('m[i + 1]', 'x')})"
    tuple_ = f"shiftleft({order('x')}, 32) | (if({paired}, {in_text}, xxhash64({held('x')})) & 4294967295L)"
    leads = f"transform(m, (x, i) -> if({order('x')} <=> {order('get(m, i - 1)')}, null, {tuple_}))"
    tuples = _let(two, "m", f"filter({leads}, x -> x is not null)")
    found = _let(f"sort_array({placed})", "p", _let(chosen, "o", tuples))
    return _let(_symbols(text), "s", f"if(size(s) = 0, cast(array() as array<bigint>), {found})")


def printed(signature: str) -> str:
    """A signature as text: ten hexadecimal digits an order."""
    return f"lower(array_join(transform({signature}, x -> lpad(hex(x), 10, '0')), ''))"


def likeness(a: str, b: str) -> str:
    """The share of equal tuples among the orders that either signature fills; 1 for two empty ones."""
    orders = f"size(array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32))))"
    return f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}, {b})) / cast(greatest({orders}, 1) as double))"


def _ranges(keys: DataFrame) -> str:
    """Expression for the range of `key`: two steps over sorted borders, so that thousands cost little."""
    picked = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS)
    borders = [r[0] for r in picked.orderBy("key").select(F.to_json("key")).collect()]
    if not borders:
        return "0"
    borders = borders[:: -(-len(borders) // RANGES)]
    wide = max(1, math.isqrt(len(borders)))
    steps = [borders[i : i + wide] for i in range(0, len(borders), wide)]
    kind = keys.schema["key"].dataType.simpleString()

    def below(held: list[str]) -> str:
        text = json.dumps([json.loads(x) for x in held]).replace("'", "\\'")
        return f"from_json('{text}', 'array<{kind}>')"

    inner = "array(" + ", ".join(below(x) for x in steps) + ")"
    top = below([x[0] for x in steps])
    upto = lambda held: f"size(filter({held}, b -> b <= key))"
    return _let(upto(top), "t", f"if(t = 0, 0, (t - 1) * {wide} + {upto(f'element_at({inner}, t)')})")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: `doc_id`, `n_chars`, `edited` (its text with the later half replaced by the start of the next
    document), and the signatures of itself (`own`), of the edited text (`changed`) and of the next document (`next`)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.selectExpr("doc_id", "text", "struct(doc_id, xxhash64(text) as h) as key")
    rows = rows.withColumn("at", F.expr(_ranges(rows.select("key"))))
    found = rows.groupBy("at").agg(F.max("key").alias("head")).orderBy("at").collect()  # a row for each range
    if not found:
        return rows.selectExpr("doc_id", "0L as n_chars", "text as edited", *[f"cast(null as array<bigint>) as {c}" for c in ("own", "changed", "next")])
    before = {b.at: a.at for a, b in zip(found[1:] + found[:1], found)}
    before = "map(" + ", ".join(f"{k}, {v}" for k, v in before.items()) + ")"
    heads = rows.groupBy("at").agg(F.max(F.struct("key", "text")).alias("x"))
    heads = heads.selectExpr("x.key.doc_id as doc_id", "x.text as text", "x.key as key", f"element_at({before}, at) as at", "true as head")
    both = rows.withColumn("head", F.lit(False)).unionByName(heads).withColumn("own", F.expr(signature("text")))
    order = W.partitionBy("at").orderBy("head", F.desc("key"), F.desc("text"))
    after = both.select("*", *[F.lead(c).over(order).alias(f"_{c}") for c in ("text", "own")]).where("not head")
    half = "n_chars div 2"
    out = after.selectExpr("doc_id", "text", "own", "_text", "_own as next", "cast(char_length(text) as bigint) as n_chars")
    out = out.selectExpr(
        "doc_id", "n_chars", "own", "next", f"concat(left(text, int(n_chars - {half})), left(_text, int({half}))) as edited"
    )
    return out.selectExpr("doc_id", "n_chars", "edited", "own", f"{signature('edited')} as changed", "next")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: `doc_id`, `n_chars`, `edited_sha256`, both fingerprints and both likenesses."""
    return edited(docs, doc_id, text).selectExpr(
        "doc_id",
        "n_chars",
        "sha2(edited, 256) as edited_sha256",
        f"{printed('own')} as fingerprint",
        f"{printed('changed')} as edited_fingerprint",
        f"{likeness('own', 'changed')} as near_edited",
        f"{likeness('own', 'next')} as near_next",
    )
