"""Spelling variants: words one edit apart, grouped under the most frequent form.

Pairs are found by asymmetric q-chunks. The shorter word of a pair (of two equally long ones the first in code-point
order) contributes two disjoint chunks, its first q characters and the next q, q being half its length. The other
word contributes its positional grams of q characters. One edit touches one of the two chunks at most, so the other
stands in the longer word, moved by one place at most: chunks and grams join on their text and a place within one.
What joins is verified by its edit distance. A word thus files two rows as the shorter one and five grams for each of
the two sizes q that its partners can have (grams elsewhere are over one place from both chunks).

A list of over `LIST` words (a frequent beginning or ending) is not paired. Its words file themselves under
themselves and under what remains when one character is left out, which two words one edit apart share: exact, and
a list under such a key holds at most the words that one character tells apart. No list is cut.

Words are counted where they stand before anything is shuffled. A form has at least `RATIO` times the word's count, so
following forms ends after a logarithmic number of steps, taken by pointer doubling over the table of words.

Defined cases: a null or empty text has no words; a null id counts as empty in the key of the typing error; a word that
the error leaves too short is dropped with all others below `MIN_LENGTH`; repeated rows count repeatedly; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.operators.ordered import cut_lineage

WORD = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: One occurrence in so many is mistyped by `typed`.
ERROR = 199
LIST = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts (`word`), one row an occurrence; one in `ERROR` lacks a character, by a hash of id and word."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _LOWER), F.lit(WORD), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    keyed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = "int(pmod(h, char_length(run)))"
    return keyed.selectExpr(f"if(h % {ERROR} = 0, concat(left(run, {at}), substring(run, {at} + 2)), run) as word")


def counted(occurrences: DataFrame) -> DataFrame:
    """`word, n` of the words that are long and frequent enough."""
    long = occurrences.where(f"char_length(word) >= {MIN_LENGTH}")
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MIN_COUNT}")


def _filed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (`length, part, gram, a`) and grams (`length, part, gram, b`) of the words; `length` is that of the shorter
    word, and a gram is filed under the part of the shorter word that its place, within one, belongs to."""
    size = "int(length div 2)"
    chunks = words.selectExpr("word as a", "char_length(word) as length", "explode(array(0, 1)) as part").selectExpr(
        "length", "part", f"substring(a, part * {size} + 1, {size}) as gram", "a"
    )
    sides = words.selectExpr("word as b", "explode(array(0, 1)) as shift").selectExpr("b", "char_length(b) - shift as length", "shift")
    # equally long words keep their places; in a longer word a chunk stays or moves by one
    grams = sides.selectExpr("b", "length", "explode(array(0, 1)) as part", "shift").selectExpr(
        "b", "length", "part", "explode(sequence(0, shift)) as moved"
    )
    grams = grams.selectExpr("length", "part", f"substring(b, part * {size} + moved + 1, {size}) as gram", "b")
    return chunks, grams.where(f"char_length(gram) = {size}").distinct()


_SHORTER = "(char_length(a) < char_length(b) or (char_length(a) = char_length(b) and a < b))"


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs `a, b` of the distinct `word`s that differ by exactly one insertion, deletion or replacement; `a` is the
    shorter one."""
    chunks, grams = _filed(words)
    lists = ["length", "part", "gram"]
    held = (
        chunks.selectExpr(*lists, "1L as c", "0L as g")
        .unionAll(grams.selectExpr(*lists, "0L as c", "1L as g"))
        .groupBy(lists)
        .agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
        .where("c > 0 and g > 1")  # a word meets itself
    )
    held = cut_lineage(held.selectExpr(*lists, f"c > {LIST} and g > {LIST} as long"))
    chunks, grams = cut_lineage(chunks.join(held, lists)), cut_lineage(grams.join(held, lists))
    short = chunks.where("not long").drop("long").join(grams.where("not long").drop("long"), lists)
    short = short.where(f"{_SHORTER} and levenshtein(a, b, 1) = 1").select("a", "b")
    long = _left_out(chunks.where("long").select("a").distinct(), grams.where("long").select("b").distinct())
    return cut_lineage(short.unionAll(long).distinct())


def _left_out(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """The pairs of long lists: the shorter word equals the longer one, or both are equal, without one character."""
    without = "array_distinct(transform(sequence(1, char_length({0})), i -> concat(left({0}, i - 1), substring({0}, i + 1))))"
    mine = shorter.selectExpr("a", f"explode(array_append({without.format('a')}, a)) as rest")
    other = longer.selectExpr("b", f"explode({without.format('b')}) as rest")
    return mine.join(other, "rest").where(f"{_SHORTER} and levenshtein(a, b, 1) = 1").select("a", "b")


def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """`word, n` with `form` (null if none), `form_n`, `n_near` and `root`."""
    both = pairs.selectExpr("a as word", "b as near").unionAll(pairs.selectExpr("b", "a"))
    both = both.join(words.selectExpr("word as near", "n as near_n"), "near")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    form = words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) as n_near", f"if(-best.less >= {RATIO} * n, best, null) as best"
    )
    form = cut_lineage(form.selectExpr("word", "n", "n_near", "best.near as form", "-best.less as form_n"))
    up = form.where("form is not null").selectExpr("word", "form as root")
    while True:  # each round doubles the steps that are known
        further = up.join(up.selectExpr("word as root", "root as next"), "root", "left")
        up = cut_lineage(further.selectExpr("word", "coalesce(next, root) as root", "next is not null as moved"))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    out = form.join(up.select("word", "root"), "word", "left")
    return out.selectExpr("word", "form", "coalesce(root, word) as root", "n", "n_near", "form_n")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a word of the texts: `word, form, root, n, n_near, form_n`."""
    words = cut_lineage(counted(typed(docs, doc_id, text)))
    return with_forms(words, near_pairs(words))
