"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The items are indexed by terms with their BM25 impacts, divided by the score that an item gets from its own text, so
that one threshold holds for all items. Items are ordered by length and cut into blocks of `BLOCK`; each term keeps
its largest impact in each block. A passage can only reach the threshold in a block if the block maxima of its terms
add up to it (block-max WAND): this bound is computed for all passages and blocks of a batch at once, and only the
blocks that survive are scored in full. All items at or above the threshold are retrieved, not a top list.

Passages are windows of two steps that overlap by one, with a step no shorter than the longest item of the index (up
to `LONGEST` words), so that an item copied into a text lies in one passage as a whole. Retrieved pairs are verified
on the whole document: 0.8 of the item's 5-word shingles, of the question alone, of those that end in the answer, and of
all together, must occur in it. A text of many words is queried in slices that share two steps.

The index has a bound: items are dealt by hash into segments of about `SEGMENT_WORDS` words, each with its own
statistics, and every document queries one broadcast segment after the other. A benchmark of usual size is one.

Words are runs of ASCII letters and digits or of non-ASCII characters, case-folded.

Defined cases: an item without words matches nothing; an item of fewer than five words is one shingle; null or empty
texts hold nothing; null ids stay null; repeated items are found each, repeated documents judged each; without items
all documents are clean; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
SHORTEST, LONGEST = 32, 256
SEGMENT_WORDS = 2_000_000
#: Words that are queried together, and the most cells of passages by blocks.
BATCH_WORDS = 400_000
BATCH_CELLS = 4_000_000

_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").casefold().encode().translate(_TABLE).split()


def grams(words: list[bytes], n: int) -> set[bytes]:
    return set(map(b" ".join, zip(*[words[i:] for i in range(n)])))


def build(items: list[tuple]) -> dict:
    """The index of `(item_id, question, answer)` as plain values."""
    rows = []
    for item, question, answer in items:
        q, a = words_of(question), words_of(answer)
        if q or a:
            rows.append((len(q) + len(a), q, a, item))
    rows.sort(key=lambda r: r[0])
    n = len(rows)
    lengths = np.array([r[0] for r in rows], float)
    step = int(min(max(lengths.max(initial=0), SHORTEST), LONGEST))
    terms: dict[bytes, int] = {}
    postings: list[dict[int, int]] = []
    for i, (_, q, a, _) in enumerate(rows):
        for word in q + a:
            t = terms.setdefault(word, len(terms))
            if t == len(postings):
                postings.append({})
            postings[t][i] = postings[t].get(i, 0) + 1
    mean = lengths.mean() if n else 1.0
    own, entries = np.zeros(n), []
    for t, found in enumerate(postings):
        idf = math.log(1 + (n - len(found) + 0.5) / (len(found) + 0.5))
        for i, tf in found.items():
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))
            own[i] += impact
            entries.append((t, i, impact))
    # a passage holds a step of a longer item at least
    full = own * np.minimum(1.0, step / np.maximum(lengths, 1))
    term = np.array([e[0] for e in entries], np.int64)
    item = np.array([e[1] for e in entries], np.int64)
    impact = np.array([e[2] for e in entries], float) / full[item] if entries else np.zeros(0)
    block_key, at = np.unique(term * (n // BLOCK + 1) + item // BLOCK, return_inverse=True)
    block_max = np.zeros(len(block_key))
    np.maximum.at(block_max, at, impact)
    ends = np.arange(len(terms) + 1)
    return {
        "terms": terms,
        "step": step,
        "blocks": n // BLOCK + 1,
        "item": item,
        "impact": impact,
        "start": np.searchsorted(term, ends),
        "block": block_key % (n // BLOCK + 1),
        "block_max": block_max,
        "block_start": np.searchsorted(block_key // (n // BLOCK + 1), ends),
        "shingles": [_proof(q, a) for _, q, a, _ in rows],
        "ids": [r[3] for r in rows],
    }


def _proof(question: list[bytes], answer: list[bytes]) -> tuple[int, set, set, set]:
    """Shingle length, shingles of the question, of question and answer, and those that end in the answer."""
    whole = question + answer
    n = min(SHINGLE, len(whole))
    all_of, asked = grams(whole, n), grams(question, min(n, len(question) or 1)) if len(question) >= n else set()
    return n, asked, all_of, all_of - asked


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions start[i] .. start[i] + count[i] - 1."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - before, count)


def retrieve(index: dict, docs: list[np.ndarray]) -> set[tuple[int, int]]:
    """(document, item) of all passages and items at or above the threshold; `docs` are term numbers, -1: not indexed."""
    step, n_terms, blocks = index["step"], len(index["terms"]), index["blocks"]
    sizes = np.array([len(d) for d in docs])
    halves = -(-sizes // step)
    first_half = np.cumsum(halves) - halves
    ids = np.concatenate(docs)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    half = np.repeat(first_half, sizes) + place // step
    known = ids >= 0
    ids, half, place = ids[known], half[known], place[known]
    # passage h is half h and the next one; a term counts once a passage
    later = place >= step
    pairs = np.unique(np.concatenate([half * n_terms + ids, (half[later] - 1) * n_terms + ids[later]]))
    passage, term = pairs // n_terms, pairs % n_terms
    count = index["block_start"][term + 1] - index["block_start"][term]
    at = _ranges(index["block_start"][term], count)
    bound = np.bincount(
        np.repeat(passage, count) * blocks + index["block"][at], index["block_max"][at], minlength=int(halves.sum()) * blocks
    )
    found = set()
    doc_of = np.repeat(np.arange(len(docs)), halves)
    for cell in np.nonzero(bound >= THRESHOLD - 1e-9)[0]:
        p, b = divmod(int(cell), blocks)
        own = term[np.searchsorted(passage, p) : np.searchsorted(passage, p + 1)]
        at = _ranges(index["start"][own], index["start"][own + 1] - index["start"][own])
        at = at[index["item"][at] // BLOCK == b]
        score = np.bincount(index["item"][at] - b * BLOCK, index["impact"][at])
        found |= {(int(doc_of[p]), b * BLOCK + int(i)) for i in np.nonzero(score >= THRESHOLD - 1e-9)[0]}
    return found


def verify(index: dict, text: str, item: int, known: dict[int, set]) -> tuple[float, float] | None:
    """Overlap of question and answer if the document holds the item; `known` keeps its shingles by length."""
    n, asked, whole, answered = index["shingles"][item]
    if n not in known:
        known[n] = grams(words_of(text), n)
    share = lambda part: len(part & known[n]) / len(part) if part else 1.0
    if min(share(whole), share(asked), share(answered)) < OVERLAP:
        return None
    return share(asked), share(answered)


def search(index: dict, texts: list[str | None]) -> list[list[tuple[int, float, float]]]:
    """By text: the items it holds, with their overlaps."""
    out: list[dict] = [{} for _ in texts]
    most = min(BATCH_WORDS, BATCH_CELLS * index["step"] // index["blocks"])
    at, queue, waiting = [], [], 0

    def flush() -> None:
        known: dict[int, dict] = {}
        for d, item in sorted(retrieve(index, queue)):
            doc = at[d]
            shares = None if item in out[doc] else verify(index, texts[doc], item, known.setdefault(doc, {}))
            if shares:
                out[doc][item] = shares

    get = index["terms"].get
    for i, text in enumerate(texts):
        found = words_of(text)
        if not found or not index["shingles"]:
            continue
        terms = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        shared = 2 * index["step"]
        size = max(most, 2 * shared)
        for start in range(0, max(1, len(terms) - shared), size - shared):
            part = terms[start : start + size]
            at.append(i)
            queue.append(part)
            waiting += len(part)
            if waiting >= most:
                flush()
                at, queue, waiting = [], [], 0
    if queue:
        flush()
    return [[(item, *shares) for item, shares in sorted(found.items())] for found in out]


def _searcher(shared: Broadcast):
    @F.pandas_udf("array<struct<item:int,question_overlap:double,answer_overlap:double>>")
    def hits(texts: pd.Series) -> pd.Series:
        found = search(shared.value, list(texts))
        keys = ("item", "question_overlap", "answer_overlap")
        return pd.Series([[dict(zip(keys, x)) for x in row] for row in found], dtype=object)

    return hits


def _segments(items: DataFrame) -> list[tuple[Broadcast, DataFrame]]:
    """Broadcast indexes, and the ids of their items by number."""
    spark = items.sparkSession
    size = items.agg(F.sum(F.expr("char_length(coalesce(question, '')) + char_length(coalesce(answer, ''))"))).first()[0]
    n = max(1, -(-(size or 0) // (6 * SEGMENT_WORDS)))
    out = []
    for k in range(n):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, question), {n}) = {k}")).orderBy("item_id", "question", "answer").collect()
        index = build([tuple(r) for r in rows])
        kind = items.schema["item_id"].dataType.simpleString()
        names = spark.createDataFrame(list(enumerate(index.pop("ids"))), f"item int, item_id {kind}")
        out.append((spark.sparkContext.broadcast(index), names))
    return out


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item it holds: `doc_id`, `item_id`, `question_overlap`, `answer_overlap`.

    `items` has `item_id`, `question` and `answer` (null: none).
    """
    found = []
    for shared, names in _segments(items.select("item_id", "question", "answer")):
        hits = docs.select(F.col(doc_id).alias("doc_id"), F.explode(_searcher(shared)(F.col(text))).alias("hit"))
        # an index has a bounded number of items
        found.append(hits.select("doc_id", "hit.*").join(F.broadcast(names), "item").drop("item"))
    return reduce(DataFrame.unionAll, found).select("doc_id", "item_id", "question_overlap", "answer_overlap")


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold none of the items, with all their columns."""
    for shared, _ in _segments(items.select("item_id", "question", "answer")):
        docs = docs.where(F.size(_searcher(shared)(F.col(text))) == 0)
    return docs


def question_and_answer(text: str = "text") -> list[Column]:
    """Items of one text: the last sentence is taken as the answer, all before as the question."""
    cut = r"(?s)^(.*[.!?])\s+(\S.*)$"
    question = F.regexp_extract(text, cut, 1)
    return [
        F.when(question == "", F.col(text)).otherwise(question).alias("question"),
        F.regexp_extract(text, cut, 2).alias("answer"),
    ]
