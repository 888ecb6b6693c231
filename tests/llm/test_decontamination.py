import math
import random

import numpy as np

from skygauge.llm import decontamination as dc
from tests.llm.util import SF, clashing, documents


def brute_retrieve(items, text, step):
    """All items whose share of BM25 in one window of the text reaches the threshold, without blocks or bounds."""
    bags = [(i, dc.words_of(q) + dc.words_of(a)) for i, q, a in items]
    bags = [(i, w) for i, w in bags if w]
    mean = np.mean([len(w) for _, w in bags])
    n = len(bags)
    holders = {}
    for _, w in bags:
        for t in set(w):
            holders[t] = holders.get(t, 0) + 1

    def impact(t, w):
        idf = math.log(1 + (n - holders[t] + 0.5) / (holders[t] + 0.5))
        tf = w.count(t)
        return idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(w) / mean))

    doc, out = dc.words_of(text), set()
    for at in range(0, max(1, len(doc)), step):
        window = set(doc[at : at + 2 * step])
        for i, w in bags:
            full = sum(impact(t, w) for t in set(w)) * min(1.0, step / len(w))
            if sum(impact(t, w) for t in set(w) & window) >= (dc.THRESHOLD - 1e-9) * full:
                out.add(i)
    return out


def test_block_max_retrieval_equals_scoring_everything(monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 3)
    draw = random.Random(2)
    vocabulary = [f"t{i}" for i in range(120)]
    say = lambda k: " ".join(draw.choices(vocabulary, k=k))
    items = [(i, say(draw.randrange(1, 40)), say(draw.randrange(0, 8))) for i in range(40)]
    texts = [say(draw.randrange(1, 200)) + " " + draw.choice(items)[1] + " " + say(30) for _ in range(25)]
    index = dc.build(items)
    get = index["terms"].get
    got = dc.retrieve(index, [np.array([get(w, -1) for w in dc.words_of(t)]) for t in texts])
    for d, text in enumerate(texts):
        assert {index["ids"][i] for x, i in got if x == d} == brute_retrieve(items, text, index["step"])


def test_planted_items_are_found_and_clean_documents_stay(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(30).collect()
    draw = random.Random(4)
    filler = lambda k: " ".join(f"filler{draw.randrange(5_000)}" for _ in range(k))
    rows = [(i, f"{filler(400)} {r['text'].upper()} {filler(300)}", "s") for i, r in enumerate(items)]
    clean = [(1_000 + i, filler(700), "s") for i in range(30)]
    table = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", *dc.question_and_answer())
    df = documents(spark, rows + clean)
    hits = {(r["doc_id"], r["item_id"]) for r in dc.matches(df, table).collect()}
    assert hits >= {(i, r["item_id"]) for i, r in enumerate(items)}
    assert {r["doc_id"] for r in dc.clean(df, table).collect()} == {i for i, _, _ in clean}


def test_segments_give_the_same_matches(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", *dc.question_and_answer())
    whole = {tuple(r)[:2] for r in dc.matches(docs, table).collect()}
    monkeypatch.setattr(dc, "SEGMENT_WORDS", 200)
    assert {tuple(r)[:2] for r in dc.matches(docs, table).collect()} == whole


def test_awkward_rows(spark):
    df = clashing(documents(spark), "item", "item_id", "hit")
    items = spark.createDataFrame(
        [(1, None, None), (2, "", " "), (3, "alpha beta", "gamma"), (4, "alpha beta", "gamma"), (None, "nothing like it here", None)],
        "item_id bigint, question string, answer string",
    )
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in dc.matches(df, items).collect())
    assert found == [(0, 3), (0, 4), (1, 3), (1, 3), (1, 4), (1, 4)]
    kept = dc.clean(df, items)
    assert kept.columns == df.columns and kept.count() == 6
    assert dc.matches(df.limit(0), items).count() == 0 and dc.matches(df, items.limit(0)).count() == 0
    assert dc.clean(df, items.limit(0)).count() == df.count()


def test_a_question_without_its_answer_is_no_match():
    question = " ".join(f"question{k}" for k in range(30))
    answer = " ".join(f"answer{k}" for k in range(6))
    index = dc.build([(1, question, answer), (2, question, "")])
    found = dc.search(index, [f"{question} {answer}", question, f"before {question} after"])
    assert [[index["ids"][i] for i, *_ in hits] for hits in found] == [[2, 1], [2], [2]]
    assert all(share >= dc.OVERLAP for hits in found for _, *shares in hits for share in shares)


def test_long_texts_are_queried_in_slices(monkeypatch):
    monkeypatch.setattr(dc, "BATCH_WORDS", 200)
    items = [(k, " ".join(f"q{k}x{j}" for j in range(20)), f"the answer {k} is number {k}") for k in range(5)]
    index = dc.build(items)
    filler = [f"w{k}" for k in range(3_000)]
    for at in range(0, 2_900, 37):
        words = filler[:at] + f"{items[3][1]} {items[3][2]}".split() + filler[at:]
        assert [index["ids"][i] for i, *_ in dc.search(index, [" ".join(words)])[0]] == [3]
