import random
from collections import Counter

import pytest

from skygauge.llm import quality_rules as qr
from tests.llm.util import SF, clashing, documents, words


def brute(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(inside),
    )


def check(df):
    for r in qr.with_stats(df).collect():
        assert tuple(r[c] for c in qr.STATS) == brute(r["text"]), r["doc_id"]


def test_statistics_equal_brute_force_on_the_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_statistics_of_awkward_and_random_texts(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab #|<é\U0001f600\n\t ") for _ in range(draw.randrange(80))) for _ in range(150)]
    check(documents(spark))
    check(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))


def test_rules_learn_a_planted_conjunction():
    draw = random.Random(5)

    def row():
        values = {c: draw.random() for c in qr.FEATURES}
        return values, values["symbol_rate"] > 0.6 and values["word_length"] <= 0.5

    rules = qr.learn_list([row() for _ in range(600)], [row() for _ in range(300)])
    test = [row() for _ in range(500)]
    said = [any(all(c.holds(v) for c in rule) for rule in rules) for v, _ in test]
    assert sum(a == b for a, (_, b) in zip(said, test)) >= 475
    assert {c.feature for rule in rules for c in rule} >= {"symbol_rate", "word_length"}


@pytest.mark.parametrize("low", [True, False])
def test_one_class_teaches_nothing_wrong(low):
    rows = [({c: 0.5 for c in qr.FEATURES}, low)] * 10
    assert qr.learn_list(rows, rows) == []
    assert qr.learn_list([], []) == []


def test_rules_hold_out_on_larger_data(spark):
    """The list learned on the labels of one table rejects low and keeps high quality in another one."""
    read = lambda d, t: spark.read.parquet(f"/root/testdata/{d}/{t}.parquet")
    rules = qr.learn(read("sf0.01", "documents"), read("sf0.01", "labels"))
    judged = qr.judge(read("sf0.1", "documents"), rules).join(read("sf0.1", "labels"), "doc_id")
    found = {(r["kept"], r["quality"]): r["count"] for r in judged.groupBy("kept", "quality").count().collect()}
    right = found.get((True, 1), 0) + found.get((False, 0), 0)
    assert right >= 0.9 * sum(found.values()), found


def test_ordered_conditional_equals_the_rules(spark):
    rules = [
        (qr.Condition("word_length", True, 6.0),),
        (qr.Condition("symbol_rate", True, 0.01), qr.Condition("length", False, 300.0)),
    ]
    for r in qr.judge(spark.read.parquet(f"{SF}/documents.parquet"), rules).collect():
        n, chars, symbols, dup, repeat = brute(r["text"])
        failed = n < 50 or 100 * repeat > 50 * n
        values = None if failed else {
            "word_length": chars / n, "symbol_rate": symbols / n, "dup_line_rate": dup / n, "repeat_rate": repeat / n, "length": n,
        }
        first = None if failed else next((i for i, x in enumerate(rules, 1) if all(c.holds(values) for c in x)), None)
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, first, not failed and first is None)


def test_cases(spark):
    df = clashing(documents(spark), "n_words", "kept", "rule", "w", "g", "l")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 0), (99, 1)], "doc_id bigint, quality int")
    rules = qr.learn(df, labels)
    assert rules == []
    out = qr.judge(df, rules)
    rows = out.collect()
    assert len(rows) == 9 and all(r["a.b"] == "mine" and r["row"] == "mine" for r in rows)
    assert sum(r["kept"] for r in rows) == 0
    assert qr.judge(df.limit(0), qr.learn(df.limit(0), labels.limit(0))).count() == 0
