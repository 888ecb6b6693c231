import random

from skygauge.llm import line_dedup
from tests.llm.util import AWKWARD, SF, clashing, documents, words


def test_alignment_is_a_common_subsequence_that_holds_unique_lines():
    draw = random.Random(1)
    for _ in range(300):
        a = [draw.randrange(12) for _ in range(draw.randrange(14))]
        b = [draw.randrange(12) for _ in range(draw.randrange(14))]
        pairs = line_dedup.align(list(enumerate(a)), list(enumerate(b)))
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        same = sorted(draw.sample(range(1_000), 9))
        assert line_dedup.align(list(enumerate(same)), list(enumerate(same))) == [(i, i) for i in range(9)]


def test_shared_passages_go_from_all_but_the_first(spark):
    draw = random.Random(8)
    line = lambda: " ".join(f"v{draw.randrange(9_000)}" for _ in range(15))
    passage = [line() for _ in range(4)]  # 60 words
    rows, own = [], {}
    for i in range(60):
        own[i] = [line() for _ in range(6)]
        at = draw.randrange(7)
        rows.append((i, "\n".join(own[i][:at] + (passage if i % 3 == 0 else []) + own[i][at:]), "s"))
    out = {r["doc_id"]: r for r in line_dedup.dedup(documents(spark, rows)).collect()}
    assert out[0]["text"] == rows[0][1]
    for i in range(1, 60):
        assert out[i]["text"].split("\n") == own[i]
        assert out[i]["n_removed"] == (4 if i % 3 == 0 else 0)


def run_sets(text, least=10):
    """Each shortest run of neighbouring lines with `least` words, with the line numbers of its places."""
    held = [x.strip(" \t-\r") for x in text.split("\n") if words(x)]
    out = {}
    for i in range(len(held)):
        for j in range(i + 1, len(held) + 1):
            n = sum(len(words(x)) for x in held[i:j])
            if n >= least and (n - len(words(held[i])) < least or n - len(words(held[j - 1])) < least):
                out.setdefault(tuple(held[i:j]), []).append(range(i, j))
    return out, held


def test_equals_brute_force_over_all_pairs(spark):
    draw = random.Random(4)
    line = [" ".join(f"w{k}{i}" for i in range(1 + k % 6)) for k in range(8)] + [" ".join("long" for _ in range(12))]
    rows = [(i, "\n".join(draw.choice([*line, "", " "]) for _ in range(draw.randrange(14))), "s") for i in range(60)]
    out = {r["doc_id"]: r for r in line_dedup.dedup(documents(spark, rows)).collect()}
    earlier, removed = set(), 0
    for i, text, _ in rows:
        found, held = run_sets(text)
        short = lambda run: sum(len(words(x)) for x in run[1:]) < 10 or sum(len(words(x)) for x in run[:-1]) < 10
        gone = {p for run, places in found.items() if run in earlier and short(run) for at in places for p in at}
        assert [x for x in out[i]["text"].split("\n") if words(x)] == [x for p, x in enumerate(held) if p not in gone], i
        earlier |= set(found)
        removed += len(gone)
    assert removed > 50


def test_a_passage_of_lines_that_others_hold_alone_goes(spark):
    short = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(12)]
    rows = [(i, short[i] + f"\nown words of {i}", "s") for i in range(12)]
    rows += [(k, f"start {k}\n" + "\n".join(short) + f"\nend {k}", "s") for k in (20, 21)]
    out = {r["doc_id"]: r for r in line_dedup.dedup(documents(spark, rows)).collect()}
    assert all(out[k]["n_removed"] == 0 for k in (*range(12), 20))
    assert out[21]["text"] == "start 21\nend 21"


def test_two_documents_and_moved_blocks(spark):
    one, two = ([f"{c}{i} of the block with ten words or more in each line" for i in range(6)] for c in "xy")
    rows = [(1, "\n".join(one + two), "s"), (2, "\n".join([*two, "between", *one]), "s")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(documents(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "between"}


def test_documents_keep_lines_in_order_and_their_first_holder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = line_dedup.dedup(docs).collect()
    assert len(after) == len(before)
    worded = lambda t: [x.strip(" \t-\r") for x in (t or "").split("\n") if words(x)]
    left = set()
    for r in after:
        rest = iter((before[r["doc_id"]] or "").split("\n"))
        assert r["n_removed"] == 0 or not r["text"] or all(x in rest for x in r["text"].split("\n"))
        assert r["n_lines"] == len(worded(before[r["doc_id"]]))
        assert len(worded(r["text"])) == r["n_lines"] - r["n_removed"]
        left |= set(map(str.strip, worded(r["text"])))
    assert left == {x.strip() for t in before.values() for x in worded(t)}


def test_awkward_rows(spark):
    df = clashing(documents(spark), "doc", "gone", "n_lines", "at", "line")
    rows = line_dedup.dedup(df).collect()
    assert len(rows) == len(AWKWARD) and all(r["a.b"] == "mine" and r["gone"] == "mine" for r in rows)
    assert [r["n_lines"] for r in rows if r["text"] is None] == [0, 0]
    assert line_dedup.dedup(df.limit(0)).count() == 0
