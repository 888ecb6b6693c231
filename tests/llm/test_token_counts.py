import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skygauge.llm import token_counts as tc
from skygauge.llm.queries import TOKENIZER
from tests.llm.util import SF, clashing, documents

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def check(rows, exact):
    for r in rows:
        text = r["whole"]
        assert (r["n_bytes"], r["n_tokens"]) == (len((text or "").encode()), exact(text)), repr(text)[:200]
        assert r["over_limit"] == (r["n_tokens"] > 2048)


def counted(df, **more):
    return tc.count_tokens(df.withColumn("whole", df["text"]), PATH, **more).collect()


def test_equals_the_library_on_the_documents(spark, exact):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(counted(docs), exact)
    check(counted(docs, chunk=97), exact)


def test_random_texts(spark, exact):
    draw = random.Random(9)
    pool = (
        list("abcdeABC019 .,'!?-_<>|\n\t\r\x0b\x0c\x1c\x1f\x85  ​")
        + ["é", "é", "ß", "İ", "Σ", "ς", "中", "\U0001f600", "İ", "ﬁ", "가", "가", "٣", "Ⅷ", "'s", "'LL", "'re", "n't"]
        + ["<|startoftext|>", "<|endoftext|>", "<|", "the ", "ing ", "token"]
    )
    texts = ["".join(draw.choices(pool, k=draw.randrange(60))) for _ in range(1_500)]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    check(counted(df), exact)
    check(counted(df, chunk=7), exact)


def test_awkward_rows(spark, exact):
    df = clashing(documents(spark), "n_tokens", "over_limit", "_text", "_no", "maps", "_last")
    rows = counted(df)
    assert len(rows) == 9 and all(r["a.b"] == "mine" and r["maps"] == "mine" for r in rows)
    check(rows, exact)
    assert counted(df.limit(0)) == []


def test_states_are_bounded(monkeypatch):
    tables = tc.load(public_tokenizers.path("word_bpe_49k.json"))
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=30_000))
    want = tc.Counter(tables).count(text)
    monkeypatch.setattr(tc, "MOST_STATES", 500)
    counter = tc.Counter(tables)
    assert counter.count(text) == want and len(counter.transducer.states) <= 501
    assert counter.count("plain words " * 50) == tc.Counter(tables).count("plain words " * 50)


def merged(ranks, symbols):
    while len(symbols) > 1:
        rank, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
        if rank == 1 << 60:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def test_the_seam_decides_like_the_merges_and_is_kept_when_states_start_anew(monkeypatch):
    tables = tc.load(PATH)
    transducer = tc.Transducer(tables["vocab"], tables["ranks"])
    draw = random.Random(3)
    inner = sorted(t for t in tables["vocab"] if not t.endswith(tc.END) and transducer._may_follow(None, t))
    few = [t for t in inner if set(t) <= set("aeo")]  # merges of equal rank meet at these seams
    after = sorted(t for t in tables["vocab"] if t not in tables["special"])
    pairs = [(draw.choice(inner), draw.choice(after)) for _ in range(6_000)] + [(a, b) for a in few for b in few]
    for left, right in pairs:
        body = right.removesuffix(tc.END)
        symbols = list(left + body)
        symbols[-1] += right[len(body) :]
        assert transducer._may_follow(left, right) == (merged(tables["ranks"], symbols) == [left, right]), (left, right)
    monkeypatch.setattr(tc, "MOST_STATES", 200)
    counter = tc.Counter(tables)
    text = "".join(draw.choices("abcdefghij", k=5_000))
    counter.count(text)
    edges = dict(counter.transducer.edges)
    counter.count(text)
    assert edges and all(counter.transducer.edges[t] is e for t, e in edges.items())
