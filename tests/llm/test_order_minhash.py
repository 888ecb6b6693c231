import hashlib
import random
import re
import struct

import xxhash

from skygauge.llm import order_minhash as om
from tests.llm.util import AWKWARD, SF, clashing, documents, given, words


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def chained(parts):
    h = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return signed(h)


def long_bytes(x):
    return struct.pack("<q", x)


def brute_signature(text):
    """By order: number and tuple hash, from all occurrences sorted in plain Python."""
    s = words(text)
    joined = (text or "").strip(" \t\n\v\f\r")
    if not s:
        return []
    if len(joined) > om.LONG * len(s):
        s = re.findall(rf"(?s).{{1,{om.PIECE}}}", joined)
    grams = [s[i : i + om.K] for i in range(len(s) - om.K + 1)] or [s]
    seen, found = {}, []
    for at, g in enumerate(grams):
        h = chained(g) >> om.PLACE_BITS
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = chained([long_bytes(h), struct.pack("<i", n)]) >> om.PLACE_BITS
        found.append((h, at))
    by_order = {}
    for h, at in sorted(found):
        by_order.setdefault((h >> 32) & (om.BINS - 1), []).append((h, at))
    out = []
    for order, minima in by_order.items():
        in_text = [long_bytes(h) for h, _ in sorted(minima[:2], key=lambda x: x[1])]
        out.append(order << 32 | chained(in_text) & 0xFFFFFFFF)
    return sorted(out, key=lambda x: (x >> 32) ^ om.BINS >> 1)  # hashes are signed: the upper half of the orders comes first


def brute_likeness(a, b):
    orders = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(orders) if orders else 1.0


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, chained([r[1] or ""]), r[1] or "")
    rows = sorted(rows, key=key, reverse=True)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = map(brute_signature, (text, edited, after))
        show = lambda s: "".join(f"{x:010x}" for x in s)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), sha, show(own), show(changed), brute_likeness(own, changed), brute_likeness(own, following)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, om.fingerprints(df).collect()), key=str)


def test_equals_brute_force_on_the_documents(spark):
    assert found(spark.read.parquet(f"{SF}/documents.parquet")) == brute(given(spark, "documents", "doc_id", "text"))


def test_awkward_rows(spark):
    rows = [*AWKWARD, (9, "one two", "b"), (10, "日本語" * 40, "b"), (11, "a b a b " * 50, "c"), (12, "𝄞 clef 𝄞 clef 𝄞", "c"), (9, "tie", None)]
    df = clashing(documents(spark, rows), "key", "at", "own", "n_chars", "head", "edited")
    assert found(df) == brute([r[:2] for r in rows])
    assert om.fingerprints(df.limit(0)).count() == 0
    one = om.fingerprints(documents(spark, [(1, "alone in the table", "a")])).first()  # its next document is itself
    assert one["near_next"] == 1.0 and one["n_chars"] == 18


def test_many_ranges_give_the_same_rows(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    want = found(df)
    for ranges in (1, 2, 7):
        monkeypatch.setattr(om, "RANGES", ranges)
        assert found(df) == want


def test_order_and_repeats_count(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    near = base[:200] + [f"v{k}" for k in range(5)] + base[205:]
    moved = [w for k in range(0, 400, 8) for w in base[392 - k : 400 - k]]
    rows = [(k, " ".join(w), "a") for k, w in enumerate((base, near, moved, base * 3))]
    got = documents(spark, rows).selectExpr(f"{om.signature('text')} as s", "doc_id").orderBy("doc_id").collect()
    same = [brute_likeness(got[0]["s"], r["s"]) for r in got]
    assert same[0] == 1 and same[1] > 0.9 and same[1] > same[2] and 0.0 < same[3] < 0.6
    words_of = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    assert words_of(base) == words_of(base * 3) - (words_of(base * 3) - words_of(base))  # a set of shingles sees no repeat


def test_only_spark_functions(spark):
    df = om.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|ArrowEval|Cartesian|NestedLoop", plan)
