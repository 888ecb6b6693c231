import random
import re
import zlib
from collections import Counter

import pytest

from skygauge.llm import spelling
from tests.llm.util import AWKWARD, SF, clashing, documents, given

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spelling.ERROR == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= spelling.MIN_LENGTH and c >= spelling.MIN_COUNT}


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= spelling.RATIO * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(map(tuple, spelling.group_variants(df).collect()))


def test_equals_brute_force_on_the_documents(spark):
    rows = given(spark, "documents", "doc_id", "text")
    assert found(spark.read.parquet(f"{SF}/documents.parquet")) == brute(brute_counts(rows))


def test_awkward_rows(spark):
    rows = [*AWKWARD, (10, "Élevées élevées ÉLEVÉES " * 9, "a"), (None, "colour color colours " * 40 + "colöur " * 6, "b"), (11, "colour " * 300, "a")]
    df = clashing(documents(spark, rows), "word", "n", "a", "b", "id", "run")
    want = brute(brute_counts([r[:2] for r in rows]))
    assert found(df) == want and len(want) > 4
    assert spelling.group_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("longest", [0, 3, 64])
def test_every_pair_is_found_whatever_the_length_of_lists(spark, monkeypatch, longest):
    monkeypatch.setattr(spelling, "LIST", longest)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(500)}
    words |= {"common" + "".join(rng.choice("xyzw") for _ in range(5)) for _ in range(200)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w,) for w in sorted(words)], "word string"))
    got = [tuple(sorted(r)) for r in pairs.collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_lead_to_a_root(spark):
    words = [("abcdefgh", 5), ("abcdefghi", 25), ("abcdefghij", 125), ("abcdefghijk", 700), ("zzzzzz", 9), ("zzzzzy", 40)]
    df = spark.createDataFrame(words, "word string, n bigint")
    assert sorted(map(tuple, spelling.with_forms(df, spelling.near_pairs(df)).collect())) == brute(dict(words))
