import random

import numpy as np
import pytest
import xxhash

from skygauge.llm import simhash
from tests.llm.util import AWKWARD, SF, clashing, documents, given, words

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_print(text, size=3):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    of = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[of[p]] = min(d, least.get(of[p], d))
    return sorted(((d, f"{p:016x}", least.get(of[p])) for (d, _), p in zip(rows, prints)), key=str)


def found(df):
    return sorted(map(tuple, simhash.exact_groups(df).collect()), key=str)


def test_equals_brute_force_on_the_documents(spark):
    rows = given(spark, "documents", "doc_id", "text")
    assert found(spark.read.parquet(f"{SF}/documents.parquet")) == brute_groups(rows)


def test_awkward_rows(spark):
    small = [r for r in AWKWARD if len(r[1] or "") < 1_000] + [(8, "İ ẞ ALPHA b", "a"), (9, "two words", "b")]
    df = clashing(documents(spark, small), "node", "fingerprint", "component", "fp")
    assert found(df) == brute_groups([r[:2] for r in small])
    assert found(documents(spark).limit(0)) == []
    assert len(found(documents(spark))) == len(AWKWARD)


@pytest.mark.parametrize("long_list", [0, 2, 64])
def test_links_equal_all_pairs_for_short_and_long_lists(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LIST", long_list)
    draw = random.Random(7)
    nodes = set()
    for _ in range(30):
        base = draw.getrandbits(64)
        nodes |= {base} | {base ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for _ in range(8)}
    hot = draw.getrandbits(64)
    nodes |= {hot ^ 1 << i for i in range(16)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.exact_links(spark.createDataFrame([(signed(x),) for x in nodes], "node bigint")).collect()
    pairs = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in links}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, pairs))
    near = roots(sorted(nodes), lambda a, b: (a ^ b).bit_count() <= 2)
    assert roots(sorted(nodes), lambda a, b: frozenset((a, b)) in pairs) == near


def test_components_of_a_path_a_star_and_a_loop(spark):
    from skygauge.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(9, 9), (5, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(200, 260)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_near_groups_find_similar_documents_and_leave_others(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4_000)]
    rows = []
    for k in range(40):
        base = draw.choices(vocabulary, k=300)
        rows.append((len(rows), " ".join(base), "s"))
        for _ in range(3):  # four words replaced: similarity of about 0.87
            copy = list(base)
            for at in draw.sample(range(300), 4):
                copy[at] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "s"))
    group = {r["doc_id"]: r["component"] for r in simhash.near_groups(documents(spark, rows)).collect()}
    sets = {d: shingles(t) for d, t, _ in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if a < b and similar(a, b) >= 0.8]
    assert np.mean([group[a] == group[b] for a, b in pairs]) >= 0.95
    assert not any(group[a] == group[b] for a in sets for b in sets if a // 4 != b // 4)


def test_one_of_each_keeps_one_document_a_group(spark):
    df = clashing(documents(spark), "node", "component", "_copies", "_hash")
    out = simhash.one_of_each(df).collect()
    assert out[0].asDict().keys() == set(df.columns)
    texts = [r["text"] for r in out]
    assert texts.count("alpha beta gamma") == 1 and len([r for r in out if r["doc_id"] == 1]) == 1
    assert len([t for t in texts if not words(t)]) == 1
    assert simhash.one_of_each(df.limit(0)).count() == 0


def planted(draw, base, similarity):
    """A copy whose last words are others: of n shingles s are shared and s / (2n - s) is `similarity` or just above."""
    n = len(base) - 4
    shared = next(s for s in range(n + 1) if s >= similarity * (2 * n - s) - 1e-9)
    return base[: shared + 4] + [f"p{draw.getrandbits(60)}" for _ in range(n - shared)]


def near_pairs(spark, rows):
    group = {r["doc_id"]: r["component"] for r in simhash.near_groups(documents(spark, rows)).collect()}
    return group, roots(sorted(group), similar_sets({d: shingles(t) for d, t, _ in rows}))


def similar_sets(sets):
    return lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))


def test_near_groups_link_exactly_from_the_threshold_on(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        for similarity in (0.6, 0.7, 0.75, 0.79, 0.8, 0.82):
            base = [f"b{draw.getrandbits(60)}" for _ in range(draw.choice([49, 94, 184]))]
            at = len(rows)
            rows += [(at, " ".join(base), "s"), (at + 1, " ".join(planted(draw, base, similarity)), "s")]
            want[at] = len(shingles(rows[at][1]) & shingles(rows[at + 1][1])) / len(shingles(rows[at][1]) | shingles(rows[at + 1][1])) >= 0.8
    group = {r["doc_id"]: r["component"] for r in simhash.near_groups(documents(spark, rows)).collect()}
    assert {at: group[at] == group[at + 1] for at in want} == want
    assert len(set(group.values())) == len(rows) - sum(want.values())


@pytest.mark.parametrize("template", [70, 88])
def test_near_groups_in_a_large_template_family(spark, monkeypatch, template):
    monkeypatch.setattr(simhash, "NEAR_LIST", 4)
    draw = random.Random(template)
    frame = [f"t{i}" for i in range(template)]
    rows = []
    for k in range(600 if template == 70 else 150):
        base = frame + [f"o{draw.getrandbits(60)}" for _ in range(100 - template + draw.randrange(12))]
        rows.append((len(rows), " ".join(base), "s"))
        if k % 10 == 0:
            copy = base[:-5] + [f"c{draw.getrandbits(60)}" for _ in range(5)]
            rows.append((len(rows), " ".join(copy), "s"))
    group, want = near_pairs(spark, rows)
    same = lambda g: sorted(sorted(d for d in g if g[d] == v) for v in set(g.values()))
    assert same(group) == same(want)


@pytest.mark.parametrize("long_list", [0, 16])
def test_near_groups_equal_all_pairs_of_mixed_sizes(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "NEAR_LIST", long_list)
    draw = random.Random(3)
    parts = [[f"{k}x{i}" for i in range(12)] for k in range(9)]
    rows = []
    for d in range(60):
        text = [w for k in sorted(draw.sample(range(9), draw.randrange(5, 10))) for w in parts[k]]
        rows.append((d, " ".join(text[draw.randrange(6) :]), "s"))
    rows += [(200 + i, " ".join(f"s{j}" for j in range(i)), "s") for i in range(12)]
    group, want = near_pairs(spark, rows)
    same = lambda g: sorted(sorted(d for d in g if g[d] == v) for v in set(g.values()))
    assert same(group) == same(want)
