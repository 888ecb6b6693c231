import math

from skygauge.llm import mixing
from tests.llm.util import SF, clashing, documents, words


def shares(sizes):
    """Targets by resharing the excess, round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = 3 * sizes[s]
        left = sum(sizes.values()) - sum(full.values())


def check(rows):
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        n = len(words(r["text"]))
        assert r["size"] == n and r["taken"] in (0, n, 2 * n, 3 * n)
        for into, v in ((sizes, n), (taken, r["taken"])):
            into[r["source"]] = into.get(r["source"], 0) + v
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    want = shares(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    return taken, want


def test_targets_are_met_on_the_documents(spark):
    check(mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, want = check(rows)  # five times the documents: one of them is a small part of a source
    assert sum(abs(taken[s] - want[s]) for s in want) <= 0.01 * sum(want.values())


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df).select("doc_id", "taken").collect())
    assert key(docs) == key(docs.repartition(5, "lang"))


def test_awkward_rows_and_clashing_names(spark):
    df = clashing(documents(spark), "size", "target", "copies", "threshold", "planned")
    rows = mixing.mix(df).collect()
    assert len(rows) == 9 and all(r["a.b"] == "mine" and r["planned"] == "mine" for r in rows)
    check(rows)
    assert len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_hot_source_and_a_larger_budget_is_a_superset(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else "cold") for i in range(600)]
    df = documents(spark, rows)
    check(mixing.mix(df).collect())
    pick = lambda w: {
        r["doc_id"]: r["copies"] for r in mixing.mix(df, weights=w).where("source = 'hot'").collect()
    }
    small, large = pick((5, 2)), pick((5, 3))
    assert sum(small[d] > large[d] for d in small) <= 1  # but for the closing document


def test_repeated_rows_follow_copies(spark):
    df = documents(spark, [(i, "a b c", "x" if i < 4 else "y") for i in range(40)])
    mixed = mixing.mix(df)
    assert mixing.repeated(mixed, df.columns).count() == sum(r["copies"] for r in mixed.collect())
    assert mixing.repeated(mixed, df.columns).columns == df.columns
