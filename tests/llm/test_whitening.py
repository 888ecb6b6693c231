import math

import numpy as np
import pytest

from skygauge.llm import whitening
from tests.llm.util import SF, clashing, given


def brute(rows, components=16):
    """Everything by whole-number arithmetic and a full eigendecomposition."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in ok]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in ok if len(v) == d]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    a = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], float) / n
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    return xs, n, s, e, q


def compare(got, rows, components=16):
    xs, n, s, e, q = brute(rows)
    rank = min(components, int((e > 1e-13 * e[0]).sum()))
    assert len(got) == len(xs) * rank
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r)
    assert sorted(by_component) == list(range(1, rank + 1))
    for k, rs in by_component.items():
        assert {r["n"] for r in rs} == {n}
        assert rs[0]["explained"] == pytest.approx(e[k - 1] / e.sum(), rel=1e-9)
        assert rs[0]["identity_error"] < 1e-9
        want = sorted((-1 if i is None else i, sum((n * c - t) ** 2 for c, t in zip(x, s))) for i, x in xs)
        assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in rs) == want
        mine = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["whitened"]) for r in rs)
        other = sorted(
            (-1 if i is None else i, sum((n * c - t) / n * p for c, t, p in zip(x, s, q[:, k - 1])) / math.sqrt(e[k - 1])) for i, x in xs
        )
        gap = min(abs(e[k - 1] - v) for j, v in enumerate(e) if j != k - 1) / e[0]
        if gap > 1e-4:
            sign = np.sign(np.dot([m[1] for m in mine], [o[1] for o in other]))
            assert [sign * m[1] for m in mine] == pytest.approx([o[1] for o in other], rel=1e-6, abs=1e-7)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def test_equals_a_full_decomposition_on_the_embeddings(spark):
    rows = given(spark, "embeddings", "vec_id", "embedding")
    compare(whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")).collect(), rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    v = [list(map(float, x)) for x in rng.normal(size=(40, 5)) * [8, 4, 2, 1, 0.5]]
    rows = [(k, x, k) for k, x in enumerate(v)]
    rows += [(3, v[3], 0), (None, v[4], None), (50, None, 1), (51, [], 1), (52, [1.0, None, 2.0, 3.0, 4.0], 1)]
    rows += [(53, [float("nan")] * 5, 1), (54, [1.0, 2.0, 3.0, 4.0, float("-inf")], 1), (55, [1.0], 1), (56, v[0][:4], 1)]
    df = clashing(frame(spark, rows), "x", "n", "component", "d", "v")
    compare(whitening.whiten(df).collect(), [r[:2] for r in rows])
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(k, v[0], 1) for k in range(9)])).count() == 0


def test_fewer_directions_than_dimensions_and_equal_values(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-40, 40, size=(60, 3)) @ rng.integers(-3, 4, size=(3, 8)) / 64.0  # rank 3
    rows = [(k, list(map(float, x)), 0) for k, x in enumerate(flat)]
    compare(whitening.whiten(frame(spark, rows)).collect(), [r[:2] for r in rows])
    cross = [[s * 2.0 if j == k else 0.0 for j in range(6)] for k in range(6) for s in (-1, 1)]  # six equal values
    got = whitening.whiten(frame(spark, [(k, x, 0) for k, x in enumerate(cross)])).collect()
    assert len(got) == 12 * 6 and all(r["explained"] == pytest.approx(1 / 6) and r["identity_error"] < 1e-9 for r in got)


def test_stops_when_converged(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FULL_STEPS", 8)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 120)) * (30 * 0.5 ** np.arange(120) + 0.2)
    rows = [(k, list(map(float, x)), 0) for k, x in enumerate(v)]
    compare(whitening.whiten(frame(spark, rows), components=4).collect(), [r[:2] for r in rows], 4)


def test_large_entries(spark):
    rows = [(k, [1e12 * k, float(k * k), -3.0 * k], 0) for k in range(6)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


def test_a_small_fit_list_is_one_task_however_many_partitions_it_comes_from(spark):
    rng = np.random.default_rng(6)
    rows = [(k, list(map(float, x)), 0) for k, x in enumerate(rng.normal(size=(200, 4)))]
    seen = []
    fit = whitening.Fit.__init__

    def kept(self, blocks, d):
        seen.append(blocks)
        fit(self, blocks, d)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(whitening.Fit, "__init__", kept)
        before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            compare(whitening.whiten(frame(spark, rows)).collect(), [r[:2] for r in rows])
        finally:
            for key, value in before.items():
                spark.conf.set(key, value) if value else spark.conf.unset(key)
    assert seen[0].rdd.getNumPartitions() == 1
