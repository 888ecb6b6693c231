import random
from bisect import bisect_left

import numpy as np
from pyspark.sql import functions as F

from skygauge.operators import ordered as o


def test_carry_last_and_max(spark):
    rng = random.Random(5)
    rows = [("k" if rng.random() < 0.7 else "m", i, rng.choice([None, rng.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v int")
    got = o.carry(df, ["k"], "i", {"last_v": ("last", F.col("v")), "max_v": ("max", F.col("v"))}, chunk_rows=7).collect()
    last, top, want = {}, {}, {}
    for k, i, v in rows:
        want[k, i] = (last.get(k), top.get(k))
        if v is not None:
            last[k] = v
            top[k] = max(v, top.get(k, v))
    assert {(r.k, r.i): (r.last_v, r.max_v) for r in got} == want


def test_next_at_least(spark):
    rng = random.Random(9)
    points = sorted(rng.sample(range(5000), 200))
    lookups = [rng.randrange(5200) for _ in range(300)] + points[:20]
    p = spark.createDataFrame([("a", x) for x in points], "k string, at bigint")
    q = spark.createDataFrame([("a", x, i) for i, x in enumerate(lookups)], "k string, at bigint, tag bigint")
    for cell in (1, 64, 100_000):
        got = {r.tag: r.hit for r in o.next_at_least(p, q, ["k"], cell).collect()}
        for i, x in enumerate(lookups):
            j = bisect_left(points, x)
            assert got[i] == (points[j] if j < len(points) else None)


def test_exact_quantiles(spark):
    rng = random.Random(2)
    data = {"a": [rng.choice([1.0, 1.0, 1.0, rng.uniform(0, 50)]) for _ in range(3000)], "b": [4.0], "c": [1.0, 2.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    out = o.exact_quantiles(df, ["k"], "v", {n: o.rank_pair(q, F.col("n")) for n, q in points.items()})
    out = out.select("k", "n", *[o.interpolated(F.col(n), F.col("n"), q).alias(n) for n, q in points.items()])
    for r in out.collect():
        assert r.n == len(data[r.k])
        for n, q in points.items():
            assert abs(r[n] - np.quantile(data[r.k], q)) < 1e-9


def test_quantiles_of_awkward_values(spark):
    rng = random.Random(8)
    data = {
        "signs": [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(2000)] + [0.0, -0.0, 5e-324],
        "powers": [s * 2.0**k for k in range(-60, 60) for s in (1, -1, 1 - 2**-53, 1 + 2**-52)],
        "close": [1 + k * 2.0**-52 for k in range(3000)],
        "hot": [7.25] * 4000 + [rng.gauss(0, 1) for _ in range(100)],
        "ends": [float("-inf"), -1.0, 2.0, float("inf"), float("inf")],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(5)
    points = {f"p{k}": k / 16 for k in range(17)}
    out = o.exact_quantiles(df, ["k"], "v", {n: o.rank_pair(q, F.col("n")) for n, q in points.items()})
    for r in out.collect():
        ordered = sorted(data[r.k])
        for n, q in points.items():
            at = q * (len(ordered) - 1)
            assert (r[n].lo, r[n].hi) == (ordered[int(at)], ordered[-int(-at // 1)])
    nan = spark.createDataFrame([(1, float("nan")), (1, 3.0), (1, float("inf"))], "k int, v double")
    row = o.exact_quantiles(nan, ["k"], "v", {"low": (F.lit(0), F.lit(1))}).first()
    assert tuple(row.low) == (3.0, float("inf"))
    assert o.exact_quantiles(nan.limit(0), ["k"], "v", {"low": (F.lit(0), F.lit(0))}).count() == 0


def test_contains_matches_equals_brute_force(spark):
    rng = random.Random(4)
    letters = "ab가나 \n.😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(40)]
    names = {"".join(rng.choice(letters) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 7, 8)} | {"서울", "%", "_"}
    names |= {t[5:5 + n] for t, n in zip(texts, (9, 15, 16, 31, 33, 64, 100, 130)) if len(t) >= 5 + n}
    areas = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, t string")
    df = spark.createDataFrame([(n,) for n in names] + [("",)], "name string")
    got = {(r.id, r.name) for r in o.contains_matches(areas, "id", "t", df, "name").collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in names if n in t}
