import hashlib

from skygauge.llm import sharding
from tests.llm.util import AWKWARD, SF, clashing, documents


def bits(doc_id, text):
    part = lambda x: "-" if x is None else f"={x}"
    return f"{int(hashlib.md5('|'.join((part(doc_id), part(text))).encode()).hexdigest()[:15], 16):060b}"


def brute(rows, limit):
    """By document: the shortest prefix whose bytes fit."""
    sums = {}
    keyed = [(bits(*r[:2]), len((r[1] or "").encode())) for r in rows]
    for b, n in keyed:
        for d in range(61):
            sums[b[:d]] = sums.get(b[:d], 0) + n
    return [next(((b[:d], sums[b[:d]]) for d in range(61) if sums[b[:d]] <= limit), (b, sums[b])) for b, _ in keyed]


def test_equals_the_shortest_prefix_that_fits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for limit in (500, 20_000, 1 << 40):
        rows = sharding.shard(docs, limit=limit).collect()
        want = brute([(r["doc_id"], r["text"]) for r in rows], limit)
        assert [(r["shard"].split("+")[0], r["shard_bytes"]) for r in rows] == want
        assert len(rows) == docs.count()


def test_splits_past_the_first_round(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 2)
    rows = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), limit=3_000).collect()
    want = brute([(r["doc_id"], r["text"]) for r in rows], 3_000)
    assert [(r["shard"].split("+")[0], r["shard_bytes"]) for r in rows] == want


def test_identical_rows_overflow_into_pages(spark):
    df = documents(spark, [(7, "x" * 100, "a")] * 25).repartition(3)
    rows = sharding.shard(df, limit=350).collect()
    pages = {}
    for r in rows:
        assert "+" in r["shard"] and r["fits"]
        pages[r["shard"]] = pages.get(r["shard"], 0) + r["n_bytes"]
    assert len(rows) == 25 and max(pages.values()) <= 350
    assert all(r["shard_bytes"] == pages[r["shard"]] for r in rows)


def test_awkward_rows(spark, tmp_path):
    df = clashing(documents(spark), "shard", "n_bytes", "fits", "leaf", "at0", "bytes")
    out = sharding.shard(df, limit=1_000)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(r["a.b"] == "mine" and r["leaf"] == "mine" for r in rows)
    assert {r["doc_id"] for r in rows if not r["fits"]} == {5, 6}  # alone and larger than the limit
    assert sharding.shard(df.limit(0)).count() == 0
    sharding.write_shards(sharding.shard(documents(spark), limit=1_000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(AWKWARD)


def test_overflow_keeps_all_rows_when_the_directory_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DIRECTORY_ROWS", 0)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        given = [(k, f"{k} " + "x y z " * (50 + 7 * k), "a") for k in range(60) for _ in range(9)]
        rows = sharding.shard(documents(spark, given).repartition(3), limit=2_000).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    pages = {}
    for r in rows:
        pages[r["shard"]] = pages.get(r["shard"], 0) + r["n_bytes"]
    assert len(rows) == len(given)
    assert all(r["shard_bytes"] == pages[r["shard"]] and r["fits"] == (r["shard_bytes"] <= 2_000) for r in rows)
    assert {r["n_bytes"] > 2_000 for r in rows if not r["fits"]} == {True}  # only what is larger by itself
