import corpus_pipeline
from skygauge.llm import decontamination, queries, quality_rules, simhash
from tests.llm.test_mixing import check as mixed_right
from tests.llm.test_sharding import brute as brute_shards
from tests.llm.test_simhash import brute_groups
from tests.llm.util import SF


def test_stages_and_run_agree(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == first.columns
        kept.append([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    quality, single, clean, mixed, sharded = kept
    rules = quality_rules.learn(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(quality) == {
        (r["doc_id"], r["text"], r["source"]) for r in quality_rules.judge(first, rules).where("kept").collect()
    }
    assert set(single) <= set(quality)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.exact_groups(spark.read.parquet(f"{tmp_path}/0")).collect()}
    assert sorted(r[0] for r in single) == sorted(
        min(d for d in groups if groups[d] == g) for g in set(groups.values())
    )
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", *decontamination.question_and_answer())
    dirty = {r["doc_id"] for r in decontamination.matches(spark.read.parquet(f"{tmp_path}/1"), items).collect()}
    assert sorted(clean) == sorted(r for r in single if r[0] not in dirty)
    copies = {r: mixed.count(r) for r in clean}
    assert set(mixed) <= set(clean) and max(copies.values()) <= 3
    mixed_right(corpus_pipeline.mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect())
    rows = docs.collect()
    assert [(r["shard"].split("+")[0], r["shard_bytes"]) for r in rows] == brute_shards(
        [(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.sharding.LIMIT_BYTES
    )
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, rows))


def test_near_duplicates_are_the_groups_of_the_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    least = {d: g for d, _, g in brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_all_operators_are_registered():
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
