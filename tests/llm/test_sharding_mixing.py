from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing, sharding
from lodestar.runtime import scratch, table


def files(*sizes):
    return [{"file": f"f{i:03d}", "bytes": s, "version": i} for i, s in enumerate(sizes)]


def test_plan_merges_similar_sizes_only():
    assert sharding.plan(files(10, 10, 10), target=1000, fanout=4, floor=16) == []
    assert sharding.plan(files(10, 12, 9, 16), target=1000, fanout=4, floor=16) == [["f000", "f001", "f002", "f003"]]
    assert sharding.plan(files(10, 12, 300, 9, 16), target=1000, fanout=4, floor=16) == [["f000", "f001", "f003", "f004"]]
    assert sharding.plan(files(*[40] * 6), target=100, fanout=4, floor=16) == [["f000", "f001"], ["f002", "f003"], ["f004", "f005"]]
    assert sharding.plan(files(600, 600, 600, 600), target=1000, fanout=4, floor=16) == []


def test_compaction_keeps_rows_and_versions(spark, docs_of):
    store = sharding.ShardStore(spark, scratch(spark, "shards"), target=200_000, fanout=3, floor=2000)
    for k in range(7):
        store.append(docs_of([f"text {k} {i} " * 20 for i in range(50)], first=1000 * k).coalesce(1))
    before = sorted(map(tuple, store.read().drop("_shard").collect()))
    seven = store.version()
    store.compact()
    assert sorted(map(tuple, store.read().drop("_shard").collect())) == before
    assert len(store.files()) < 7 and store.version() > seven
    assert sorted(map(tuple, store.read(seven).drop("_shard").collect())) == before  # old versions stay until vacuum
    assert sharding.plan(store.files(), target=200_000, fanout=3, floor=2000) == []
    assert store.vacuum() == 0  # too young: another writer may be about to commit them
    assert store.vacuum(0) > 0 and sorted(map(tuple, store.read().drop("_shard").collect())) == before


def test_one_of_two_writers_of_a_version_fails(spark, docs_of):
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    store.append(docs_of(["a"]))
    base = store.version()
    store._commit(base, store.files())
    with pytest.raises(Exception):
        store._commit(base, [])
    assert store.files()


def test_writers_that_meet_both_commit(spark, docs_of):
    one, two = (sharding.ShardStore(spark, scratch(spark, "shards")) for _ in range(2))
    two.folder = one.folder
    one.append(docs_of(["a"]))
    real = one.version
    stale = iter([1])
    two.append(docs_of(["b"], first=1))
    one.version = lambda: next(stale, None) or real()  # what it knew before the other one committed
    one.append(docs_of(["c"], first=2))
    assert sorted(r.text for r in two.read().collect()) == ["a", "b", "c"]


def test_shard_odd_rows(odd_docs, no_docs):
    assert sharding.shard(odd_docs.repartition(6)).count() == 10
    assert sharding.shard(no_docs).collect() == []
    assert sharding.shard(odd_docs.withColumn("_shard", F.lit("own"))).filter("shard = 'own'").count() == 0


def sainte_lague(weights, have, seats):
    got = defaultdict(int)
    for _ in range(seats):
        best = max((s for s in have if got[s] < have[s]), key=lambda s: (weights[s] / (2 * got[s] + 1), [-ord(c) for c in s]))
        got[best] += 1
    return dict(got)


def test_quotas_equal_seat_by_seat(spark, sf):
    docs = table(spark, sf, "documents")
    blocks = mixing.assign_blocks(docs, block_tokens=300, shard_tokens=30_000).cache()
    weights = {r.source: r.weight for r in mixing.weights_of(blocks).collect()}
    got = defaultdict(dict)
    for r in mixing.quotas(blocks, block_tokens=300, keep_fraction=0.6).groupBy("shard", "source").count().collect():
        got[r.shard][r.source] = r["count"]
    have = defaultdict(dict)
    for r in blocks.groupBy("shard", "source").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_tokens") / 300)).alias("n")).collect():
        have[r.shard][r.source] = r.n
    assert len(have) > 1
    for shard, own in have.items():
        assert dict(got[shard]) == sainte_lague(weights, own, -(-sum(own.values()) * 6 // 10))


def test_shares_follow_weights(spark, docs_of):
    docs = docs_of(["w " * 100] * 3000, sources=("a", "b", "c"))
    weights = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0)], "source string, weight double")
    got = {r.source: r["sum(n_tokens)"] for r in mixing.mix(docs, weights, block_tokens=500, shard_tokens=50_000, keep_fraction=0.4).groupBy("source").sum("n_tokens").collect()}
    total = sum(got.values())
    assert abs(got["a"] / total - 0.6) < 0.05 and abs(got["b"] / total - 0.3) < 0.05 and abs(total / 300_000 - 0.4) < 0.05


def test_mix_odd_rows(spark, odd_docs, no_docs):
    kept = mixing.mix(odd_docs, keep_fraction=1.0)
    assert kept.count() == 10 and mixing.mix(no_docs).collect() == []
    clash = odd_docs.withColumn("_id", F.lit(1)).withColumn("_source", F.lit("x")).withColumn("MIXED_ID", F.lit(0))
    assert mixing.stage(spark, clash, None).columns == clash.columns and mixing.stage(spark, clash, None).count() == mixing.stage(spark, odd_docs, None).count()
    weights = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -1.0), ("b", None), (None, 2.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(odd_docs, weights, keep_fraction=1.0).collect()} <= {"a", ""}
    out = mixing.stage(spark, odd_docs, None)
    assert out.columns == odd_docs.columns and out.count() <= 10
