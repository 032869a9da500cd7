import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators.ivf import IvfConfig
from lodestar.operators.planners import Fluid, HorizontalLeveling, Leveling, Tiering, Vertical
from lodestar.operators.store import KeyedStore, StoreConfig, VectorStore
from lodestar.sources.vecs import read_vecs, write_vecs


@pytest.mark.parametrize("growth,merge", [(lambda: Vertical(2000, 2), Leveling()), (lambda: Vertical(2000, 3), Tiering(3)), (lambda: HorizontalLeveling(3), Fluid([1, 2], 3))], ids=["leveling", "tiering", "fluid"])
def test_churn_against_a_dictionary(spark, tmp_path, growth, merge):
    rng = random.Random(5)
    store = KeyedStore(spark, str(tmp_path), config=StoreConfig(growth=growth(), merge=merge, file_bytes=3000))
    model: dict[int, str] = {}
    for step in range(7):
        puts = {rng.randrange(80): f"v{step}-{rng.random()}" for _ in range(30)}
        store.put(spark.createDataFrame(list(puts.items()), "key long, value string"))
        model |= puts
        gone = rng.sample(range(90), 8)
        store.delete(spark.createDataFrame([(k,) for k in gone], "key long"))
        for k in gone:
            model.pop(k, None)
    assert [(r.key, r.value) for r in store.scan().collect()] == sorted(model.items())
    assert [(r.key, r.value) for r in store.scan(20, 40).collect()] == sorted((k, v) for k, v in model.items() if 20 <= k <= 40)
    got = store.get(spark.createDataFrame([(k,) for k in range(0, 90, 7)], "key long"))
    assert sorted((r.key, r.value) for r in got.collect()) == sorted((k, v) for k, v in model.items() if k % 7 == 0)
    s = store.stats()
    assert s["write_amplification"] >= 1 and s["runs"] < 14
    assert store.sweep() == []  # all of it is young
    store.sweep(0)
    again = KeyedStore(spark, str(tmp_path), config=StoreConfig(growth=growth(), merge=merge))
    assert [(r.key, r.value) for r in again.scan().collect()] == sorted(model.items())
    assert store.files().count() == s["files"]


def test_opening_leaves_what_is_being_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path))
    store.put(spark.createDataFrame([(1, "a")], "key long, value string"))
    files = store._write(spark.createDataFrame([(2, "b", False)], "key long, value string, is_tombstone boolean"), 2, 0)
    KeyedStore(spark, str(tmp_path)).sweep()  # another process, in between
    state = store.manifest()
    state["runs"].append({"level": 0, "sequence": 2, "units": 1, "files": files})
    state["sequence"] = 2
    store._commit(state)
    assert [(r.key, r.value) for r in store.scan().collect()] == [(1, "a"), (2, "b")]
    assert store.get(spark.createDataFrame([(9,)], "key long")).collect() == []
    assert [r.value for r in store.get(spark.createDataFrame([(2,), (None,)], "key long")).collect()] == ["b"]


@pytest.mark.parametrize("keys,kind", [([b"a", b"b", b"\xff"], "binary"), ([datetime.date(2020, 1, 1), datetime.date(2021, 1, 1), datetime.date(2022, 5, 5)], "date")])
def test_keys_of_other_types(spark, tmp_path, keys, kind):
    store = KeyedStore(spark, str(tmp_path))
    store.put(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"key {kind}, value int"))
    assert [r.value for r in store.scan(low=keys[1]).collect()] == [1, 2]
    assert [r.value for r in store.get(spark.createDataFrame([(keys[0],)], f"key {kind}")).collect()] == [0]
    assert KeyedStore(spark, str(tmp_path)).scan().count() == 3


def test_units_add_up_and_corruption_is_found(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), config=StoreConfig(growth=Vertical(1 << 40, 2), merge=Tiering()))
    for k in range(5):
        store.put(spark.createDataFrame([(k, "x")], "key long, value string"))
    from lodestar.operators.planners import Request

    store.execute(store.config.merge.plan(store.tree(), Request.down(0)))
    assert [r["units"] for r in store.manifest()["runs"]] == [5]
    assert store.scan(version=3).count() == 3  # an older version still reads
    path = next((tmp_path / "manifest").glob(f"manifest-{store.version():010d}.json"))
    path.write_text(path.read_text().replace('"units": 5', '"units": 6'))
    with pytest.raises(ValueError, match="corrupt"):
        store.manifest()


def test_large_values_beside_the_tree(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), config=StoreConfig(value_threshold=100))
    rows = {k: "z" * (k * 30) for k in range(10)}
    store.put(spark.createDataFrame(list(rows.items()), "key long, value string"))
    assert {r.key: r.value for r in store.scan().collect()} == rows
    s = store.stats()
    assert s["disk_bytes"] > s["tree_bytes"]


@pytest.fixture
def filled(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (300, 8)).astype(np.float32)
    store = VectorStore(spark, str(tmp_path), 8, IvfConfig(clusters=16, bits=5), training_threshold=200)
    store.insert(spark.createDataFrame([(i, v.tolist(), f"meta-{i}".encode()) for i, v in enumerate(x)], "id long, vector array<float>, metadata binary"))
    return store, x


def ask(spark, *vectors):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(vectors)], "query_id long, vector array<float>")


def test_revived_id_comes_once(spark, filled):
    store, x = filled
    assert store.rebuild_index()
    five = spark.createDataFrame([(5,)], "id long")
    store.delete(five)
    assert 5 not in {r.id for r in store.search(ask(spark, x[5]), 5).collect()}
    store.insert(spark.createDataFrame([(5, x[5].tolist())], "id long, vector array<float>"))
    got = [r.id for r in store.search(ask(spark, x[5]), 5, nprobe=16).orderBy("rank").collect()]
    want = np.argsort(((x - x[5]) ** 2).sum(1))[:5].tolist()
    assert got == want and len(set(got)) == 5
    assert len(store) == 300 and bytes(store.get(spark.createDataFrame([(7,)], "id long")).first().metadata) == b"meta-7"


def test_deleted_rows_do_not_starve_a_search(spark, filled):
    store, x = filled
    store.rebuild_index()
    store.delete(spark.range(290).select("id"))
    assert store.search(ask(spark, x[0]), 10, nprobe=16, candidates=10).count() == 10
    # an overwritten vector is found where it is now
    store.insert(spark.createDataFrame([(295, [9.0] * 8)], "id long, vector array<float>"))
    top = store.search(ask(spark, [9.0] * 8), 1).first()
    assert (top.id, top.distance) == (295, 0.0)


def test_store_edges(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), 2)
    assert len(store) == 0 and not store.rebuild_index() and store.search(ask(spark, [0, 0]), 3).collect() == []
    with pytest.raises(Exception, match="finite"):
        store.insert(spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"))
    with pytest.raises(Exception, match="finite"):
        store.insert(spark.createDataFrame([(1, [1.0, float("nan")])], "id long, vector array<float>"))


def test_vector_files(spark, tmp_path):
    ids = spark.createDataFrame([(0, [16777217, 16777219]), (1, [3, 4])], "vec_id long, vector array<int>")
    path, = write_vecs(ids.coalesce(1), str(tmp_path / "i"), "ivecs")
    assert [r.vector for r in read_vecs(spark, path).orderBy("vec_id").collect()] == [[16777217, 16777219], [3, 4]]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    parts = write_vecs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>"), str(tmp_path / "f"))
    got = np.concatenate([[r.vector for r in read_vecs(spark, p, block_bytes=100).orderBy("vec_id").collect()] for p in parts])
    assert np.array_equal(got.astype(np.float32), x)
    b, = write_vecs(spark.createDataFrame([(0, [0, 255])], "vec_id long, vector array<int>"), str(tmp_path / "b"), "bvecs")
    assert read_vecs(spark, b).first().vector == [0, 255]


@pytest.mark.parametrize("raw", [b"\x02\0\0\0" + b"\0" * 8 + b"\x01\0\0\0" + b"\0" * 8, b"\x02\0\0\0" + b"\0" * 7, b"\0\0\0\0", b"\xff\xff\xff\x7f", b"\x01"])
def test_bad_vector_files(spark, tmp_path, raw):
    p = tmp_path / "x.fvecs"
    p.write_bytes(raw)
    with pytest.raises(Exception):
        read_vecs(spark, str(p)).collect()


def test_stream_of_upserts(spark, tmp_path):
    from lodestar.streaming.upsert import upserts

    src = tmp_path / "in"
    for k, rows in enumerate([[(1, 1, "a", False), (2, 2, "b", False), (1, 3, "c", False)], [(2, 4, None, True), (3, 5, "d", False)]]):
        spark.createDataFrame(rows, "key long, seq long, value string, is_tombstone boolean").coalesce(1).write.parquet(str(src / f"b{k}"))
    store = KeyedStore(spark, str(tmp_path / "store"))
    changes = spark.readStream.schema("key long, seq long, value string, is_tombstone boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = upserts(changes, store, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.key, r.value) for r in store.scan().collect()] in ([(1, "c"), (3, "d")], [(1, "c"), (2, "b"), (3, "d")])
