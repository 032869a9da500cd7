import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import changelog as cl, deg, graph, hybrid, knn, metrics
from lodestar.operators.ivf import IvfConfig, IvfIndex, kmeans
from lodestar.runtime import table


@pytest.fixture(scope="module")
def vectors(spark):
    return table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.filter("id < 30").withColumnRenamed("id", "query_id").cache()


@pytest.fixture(scope="module")
def truth(vectors, queries):
    return knn.knn(queries, vectors, 10).cache()


def mean_recall(found, truth):
    return knn.recall(found, truth).agg(F.avg("recall")).first()[0]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_knn_equals_full_sort(vectors, queries, truth):
    x = np.array([r.vector for r in vectors.orderBy("id").collect()], float)
    for q in (0, 7, 29):
        d = ((x - x[q]) ** 2).sum(1)
        want = np.lexsort((np.arange(len(x)), d))[:10].tolist()
        assert [r.id for r in truth.filter(F.col("query_id") == q).orderBy("rank").collect()] == want
    assert rows(truth.filter("query_id = 0 and rank <= 3"), "id") == [(0,), (334,), (365,)]


def test_knn_edges(spark):
    base = spark.createDataFrame([(10, [0.0, 0.0]), (20, [1.0, 0.0]), (30, [5.0, 5.0]), (5, [1.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(1, [0.9, 0.0])], "query_id long, vector array<float>")
    assert [r.id for r in knn.knn(q, base, 9).orderBy("rank").collect()] == [5, 20, 10, 30]  # ties by id, k above n
    assert knn.knn(q, base, 0).collect() == [] and knn.knn(q, base.limit(0), 3).collect() == [] and knn.knn(q.limit(0), base, 3).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        knn.knn(q, spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), 1).collect()


def test_recall_counts_sets(spark):
    f = spark.createDataFrame([(1, 1), (1, 1)], "query_id long, id long")
    t = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, id long")
    assert knn.recall(f, t).first().recall == 0.5
    assert knn.recall(f.limit(0), t).first().recall == 0.0


def test_ordinals(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r.id: r.ordinal for r in knn.with_ordinal(df, "id").collect()}
    assert got == {v: k for k, v in enumerate(sorted(ids))}


def test_kmeans_blobs_and_edges():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.uniform(-1, 1, (40, 8)) for c in (0, 50, -50)])
    c, inertia, rounds = kmeans(x, 3, 25, 7)
    assert sorted(np.round(c.mean(1), -1).tolist()) == [-50, 0, 50] and inertia < 120 * 8 and rounds < 25
    assert len(kmeans(x[:2], 5, 3, 1)[0]) == 2 and len(kmeans(np.zeros((6, 2)), 3, 3, 1)[0]) == 3


def test_ivf_recall_bands(vectors, queries, truth):
    index = IvfIndex.build(vectors, IvfConfig(clusters=22, bits=5))
    index.codes = index.codes.cache()
    assert index.list_sizes().agg(F.sum("n")).first()[0] == 500
    got = [mean_recall(index.search(queries, vectors, 10, nprobe=n), truth) for n in (1, 8, 22)]
    assert got == sorted(got) and abs(got[1] - 0.73) < 0.12 and got[2] == 1.0  # every list, 100 candidates
    assert index.search(queries, vectors, 10, nprobe=0).collect() == [] and index.search(queries, vectors, 0).collect() == []


def test_graph_and_symphony_recall(vectors, queries, truth):
    index = graph.build_sharded(vectors, 2).cache()
    assert mean_recall(graph.search_sharded(index, queries, 10, 40), truth) > 0.95
    index = graph.build_sharded(vectors.filter("id < 300"), 1, "symphony").cache()
    t = knn.knn(queries, vectors.filter("id < 300"), 10)
    assert mean_recall(graph.search_sharded(index, queries, 10, 40, "symphony"), t) > 0.8
    assert index.agg(F.max(F.size("neighbours"))).first()[0] <= 33


def test_symphony_decomposition_equals_direct_estimate():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(40, 16)).astype(np.float32), rng.normal(size=16).astype(np.float32)
    s = graph.Symphony(x, bits=5)
    v = next(i for i, a in enumerate(s.graph.adjacency) if a)
    turned = s.coder.turned(q[None])[0]
    got = s.estimates(v, turned, turned.sum(), float(np.linalg.norm(q - x[v])))
    ids = s.graph.adjacency[v]
    want = s.coder.estimate(*s.coder.encode(x[ids], x[v][None]), s.coder.prepare(q[None], x[v][None]))[0]
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_deg_recall_and_selection(spark):
    x = np.random.default_rng(2).normal(size=(160, 10)).astype(np.float32)
    e, s = x[:, :8], x[:, 8:]
    far = lambda a: float(np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)).max())
    maxima = (far(e), far(s))
    g = deg.Deg(e, s, maxima, deg.DegConfig(build_pool=64))
    for alpha in (0.0, 0.3, 1.0):
        hits = 0
        for i in range(20):
            de, ds = g.to(e[i], s[i], np.arange(160))
            want = set(np.argsort(ds + alpha * (de - ds), kind="stable")[:10].tolist())
            hits += len(want & {v for _, v in g.search(e[i], s[i], alpha, 10, 48)})
        assert hits / 200 > 0.85, alpha
    assert deg.pruned_by((1.0, 0.0), (0.5, 0.5), (0.5, 0.5))[0] == pytest.approx(0.5)
    assert g.search(e[0], s[0], 0.5, 0, 4) == []
    objects = spark.createDataFrame([(i, e[i].tolist(), s[i].tolist()) for i in range(60)], "id long, e array<float>, s array<float>")
    index = deg.build_sharded(objects, maxima, 3).cache()
    got = deg.search_sharded(index, objects.filter("id < 5").withColumnRenamed("id", "query_id"), maxima, 0.5, 5, 32).collect()
    assert {(r.query_id, r.id) for r in got if r["rank"] == 1} == {(i, i) for i in range(5)}


def test_frontiers_agree(spark):
    rng = np.random.default_rng(6)
    pts = rng.integers(0, 12, (80, 2)).astype(float)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts.tolist())], "id long, e double, s double")
    want = [i for i, a in enumerate(pts) if not any((b <= a).all() and (b < a).any() for b in pts)]
    assert rows(hybrid.frontier(df), "id") == [(i,) for i in want]
    assert np.flatnonzero(deg.split_frontier(pts[:, 0], pts[:, 1])).tolist() == want
    layers = hybrid.frontier_layers(df, "id", 20)
    for k, places in enumerate(deg.layered(np.arange(80), pts[:, 0], pts[:, 1], 20)):
        assert rows(layers.filter(F.col("layer") == k), "id") == [(i,) for i in sorted(places.tolist())]
    assert hybrid.frontier_layers(df.limit(0), "id", 5).collect() == []


def test_replay_stops_at_the_first_bad_record(spark):
    r = spark.createDataFrame([(i, i not in (4, 7)) for i in range(10)], "seq long, sound boolean")
    assert rows(cl.replay(r, "seq", "sound"), "seq") == [(i,) for i in range(4)]
    assert cl.replay(r.filter("sound"), "seq", "sound").count() == 8


def test_value_log_detects_loss(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "y"), (3, None)], "key long, value string")
    inline, values = cl.split_values(df, "value", 10)
    assert rows(cl.resolve_values(inline, values, "value").fillna("-"), "key", "value") == [(1, "x" * 50), (2, "y"), (3, "-")]
    with pytest.raises(Exception, match="no such value"):
        cl.resolve_values(inline, values.limit(0), "value").collect()


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", None)], "g string, v double")
    got = {r.g: (r.p50, r.p99) for r in metrics.percentiles(df, "v", ["g"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (50.0, 99.0), "b": (None, None)}


def test_result_csv(spark, tmp_path):
    metrics.write_results_csv(spark.createDataFrame([("w", 3.5)], "workload string, throughput_kops double"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv")).splitlines()
    assert len(text[0].split(",")) == 27 and text[1].startswith("w,,,") and text[1].count(",") == 26


def test_sampled_pairs_and_second_modality(spark):
    rng = np.random.default_rng(3)
    objects = spark.createDataFrame([(i, [float(x) for x in rng.random(8)]) for i in range(101)], "id long, e array<float>")
    for projected in (False, True):
        o = hybrid.second_modality(objects, 5, projected=projected).cache()
        rows = {r.id: r.s for r in o.collect()}
        assert rows == {r.id: r.s for r in hybrid.second_modality(objects.repartition(3), 5, projected=projected).collect()}
        assert all(len(s) == 2 for s in rows.values()) and len({tuple(s) for s in rows.values()}) == 101
        assert projected or all(0 <= x < 1 for s in rows.values() for x in s)
        pairs = hybrid.sampled_pairs(o, 30, 7)
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == 30 and all(a != b for a, b in got)
        some, whole = (hybrid.pair_maxima(o, p).first() for p in (pairs, None))
        assert 0 < some.emax <= whole.emax and 0 < some.smax <= whole.smax
    assert hybrid.sampled_pairs(objects.limit(5), 30).count() == 2


def test_lower_bound_changes_no_result():
    rng = np.random.default_rng(4)
    e, s = rng.random((300, 8)).astype(np.float32), rng.random((300, 2)).astype(np.float32)
    g = deg.Deg(e, s, (3.0, 1.5))
    for alpha in (0.3, 0.8, 1.0):
        for q in range(0, 300, 30):
            got = g.search(e[q], s[q], alpha, 5, 20)
            active = lambda u: [t for t, a in g.adjacency[u] if any(lo <= alpha <= hi for lo, hi in a)]
            plain = deg.beam_search(g._entries(), 20, 300, active, lambda ids: (lambda d: d[1] + alpha * (d[0] - d[1]))(g.to(e[q], s[q], ids)))
            assert got == plain[:5]
    assert g.skipped > 0


def plain_edges(g, links, v, ids):
    """Edges of ``v`` chosen anew among ``ids``, in order of their frontiers."""
    de, ds = g.between(v, np.array(ids, int))
    kept = []
    for layer in deg.layered(np.array(ids), de, ds, len(ids)) if links is None else links:
        for p in layer.tolist():
            active = deg.FULL
            if kept:
                yz = g.between(ids[p], np.array([ids[k] for k, _ in kept]))
                at = np.array([k for k, _ in kept])
                lo, hi = deg.pruned_by((de[p], ds[p]), (de[at].astype(float), ds[at].astype(float)), yz)
                active = deg.complement(deg.joined([x for x in zip(lo.tolist(), hi.tolist()) if x[0] <= x[1]]))
            if active and deg.measure(active) >= g.config.min_active_width:
                kept.append((p, active))
        if len(kept) >= g.config.max_degree:
            break
    return [(ids[p], active) for p, active in kept]


@pytest.mark.parametrize("integers", [False, True])
def test_deg_edges_are_those_chosen_anew_at_each_insertion(integers, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (120, 5)).astype(np.float32) if integers else rng.normal(size=(120, 10)).astype(np.float32)
    e, s = x[:, :-2], x[:, -2:]
    calls, to = [], deg.Deg.to
    monkeypatch.setattr(deg.Deg, "to", lambda *a: calls.append(1) or to(*a))
    for most in (8, 32):
        calls.clear()
        g = deg.Deg(e, s, (5.0, 3.0), deg.DegConfig(max_degree=most))
        assert len(calls) < 120 * 20  # not one for each pair of edges of each neighbour
        want = [[] for _ in x]
        for v in range(1, len(x)):
            g.near = [[i for i, _ in a] for a in want]
            g.seeds, seeds = seeds_of(g, v), g.seeds
            layers = g._candidates(v)
            g.seeds = seeds
            ids = np.concatenate([c[0] for c in layers]).tolist()
            ends = np.cumsum([0, *(len(c[0]) for c in layers)])
            want[v] = plain_edges(g, [np.arange(a, b) for a, b in zip(ends, ends[1:])], v, ids)
            for t, _ in want[v]:
                want[t] = plain_edges(g, None, t, [*(i for i, _ in want[t]), v])
        assert g.adjacency == want


def seeds_of(g, n):
    """The seeds after ``n`` insertions."""
    seeds, ce, cs = [0], g.e[0].astype(float), g.s[0].astype(float)
    for v in range(1, n):
        ce, cs = ce + (g.e[v] - ce) / (v + 1), cs + (g.s[v] - cs) / (v + 1)
        pool = np.array([*seeds, *([v] if v not in seeds else [])])
        de, ds = g.to(ce, cs, pool)
        seeds = pool[deg.split_frontier(-de, -ds)].tolist()[: g.config.max_seeds] or [0]
    return seeds


def test_shards_grow_with_the_table_and_are_tasks(spark):
    assert graph.shards_of(spark.range(10), 4) == 4 and graph.shards_of(spark.range(graph.SHARD * 9 + 1), 4) == 10
    objects = spark.range(40).select("id", F.array(F.col("id").cast("float")).alias("e"), F.array(F.lit(1.0).cast("float")).alias("s"))
    built = deg.build_sharded(objects, (40.0, 1.0), 6).withColumn("task", F.spark_partition_id()).groupBy("shard").agg(F.collect_set("task").alias("t")).collect()
    assert len({tuple(r.t) for r in built}) == len(built) == 6


def test_values_in_place_take_no_part_in_the_join(spark):
    """They have no pointer, and rows without a key all go to one task."""
    df = spark.range(0, 400, 1, 4).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.repeat(F.col("id").cast("string"), 40)).otherwise(F.col("id").cast("string")).alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cl.resolve_values(*cl.split_values(df, "value", 100), "value").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.key, r.value) for r in got) == sorted((r.key, r.value) for r in df.collect())
    near = [r.task for r in got if r.value is None or len(r.value) < 100]
    assert max(map(near.count, set(near))) <= len(near) / 2


def test_maxima_are_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 7)) + 40
    x[650, :4] += 9  # far from all
    objects = spark.createDataFrame([(i, r[:4].tolist(), r[4:].tolist()) for i, r in enumerate(x)], "id long, e array<double>, s array<double>")
    want = tuple(hybrid.pair_maxima(objects).first())
    for group in (50_000, 200):
        monkeypatch.setattr(hybrid, "GROUP", group)
        assert hybrid.whole_maxima(objects) == want
    assert hybrid.whole_maxima(objects.limit(1)) == (0.0, 0.0) == hybrid.whole_maxima(objects.limit(0))
    for n, m in ((300, 170), (64, 1)):
        a, b = rng.integers(0, 9, (n, 3)).astype(float), rng.integers(0, 12, (m, 3)).astype(float)
        assert hybrid.farthest(a, b, block=50) == ((a[:, None] - b[None]) ** 2).sum(-1).max()
        assert hybrid.farthest(a, None, block=50) == ((a[:, None] - a[None]) ** 2).sum(-1).max()
    assert hybrid.farthest(np.zeros((5, 2)), None) == 0.0


def test_two_modality_searches_take_maxima_of_the_whole_table(spark, sf, monkeypatch):
    from lodestar.plans import vectors as plans

    seen = []
    monkeypatch.setattr(deg, "build_sharded", lambda objects, maxima, *_: seen.append(maxima) or (_ for _ in ()).throw(StopIteration))
    objects = plans._objects(spark, sf).withColumn("id", F.col("id") + 1000)
    far = objects.limit(1).withColumn("id", F.lit(5000).cast("long")).withColumn("e", F.transform("e", lambda v: v + 9))
    monkeypatch.setattr(plans, "_objects", lambda *_: objects.union(far))
    for name in ("deg_search", "fusion_search"):
        with pytest.raises(StopIteration):
            plans.QUERIES[name](spark, sf)
    assert seen == [tuple(hybrid.pair_maxima(objects.union(far)).first())] * 2


@pytest.mark.parametrize("name", ["graph_search", "symphony_search"])
def test_graph_searches_have_more_shards_for_more_rows(spark, sf, monkeypatch, name):
    """Each a task of its own, however small: a fixed number of them grows without end, and small ones were put into one task."""
    from lodestar import runtime
    from lodestar.plans import QUERIES

    built = []
    monkeypatch.setattr(graph, "SHARD", 9)
    monkeypatch.setattr(runtime, "cut", lambda df, cut=runtime.cut: built.append(cut(df)) or built[-1])
    assert QUERIES[name](spark, sf).count() == 500
    where = built[0].withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("shard").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(where) == -(-built[0].count() // 9) and max(r.n for r in where) == 1 and max(r.rows for r in where) < 40


def test_aligned_edges_are_those_pruned_at_the_widest_angle(monkeypatch):
    x = np.random.default_rng(9).normal(size=(150, 12)).astype(np.float32)
    calls, cosines = [], graph.ProximityGraph._cosines
    g = graph.ProximityGraph(x, graph.GraphConfig(max_degree=12))
    plain = [list(a) for a in g.adjacency]
    for v in range(150):
        near = [i for _, i in g._search(x[v], 48, 150)]
        if len(plain[v]) < 12 and len(near) > len(plain[v]):
            low, high, best = 0.0, 60.0, plain[v]
            while high - low >= 0.05:
                mid = (low + high) / 2
                kept = g.prune(v, near, 12, mid)
                low, high, best = (mid, high, kept) if len(kept) >= 12 else (low, mid, best)
            g.adjacency[v] = best if len(best) > len(plain[v]) else plain[v]
    monkeypatch.setattr(graph.ProximityGraph, "_cosines", lambda *a: calls.append(1) or cosines(*a))
    aligned = graph.ProximityGraph(x, graph.GraphConfig(max_degree=12))
    before = len(calls)
    aligned._align()
    assert aligned.adjacency == g.adjacency and 0 < len(calls) - before <= 150  # once a vertex, not once an angle
    assert graph.ProximityGraph(x[:1], graph.GraphConfig(align_degree=True)).adjacency == [[]]


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_edges_of_one_alpha_are_those_chosen_anew(alpha, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.integers(0, 5, (140, 6)).astype(np.float32)
    calls, to = [], deg.Deg.to
    monkeypatch.setattr(deg.Deg, "to", lambda *a: calls.append(1) or to(*a))
    g = deg.Deg(x[:, :4], x[:, 4:], (5.0, 3.0), deg.DegConfig(max_degree=6, build_pool=24, fixed_alpha=alpha))
    assert len(calls) < 140 * 45
    at = lambda v, ids: (lambda d: d[1] + alpha * (d[0] - d[1]))(g.between(v, np.array(ids, int)))

    def chosen(v, ids):
        length, kept = at(v, ids), []
        for p in np.lexsort((ids, length)):
            if len(kept) < 6 and not any(length[k] < length[p] and at(ids[p], [ids[k]])[0] < length[p] for k in kept):
                kept.append(p)
        return [ids[p] for p in kept]

    want = [[] for _ in x]
    for v in range(1, len(x)):
        g.near, g.seeds = want, seeds_of(g, v)
        want[v] = chosen(v, g._candidates(v)[0][0].tolist())
        for t in want[v]:
            want[t] = chosen(t, [*want[t], v])
    assert [[i for i, _ in a] for a in g.adjacency] == want
