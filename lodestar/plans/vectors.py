"""Queries over ``embeddings`` and other tables of points, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import intervals as iv
from lodestar.functions.distance import finite, inner_product, residual, squared_l2, unit_direction
from lodestar.operators import hybrid, knn, metrics
from lodestar.runtime import table

K = 10


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(spark, sf, n=5):
    return _vectors(spark, sf).filter(F.col("id") < n).select(F.col("id").alias("query_id"), "vector")


def _centroids(spark, sf, n=8):
    return _vectors(spark, sf).filter(F.col("id") < n).select(F.col("id").cast("int").alias("cluster_id"), F.col("vector").alias("centroid"))


def _objects(spark, sf):
    return _vectors(spark, sf).select("id", F.slice("vector", 1, 48).alias("e"), F.slice("vector", 49, 16).alias("s"))


def _hybrid_queries(spark, sf):
    return _objects(spark, sf).filter("id < 5").withColumnRenamed("id", "query_id")


def knn_exact_topk(spark, sf):
    return knn.knn(_queries(spark, sf), _vectors(spark, sf), K).select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank"))


def knn_self_excluded(spark, sf):
    return knn.knn(_queries(spark, sf), _vectors(spark, sf), K, exclude_self=True).select("query_id", "id", "distance")


def inner_product_topk(spark, sf):
    return knn.inner_product_top(_queries(spark, sf), _vectors(spark, sf), K).select("query_id", "id", "score")


def rerank_candidates(spark, sf):
    q = _queries(spark, sf)
    c = _vectors(spark, sf).filter("id % 7 = 3").select("id").crossJoin(q.select("query_id"))
    return knn.rerank(c, q, _vectors(spark, sf), K).select("query_id", "id", "distance")


def nearest_centroid_assign(spark, sf):
    return knn.assign(_vectors(spark, sf), _centroids(spark, sf))


def probe_list_topn(spark, sf):
    return knn.probes(_queries(spark, sf), _centroids(spark, sf), 3).select("query_id", "cluster_id", "distance")


def list_sizes(spark, sf):
    return nearest_centroid_assign(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def kmeans_one_step(spark, sf):
    a = nearest_centroid_assign(spark, sf).select("id", "cluster_id").join(_vectors(spark, sf), "id")
    each = a.select("cluster_id", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x"))
    return each.groupBy("cluster_id", "dim").agg(F.round(F.avg("x"), 9).alias("mean"))


def inertia(spark, sf):
    return nearest_centroid_assign(spark, sf).agg(F.round(F.sum("distance"), 6).alias("inertia"))


def _probed(spark, sf, nprobe=3):
    p = knn.probes(_queries(spark, sf), _centroids(spark, sf), nprobe).select("query_id", "cluster_id")
    lists = nearest_centroid_assign(spark, sf).select("id", "cluster_id")
    return knn.rerank(p.join(lists, "cluster_id"), _queries(spark, sf), _vectors(spark, sf), K)


def ivf_flat_search_nprobe(spark, sf):
    return _probed(spark, sf).select("query_id", "id", "distance")


def recall_at_k(spark, sf):
    r = knn.recall(_probed(spark, sf), knn.knn(_queries(spark, sf), _vectors(spark, sf), K))
    return r.select("query_id", F.round("recall", 9).alias("recall"))


def mean_recall(spark, sf):
    r = knn.recall(_probed(spark, sf), knn.knn(_queries(spark, sf), _vectors(spark, sf), K))
    return r.agg(F.round(F.avg("recall"), 9).alias("mean_recall"))


def strided_training_sample(spark, sf):
    return knn.strided_sample(_vectors(spark, sf).select("id"), "id", 7, 3, 40).select("id")


def vector_residuals(spark, sf):
    c = _centroids(spark, sf, 1).select("centroid")
    d = _vectors(spark, sf).crossJoin(c).select("id", F.posexplode(residual(F.col("vector"), F.col("centroid"))).alias("dim", "x"))
    return d.groupBy("id").agg(F.round(F.sum(F.col("x") * F.col("x")), 9).alias("norm2"), F.round(F.max("x"), 9).alias("largest"))


def unit_directions(spark, sf):
    c = _centroids(spark, sf, 1).select("centroid")
    u = _vectors(spark, sf).crossJoin(c).select("id", unit_direction(F.col("centroid"), F.col("vector")).alias("u"))
    return u.select("id", F.round(inner_product(F.col("u"), F.col("u")), 9).alias("norm2"))


def finite_vectors(spark, sf):
    return _vectors(spark, sf).filter(finite(F.col("vector"))).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim"))


def vector_lookup(spark, sf):
    return _vectors(spark, sf).filter("id in (3, 77)").select("id", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x"))


def hybrid_maxima(spark, sf):
    m = hybrid.pair_maxima(_objects(spark, sf).filter("id < 300"))
    return m.select(F.round("emax", 9).alias("emax"), F.round("smax", 9).alias("smax"))


def _maxima(spark, sf):
    return hybrid.pair_maxima(_objects(spark, sf).filter("id < 300"))


def hybrid_distance_topk(spark, sf):
    h = hybrid.exact_search(_hybrid_queries(spark, sf), _objects(spark, sf), _maxima(spark, sf), 0.3, K)
    return h.select("query_id", "id", F.round("distance", 9).alias("distance"))


def merging_baseline(spark, sf):
    h = hybrid.merged_baseline(_hybrid_queries(spark, sf), _objects(spark, sf), _maxima(spark, sf), 0.3, K, 20)
    return h.select("query_id", "id", F.round("distance", 9).alias("distance"))


def modality_centroid(spark, sf):
    e = _objects(spark, sf).select(F.posexplode(F.concat(F.col("e"), F.col("s")).cast("array<double>")).alias("dim", "x"))
    return e.groupBy("dim").agg(F.round(F.avg("x"), 9).alias("mean"))


def _points(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("e"), F.col("p_retailprice").alias("s"))


def pareto_frontier(spark, sf):
    return hybrid.frontier(_points(spark, sf)).select("id", "e", "s")


def pareto_layers(spark, sf):
    return hybrid.frontier_layers(_points(spark, sf), "id", 12).select("id", F.col("layer").cast("int").alias("layer"))


def pareto_by_brand(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("e"), F.col("p_retailprice").alias("s"))
    return hybrid.frontier(p, within=["brand"]).select("brand", "id")


def dominated_pairs(spark, sf):
    return hybrid.dominated_pairs(_points(spark, sf).filter("id <= 400"), "id")


def _grid(spark):
    r = spark.range(21 * 21)
    return r.select("id", ((F.col("id") % 21 - 10) / 4).alias("a"), (F.floor(F.col("id") / 21) / 4 - 2.5).alias("b"))


def alpha_solve_cases(spark, sf):
    s = _grid(spark).withColumn("set", iv.solve(F.col("a"), F.col("b")))
    return s.select("id", F.size("set").alias("pieces"), F.round(F.coalesce(F.get("set", 0)["lo"], F.lit(-1.0)), 9).alias("lo"), F.round(F.coalesce(F.get("set", 0)["hi"], F.lit(-1.0)), 9).alias("hi"))


def _triangles(spark, sf):
    o = _objects(spark, sf)
    side = lambda n: F.struct(F.sqrt(squared_l2(F.col(f"{n[0]}.e"), F.col(f"{n[1]}.e"))).alias("e"), F.sqrt(squared_l2(F.col(f"{n[0]}.s"), F.col(f"{n[1]}.s"))).alias("s"))
    x, y, z = o.filter("id < 120").alias("x"), o.alias("y"), o.alias("z")
    t = x.join(y, F.expr("y.id = x.id + 1")).join(z, F.expr("z.id = x.id + 2"))
    return t.select(F.col("x.id").alias("id"), side("xy").alias("xy"), side("xz").alias("xz"), side("yz").alias("yz"))


def alpha_pruned_by(spark, sf):
    p = _triangles(spark, sf).withColumn("set", iv.pruned_by(F.col("xy"), F.col("xz"), F.col("yz")))
    return p.select("id", F.round(iv.measure(F.col("set")), 8).alias("measure"), F.round(F.coalesce(F.get("set", 0)["lo"], F.lit(-1.0)), 8).alias("lo"))


def alpha_prunes_at(spark, sf):
    t = _triangles(spark, sf).crossJoin(spark.range(11).select((F.col("id") / 10).alias("alpha")))
    return t.select("id", "alpha", iv.prunes_at(F.col("alpha"), F.col("xy"), F.col("xz"), F.col("yz")).alias("pruned"))


def _pieces(spark):
    """Five pieces for each of 60 sets, some of which overlap or touch."""
    at = F.col("id").cast("int")
    lo = lambda j: ((at * 7 + j * 13 + at * j) % 20) / 20.0
    parts = [iv.interval(F.lit(1.0) * lo(j), lo(j) + ((at + j) % 4) / 20.0) for j in range(5)]
    return spark.range(60).select("id", F.concat(*parts).alias("p"))


def interval_union(spark, sf):
    u = _pieces(spark).select("id", F.posexplode(iv.normalise(F.col("p"))).alias("piece", "i"))
    return u.select("id", "piece", F.round("i.lo", 9).alias("lo"), F.round("i.hi", 9).alias("hi"))


def interval_complement(spark, sf):
    c = _pieces(spark).select("id", iv.complement(iv.normalise(F.col("p"))).alias("c"))
    return c.select("id", F.size("c").alias("pieces"), F.round(iv.measure(F.col("c")), 9).alias("measure"))


def alpha_membership(spark, sf):
    s = _pieces(spark).select("id", iv.normalise(F.col("p")).alias("set")).crossJoin(spark.range(0, 41).select((F.col("id") / 40).alias("alpha")))
    return s.select("id", "alpha", iv.contains(F.col("set"), F.col("alpha")).alias("inside"), iv.is_full(F.col("set")).alias("is_full"))


def index_memory_bytes(spark, sf):
    g = spark.range(1, 9).select(F.col("id").alias("bits")).crossJoin(spark.range(1, 5).select((F.col("id") * 33).alias("dim")))
    return g.select("bits", "dim", metrics.packed_code_bytes(F.col("dim"), F.col("bits")).alias("code_bytes"), metrics.index_bytes(F.col("dim"), F.col("bits"), F.lit(1000), F.lit(32)).alias("bytes"))


def rabitq_error_bound(spark, sf):
    g = spark.range(1, 9).select(F.col("id").alias("bits")).crossJoin(spark.range(1, 5).select((F.col("id") * 32).alias("dim")))
    return g.select("bits", "dim", F.round(metrics.error_bound(F.col("bits"), F.col("dim")), 12).alias("bound"))


NAMES = [
    knn_exact_topk, knn_self_excluded, inner_product_topk, rerank_candidates, nearest_centroid_assign, probe_list_topn, list_sizes, kmeans_one_step, inertia,
    ivf_flat_search_nprobe, recall_at_k, mean_recall, strided_training_sample, vector_residuals, unit_directions, finite_vectors, vector_lookup, hybrid_maxima,
    hybrid_distance_topk, merging_baseline, modality_centroid, pareto_frontier, pareto_layers, pareto_by_brand, dominated_pairs, alpha_solve_cases,
    alpha_pruned_by, alpha_prunes_at, interval_union, interval_complement, alpha_membership, index_memory_bytes, rabitq_error_bound,
]
QUERIES = {f.__name__: f for f in NAMES}

_V = "v as (select vec_id as id, embedding::double[] as vector from embeddings), q as (select id as query_id, vector as qv from v where id < 5)"
_D = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_d = lambda a, b: _D.format(a, b)
_ALL = f"with {_V}, d as (select query_id, id, {_d('vector', 'qv')} as distance from v, q)"
_C = "c as (select vec_id::integer as cluster_id, embedding::double[] as centroid from embeddings where vec_id < 8)"
_A = f"ad as (select id, cluster_id, {_d('vector', 'centroid')} as distance from v, c), a as (select id, cluster_id, distance from ad qualify row_number() over (partition by id order by distance, cluster_id) = 1)"
_P = f"pd as (select query_id, cluster_id, {_d('centroid', 'qv')} as distance from q, c), p as (select * from pd qualify row_number() over (partition by query_id order by distance, cluster_id) <= 3)"
_F = f"fd as (select p.query_id, a.id, {_d('v.vector', 'q.qv')} as distance from p join a using (cluster_id) join v using (id) join q using (query_id)), f as (select * from fd qualify row_number() over (partition by query_id order by distance, id) <= 10)"
_T = f"td as (select query_id, id, {_d('vector', 'qv')} as distance from v, q), t as (select * from td qualify row_number() over (partition by query_id order by distance, id) <= 10)"
_R = f"with {_V}, {_C}, {_A}, {_P}, {_F}, {_T}, r as (select t.query_id, count(f.id) / count(*) as recall from t left join f using (query_id, id) group by t.query_id)"
_O = "o as (select vec_id as id, (embedding::double[])[1:48] as e, (embedding::double[])[49:64] as s from embeddings)"
_M = f"m as (select sqrt(max({_d('a.e', 'b.e')})) as emax, sqrt(max({_d('a.s', 'b.s')})) as smax from o a join o b on a.id < b.id where b.id < 300)"
_H = f"h as (select q.id as query_id, o.id as id, sqrt({_d('o.e', 'q.e')}) / emax as e, sqrt({_d('o.s', 'q.s')}) / smax as s from o, o q, m where q.id < 5)"
_PT = "p as (select p_partkey as id, p_size::double as e, p_retailprice as s from part)"
_DOM = "b.e <= a.e and b.s <= a.s and (b.e < a.e or b.s < a.s)"


def _tri() -> str:
    side = lambda a, b: f"sqrt({_d(a + '.e', b + '.e')}) as e{a}{b}, sqrt({_d(a + '.s', b + '.s')}) as s{a}{b}"
    return f"with {_O}, t as (select x.id, {side('x', 'y')}, {side('x', 'z')}, {side('y', 'z')} from o x join o y on y.id = x.id + 1 join o z on z.id = x.id + 2 where x.id < 120)"


def _solve(a: str, b: str) -> tuple[str, str]:
    lo = f"case when {b} > 0 then 0.0 when {b} < 0 and {a} < 0 and {b} / {a} < 1 then {b} / {a} when {b} = 0 and {a} < 0 then 0.0 else null end"
    hi = f"case when {b} > 0 and {a} > 0 then least(1.0, {b} / {a}) when {b} > 0 then 1.0 when {b} < 0 and {a} < 0 and {b} / {a} < 1 then 1.0 when {b} = 0 and {a} < 0 then 1.0 else null end"
    return lo, hi


_S1, _S2 = _solve("(exz - exy + sxy - sxz)", "(sxy - sxz)"), _solve("(eyz - exy + sxy - syz)", "(sxy - syz)")
_PIECES = "i as (select id, greatest(0.0, ((id * 7 + j * 13 + id * j) % 20) / 20.0) as lo, least(1.0, ((id * 7 + j * 13 + id * j) % 20) / 20.0 + ((id + j) % 4) / 20.0) as hi from range(60) r(id), range(5) g(j)), w as (select *, max(hi) over (partition by id order by lo, hi rows between unbounded preceding and 1 preceding) as before from i), k as (select *, sum((before is null or lo > before)::int) over (partition by id order by lo, hi rows unbounded preceding) as g from w), u as (select id, g::integer - 1 as piece, min(lo) as lo, max(hi) as hi from k group by id, g)"
_LAYER = lambda n, src: f"l{n} as (select * from {src} a where not exists (select 1 from {src} b where {_DOM}))"

ORACLES = {
    "knn_exact_topk": f"{_ALL} select query_id, id, distance, (row_number() over (partition by query_id order by distance, id))::integer as rank from d qualify rank <= 10",
    "knn_self_excluded": f"{_ALL} select query_id, id, distance from d where id <> query_id qualify row_number() over (partition by query_id order by distance, id) <= 10",
    "inner_product_topk": f"with {_V} select query_id, id, list_sum(list_transform(list_zip(vector, qv), lambda z: z[1] * z[2])) as score from v, q qualify row_number() over (partition by query_id order by score desc, id) <= 10",
    "rerank_candidates": f"{_ALL} select query_id, id, distance from d where id % 7 = 3 qualify row_number() over (partition by query_id order by distance, id) <= 10",
    "nearest_centroid_assign": f"with {_V}, {_C}, {_A} select * from a",
    "probe_list_topn": f"with {_V}, {_C}, {_P} select * from p",
    "list_sizes": f"with {_V}, {_C}, {_A} select cluster_id, count(*) as n from a group by cluster_id",
    "kmeans_one_step": f"with {_V}, {_C}, {_A}, e as (select cluster_id, unnest(vector) as x, generate_subscripts(vector, 1) - 1 as dim from a join v using (id)) select cluster_id, dim::integer as dim, round(avg(x), 9) as mean from e group by cluster_id, dim",
    "inertia": f"with {_V}, {_C}, {_A} select round(sum(distance), 6) as inertia from a",
    "ivf_flat_search_nprobe": f"with {_V}, {_C}, {_A}, {_P}, {_F} select * from f",
    "recall_at_k": f"{_R} select query_id, round(recall, 9) as recall from r",
    "mean_recall": f"{_R} select round(avg(recall), 9) as mean_recall from r",
    "strided_training_sample": "with o as (select vec_id as id, row_number() over (order by vec_id) - 1 as n from embeddings) select id from o where n >= 3 and (n - 3) % 7 = 0 and (n - 3) // 7 < 40",
    "vector_residuals": f"with {_V}, z as (select v.id, list_transform(list_zip(v.vector, c.vector), lambda z: z[1] - z[2]) as r from v, v c where c.id = 0) select id, round(list_sum(list_transform(r, lambda x: x * x)), 9) as norm2, round(list_max(r), 9) as largest from z",
    "unit_directions": f"with {_V}, z as (select v.id, list_transform(list_zip(v.vector, c.vector), lambda z: z[1] - z[2]) as r from v, v c where c.id = 0), n as (select id, r, sqrt(list_sum(list_transform(r, lambda x: x * x))) as n from z) select id, case when n > 0 then round(list_sum(list_transform(r, lambda x: (x / n) * (x / n))), 9) end as norm2 from n",
    "finite_vectors": "select count(*) as n, min(len(embedding))::integer as least_dim, max(len(embedding))::integer as most_dim from embeddings where len(list_filter(embedding, lambda x: not isfinite(x))) = 0",
    "vector_lookup": "select vec_id as id, (generate_subscripts(embedding, 1) - 1)::integer as dim, unnest(embedding)::double as x from embeddings where vec_id in (3, 77)",
    "hybrid_maxima": f"with {_O}, {_M} select round(emax, 9) as emax, round(smax, 9) as smax from m",
    "hybrid_distance_topk": f"with {_O}, {_M}, {_H} select query_id, id, round(s + 0.3::double * (e - s), 9) as distance from h qualify row_number() over (partition by query_id order by s + 0.3::double * (e - s), id) <= 10",
    "merging_baseline": f"with {_O}, {_M}, {_H}, c as (select query_id, id from h qualify row_number() over (partition by query_id order by e, id) <= 20 union select query_id, id from h qualify row_number() over (partition by query_id order by s, id) <= 20) select query_id, id, round(s + 0.3::double * (e - s), 9) as distance from h join c using (query_id, id) qualify row_number() over (partition by query_id order by s + 0.3::double * (e - s), id) <= 10",
    "modality_centroid": "with e as (select unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select dim::integer as dim, round(avg(x), 9) as mean from e group by dim",
    "pareto_frontier": f"with {_PT} select * from p a where not exists (select 1 from p b where {_DOM})",
    "pareto_layers": f"with {_PT}, " + ", ".join(f"{_LAYER(n, 'r' + str(n) if n else 'p')}, r{n + 1} as (select * from {'r' + str(n) if n else 'p'} where id not in (select id from l{n}))" for n in range(12)) + ", al as (" + " union all ".join(f"select id, {n} as layer from l{n}" for n in range(12)) + "), n as (select layer, count(*) as c from al group by layer), b as (select layer, coalesce(sum(c) over (order by layer rows between unbounded preceding and 1 preceding), 0) as before from n) select id, layer::integer as layer from al join b using (layer) where before < 12",
    "pareto_by_brand": "with p as (select p_partkey as id, p_brand as brand, p_size::double as e, p_retailprice as s from part) select brand, id from p a where not exists (select 1 from p b where a.brand = b.brand and " + _DOM + ")",
    "dominated_pairs": f"with {_PT} select a.id, count(*) as n_dominators from p a join p b on {_DOM} where a.id <= 400 and b.id <= 400 group by a.id",
    "alpha_solve_cases": "with g as (select id, (id % 21 - 10) / 4 as a, floor(id / 21) / 4 - 2.5 as b from range(441) t(id)), s as (select id, {} as lo, {} as hi from g) select id, (lo is not null)::integer as pieces, round(coalesce(lo, -1), 9) as lo, round(coalesce(hi, -1), 9) as hi from s".format(*_solve("a", "b")),
    "alpha_pruned_by": f"{_tri()}, i as (select id, greatest({_S1[0]}, {_S2[0]}) as lo, least({_S1[1]}, {_S2[1]}) as hi, ({_S1[0]}) is not null and ({_S2[0]}) is not null as both_are from t) select id, case when both_are and lo <= hi then round(hi - lo, 8) else 0.0 end as measure, case when both_are and lo <= hi then round(lo, 8) else -1.0 end as lo from i",
    "alpha_prunes_at": f"{_tri()} select id, k / 10 as alpha, sxz + k / 10 * (exz - sxz) < sxy + k / 10 * (exy - sxy) and syz + k / 10 * (eyz - syz) < sxy + k / 10 * (exy - sxy) as pruned from t, range(11) g(k)",
    "interval_union": f"with {_PIECES} select id, piece, round(lo, 9)::double as lo, round(hi, 9)::double as hi from u",
    "interval_complement": f"with {_PIECES}, g as (select id, lo as hi, coalesce(lag(hi) over (partition by id order by lo), 0) as lo from u union all select id, 1.0, max(hi) from u group by id) select id, count(*)::integer as pieces, round(sum(hi - lo), 9)::double as measure from g where lo < hi group by id",
    "alpha_membership": f"with {_PIECES}, x as (select distinct id from u) select x.id, k / 40 as alpha, exists (select 1 from u where u.id = x.id and u.lo <= k / 40 and k / 40 <= u.hi) as inside, exists (select 1 from u where u.id = x.id and u.lo <= 0 and u.hi >= 1) as is_full from x, range(41) g(k)",
    "index_memory_bytes": "select b as bits, d * 33 as dim, ceil(d * 33 * b / 8)::bigint as code_bytes, ceil(d * 33 * b / 8)::bigint * 1000 + 32 * d * 33 * 4 as bytes from range(1, 9) r(b), range(1, 5) s(d)",
    "rabitq_error_bound": "select b as bits, d * 32 as dim, round(pow(2.0, -b) * 5.75 / sqrt((d * 32)::double), 12) as bound from range(1, 9) r(b), range(1, 5) s(d)",
}


# -- approximate searches: no SQL; tests hold their recall against the exact search ------------------
def ivf_rabitq_search(spark, sf):
    from lodestar.operators.ivf import IvfConfig, IvfIndex

    index = IvfIndex.build(_vectors(spark, sf), IvfConfig(clusters=22, bits=5))
    return index.search(_queries(spark, sf, 50), _vectors(spark, sf), K, nprobe=16).select("query_id", "id", "distance")


def vector_store_search(spark, sf):
    from lodestar.operators.ivf import IvfConfig
    from lodestar.operators.store import VectorStore
    from lodestar.runtime import scratch

    store = VectorStore(spark, scratch(spark, "vector-store"), 64, IvfConfig(clusters=16, bits=5), training_threshold=200)
    store.insert(_vectors(spark, sf))
    store.delete(_vectors(spark, sf).filter("id % 10 = 9"))
    store.rebuild_index()
    return store.search(_queries(spark, sf, 20), K, nprobe=16, candidates=50).select("query_id", "id", "distance")


def graph_search(spark, sf):
    from lodestar.operators import graph
    from lodestar.runtime import cut

    vectors = _vectors(spark, sf)
    index = cut(graph.build_sharded(vectors, graph.shards_of(vectors, 4)))
    return graph.search_sharded(index, _queries(spark, sf, 50), K, 40).select("query_id", "id", "distance")


def symphony_search(spark, sf):
    from lodestar.operators import graph
    from lodestar.runtime import cut

    vectors = _vectors(spark, sf)
    index = cut(graph.build_sharded(vectors, graph.shards_of(vectors, 4), "symphony"))
    return graph.search_sharded(index, _queries(spark, sf, 50), K, 40, "symphony").select("query_id", "id", "distance")


def deg_search(spark, sf, alpha=0.5, config=None):
    from lodestar.operators import deg, graph
    from lodestar.runtime import cut

    config = config or deg.DegConfig(build_pool=64)
    objects = _objects(spark, sf)
    m = hybrid.whole_maxima(objects)
    index = cut(deg.build_sharded(objects, m, graph.shards_of(objects, 8), config))
    return deg.search_sharded(index, _hybrid_queries(spark, sf), m, alpha, K, 48, config).select("query_id", "id", "distance")


def fusion_search(spark, sf):
    from lodestar.operators.deg import DegConfig

    return deg_search(spark, sf, 0.5, DegConfig(build_pool=64, fixed_alpha=0.5))


for _f in (ivf_rabitq_search, vector_store_search, graph_search, symphony_search, deg_search, fusion_search):
    QUERIES[_f.__name__] = _f
