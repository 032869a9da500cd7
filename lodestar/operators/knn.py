"""Exact k-nearest neighbours and what is built on ranked lists: re-ranking, assignment, recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.functions.distance import inner_product, squared_l2

#: Vectors in a block; a pair of blocks is one matrix product.
BLOCK = 2048


def rank_top(scored: DataFrame, k: int, by: str = "query_id", order=("distance", "id")) -> DataFrame:
    """The first ``k`` rows of each ``by`` under a total order; Spark limits groups before and after its shuffle."""
    w = W.partitionBy(by).orderBy(*(F.col(c) if isinstance(c, str) else c for c in order))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def as_matrix(col: pa.Array, kind=np.float32) -> np.ndarray:
    """An Arrow list column as a matrix; an error if lengths differ or a value is missing."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty((0, 0), kind)
    sizes = np.diff(col.offsets.to_numpy())
    if col.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors are missing or of different lengths")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(kind)


def packed(df: DataFrame, key: str, vector: str, names: tuple[str, str, str], block: int = BLOCK) -> DataFrame:
    """Rows of up to ``block`` vectors: ids, their matrix as bytes, and its width."""

    def run(batches):
        ids, mats, n = [], [], 0

        def out():
            m = np.concatenate(mats)
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], list(names))

        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                mats.append(as_matrix(part.column(1)))
                n += part.num_rows
                if n >= block:
                    yield out()
                    ids, mats, n = [], [], 0
        if n:
            yield out()

    picked = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return picked.mapInArrow(run, f"{names[0]} array<long>, {names[1]} binary, {names[2]} int")


def knn(queries: DataFrame, base: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "vector", base_id: str = "id", base_vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """``(query_id, id, distance, rank)``: the ``k`` nearest of ``base`` to each query by squared L2, ties by id.

    Both sides are packed into blocks, and each pair of blocks is a matrix product that keeps its own
    best, so only about k rows a query and block are shuffled. Which side travels is the planner's
    choice by size; nothing is forced to be broadcast. The product only selects, with room for its
    rounding; what is kept is computed again, in double precision from the left.
    """
    if k <= 0:
        return base.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                qi, bi = (np.asarray(b.column(c)[r].values) for c in ("qi", "bi"))
                qw, bw = b.column("qw")[r].as_py(), b.column("bw")[r].as_py()
                if qw != bw:
                    raise ValueError(f"vectors of different lengths: {qw} and {bw}")
                q = np.frombuffer(b.column("qm")[r].as_buffer(), np.float32).reshape(len(qi), qw).astype(np.float64)
                v = np.frombuffer(b.column("bm")[r].as_buffer(), np.float32).reshape(len(bi), bw).astype(np.float64)
                nq, nv = (q * q).sum(1), (v * v).sum(1)
                for at in range(0, len(qi), 256):
                    part = q[at : at + 256]
                    near = nq[at : at + 256, None] + nv[None] - 2 * part @ v.T
                    if exclude_self:
                        near[qi[at : at + 256, None] == bi[None]] = np.inf
                    keep = min(k, len(bi))
                    edge = np.partition(near, keep - 1, axis=1)[:, keep - 1]
                    slack = 1e-9 * (1 + nq[at : at + 256] + nv.max(initial=0))
                    i, j = np.nonzero((near <= (edge + slack)[:, None]) & np.isfinite(near))
                    if len(i):
                        exact = np.cumsum((part[i] - v[j]) ** 2, axis=1)[:, -1] if qw else np.zeros(len(i))
                        yield pa.RecordBatch.from_arrays([pa.array(qi[at : at + 256][i]), pa.array(bi[j]), pa.array(exact)], ["query_id", "id", "distance"])

    left = packed(queries, query_id, query_vector, ("qi", "qm", "qw"))
    right = packed(base, base_id, base_vector, ("bi", "bm", "bw"))
    near = right.crossJoin(left).mapInArrow(run, "query_id long, id long, distance double")
    return rank_top(near, k)


def inner_product_top(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)`` by largest inner product, over ``(query_id, vector)`` and ``(id, vector)``."""
    pairs = base.crossJoin(queries.withColumnRenamed("vector", "qv"))
    scored = pairs.select("query_id", "id", inner_product(F.col("vector"), F.col("qv")).alias("score"))
    return rank_top(scored, k, order=(F.desc("score"), F.col("id")))


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact distances of proposed ``(query_id, id)``, each once; ids that aren't stored are passed over."""
    c = candidates.select("query_id", "id").distinct()
    scored = c.join(vectors.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
    return rank_top(scored.select("query_id", "id", squared_l2(F.col("vector"), F.col("qv")).alias("distance")), k)


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(id, cluster_id, distance)``: the nearest of ``centroids (cluster_id, centroid)``; ties to the lower cluster."""
    pairs = vectors.crossJoin(centroids)
    d = squared_l2(F.col("vector"), F.col("centroid"))
    best = pairs.groupBy("id").agg(F.min(F.struct(d.alias("distance"), F.col("cluster_id"))).alias("best"))
    return best.select("id", F.col("best.cluster_id").alias("cluster_id"), F.col("best.distance").alias("distance"))


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``(query_id, cluster_id, distance, rank)`` of each query's nearest clusters."""
    pairs = queries.crossJoin(centroids)
    scored = pairs.select("query_id", "cluster_id", squared_l2(F.col("vector"), F.col("centroid")).alias("distance"))
    return rank_top(scored, nprobe, order=("distance", "cluster_id"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of a query's true ids that were found, both as sets."""
    t = truth.select("query_id", "id").distinct()
    hit = t.join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def strided_sample(rows: DataFrame, key: str, stride: int, offset: int, most: int) -> DataFrame:
    """Every ``stride``-th row in the order of ``key``, from the ``offset``-th, ``most`` at most.

    Ordinals come from per-partition counts, not from one global window.
    """
    ordered = with_ordinal(rows, key)
    return ordered.filter((F.col("ordinal") >= offset) & ((F.col("ordinal") - offset) % stride == 0) & ((F.col("ordinal") - offset) / stride < most))


def with_ordinal(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with their place in the order of ``key``, from 0, by a range partitioning and a sum of its counts."""
    from lodestar.runtime import cut

    parts = cut(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts.withColumn("_p", part).join(before, "_p").withColumn("ordinal", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_at", "_before")
