"""Inverted lists of residual codes: training, encoding, probing, and search with exact re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.functions.kernels import ResidualCodes, Xorshift
from lodestar.operators import knn

CODES = "cluster_id int, id long, codes binary, grid_norm float, cosine float, centre_distance float"


@dataclass(frozen=True)
class IvfConfig:
    clusters: int = 256
    bits: int = 5
    iterations: int = 25
    sample: int = 50_000
    seed: int = 0x5EED


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(data: np.ndarray, clusters: int, iterations: int, seed: int) -> tuple[np.ndarray, float, int]:
    """Centroids, inertia and rounds: spread-out seeding, then Lloyd until no assignment changes.

    There are never more clusters than rows; a cluster that empties takes the row that is farthest from its own.
    """
    data = data.astype(np.float64)
    n = len(data)
    clusters = max(1, min(clusters, n))
    rng = Xorshift(seed)
    centroids = [data[rng.below(n)]]
    nearest = _squared(data, centroids[0][None])[:, 0]
    while len(centroids) < clusters:
        total = nearest.sum()
        pick = int(np.searchsorted(np.cumsum(nearest), rng.unit() * total, "right")) if total > 0 else rng.below(n)
        centroids.append(data[min(pick, n - 1)])
        nearest = np.minimum(nearest, _squared(data, centroids[-1][None])[:, 0])
    c, last, rounds, inertia = np.array(centroids), None, 0, 0.0
    for rounds in range(1, max(1, iterations) + 1):
        owner, best = np.empty(n, np.int64), np.empty(n)
        for at in range(0, n, 4096):
            d = _squared(data[at : at + 4096], c)
            owner[at : at + 4096] = d.argmin(1)
            best[at : at + 4096] = d.min(1)
        inertia = float(best.sum())
        if last is not None and (owner == last).all():
            break
        last = owner
        counts = np.bincount(owner, minlength=clusters)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, data)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        for k in np.flatnonzero(counts == 0):
            far = int(best.argmax())
            c[k], best[far] = data[far], 0
    return c.astype(np.float32), inertia, rounds


def train(vectors: DataFrame, config: IvfConfig) -> np.ndarray:
    """Centroids from a sample of at most ``config.sample`` of ``vectors (id, vector)``, spread evenly over the ids."""
    n = vectors.count()
    if not n:
        return np.empty((0, 0), np.float32)
    stride = max(1, n // config.sample)
    ids = vectors.select("id")
    if stride > 1:
        ids = knn.strided_sample(ids, "id", stride, Xorshift(config.seed ^ 0xA5A5A5A5).below(stride), config.sample).select("id")
    rows = vectors.join(ids, "id", "left_semi") if stride > 1 else vectors
    data = knn.as_matrix(rows.orderBy("id").select(F.col("vector").cast("array<float>").alias("v")).toArrow().column("v"))
    return kmeans(data, config.clusters, config.iterations, config.seed)[0]


@dataclass
class IvfIndex:
    config: IvfConfig
    centroids: np.ndarray
    codes: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, config: IvfConfig = IvfConfig(), centroids: np.ndarray | None = None) -> "IvfIndex":
        """Train if no centroids are given, then encode every vector's residual about its nearest centroid."""
        c = train(vectors, config) if centroids is None else centroids
        return cls(config, c, cls.encode(vectors, c, config))

    @staticmethod
    def encode(vectors: DataFrame, centroids: np.ndarray, config: IvfConfig) -> DataFrame:
        """CODES rows of ``vectors``; also how new vectors join an index, which never trains again by itself."""
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # clusters x dimension, fixed by the configuration

        def run(batches):
            c = shared.value
            coder = None
            for b in batches:
                if not b.num_rows or not len(c):
                    continue
                x = knn.as_matrix(b.column("vector"))
                if x.shape[1] != c.shape[1]:
                    raise ValueError(f"vectors of different lengths: {x.shape[1]} and {c.shape[1]}")
                coder = coder or ResidualCodes(c.shape[1], config.bits, config.seed)
                owner = _squared(x.astype(np.float64), c.astype(np.float64)).argmin(1)
                codes, norm, cosine, distance = coder.encode(x, c[owner])
                yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), b.column("id"), pa.array([r.tobytes() for r in codes], pa.binary()), *(pa.array(v.astype(np.float32)) for v in (norm, cosine, distance))], [f.split()[0] for f in CODES.split(", ")])

        picked = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        return picked.mapInArrow(run, CODES)

    def write(self, path: str) -> None:
        """Codes partitioned by cluster, so that a search reads the lists that it probes."""
        self.codes.repartition("cluster_id").sortWithinPartitions("id").write.partitionBy("cluster_id").parquet(path)

    def list_sizes(self) -> DataFrame:
        return self.codes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def candidates(self, queries: DataFrame, nprobe: int, budget: int, hidden: DataFrame | None = None) -> DataFrame:
        """``(query_id, id, distance, rank)``: the ``budget`` least estimated distances in the probed lists.

        ``hidden (id)`` are left out before the budget is spent, so they can't crowd others out.
        """
        spark = queries.sparkSession
        if nprobe <= 0 or budget <= 0 or not len(self.centroids):
            return spark.createDataFrame([], "query_id long, id long, distance float, rank int")
        spec = self.centroids
        shared, config = spark.sparkContext.broadcast(spec), self.config

        def probe(batches):
            c = shared.value.astype(np.float64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = knn.as_matrix(b.column("vector"))
                near = np.argsort(_squared(x.astype(np.float64), c), axis=1, kind="stable")[:, :nprobe]
                row = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column("query_id").take(pa.array(row)), b.column("vector").take(pa.array(row))], ["cluster_id", "query_id", "vector"])

        probes = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(probe, "cluster_id int, query_id long, vector array<float>")
        codes = self.codes if hidden is None else self.codes.join(hidden, "id", "left_anti").select(self.codes.columns)

        def scan(key, left, right):
            k = key[0].as_py()
            ids, best = [], []
            c = shared.value
            if left.num_rows and right.num_rows:
                coder = ResidualCodes(c.shape[1], config.bits, config.seed) if (c.shape[1], config) not in _CODERS else _CODERS[c.shape[1], config]
                _CODERS[c.shape[1], config] = coder
                left, right = left.combine_chunks(), right.combine_chunks()
                raw = left.column("codes").combine_chunks() if isinstance(left.column("codes"), pa.ChunkedArray) else left.column("codes")
                m = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(left.num_rows, -1)
                norm, cosine, distance = (left.column(n).to_numpy() for n in ("grid_norm", "cosine", "centre_distance"))
                prepared = coder.prepare(knn.as_matrix(right.column("vector")), c[k][None])
                own, qid = left.column("id").to_numpy(), right.column("query_id").to_numpy()
                est = coder.estimate(m, norm, cosine, distance, prepared)
                for q in range(len(qid)):
                    top = np.lexsort((own, est[q]))[:budget]
                    ids.append((np.full(len(top), qid[q]), own[top]))
                    best.append(est[q][top])
            cols = [np.concatenate([i[0] for i in ids]), np.concatenate([i[1] for i in ids]), np.concatenate(best)] if ids else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2].astype(np.float32))})

        found = codes.groupBy("cluster_id").cogroup(probes.groupBy("cluster_id")).applyInArrow(scan, "query_id long, id long, distance float")
        return knn.rank_top(found, budget)

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, nprobe: int = 32, budget: int = 100, hidden: DataFrame | None = None) -> DataFrame:
        """Exact distances of the best candidates, from the stored vectors."""
        c = self.candidates(queries, nprobe, max(budget, k) if k > 0 else 0, hidden)
        return knn.rerank(c, queries, vectors, k)


_CODERS: dict = {}
