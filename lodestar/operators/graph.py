"""Proximity graphs, built in shards: each shard's graph is one sequential build, and the exact
distances that searches return let shards' answers be merged. One shard is the unsharded graph."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.functions.kernels import ResidualCodes
from lodestar.operators.knn import rank_top

TINY = np.finfo(np.float32).tiny

#: Rows a shard. Time and memory of a shard's task, and so a row's share, don't grow with the table; the number of shards does.
SHARD = 1000


def shards_of(rows: DataFrame, least: int) -> int:
    """Shards for a table's rows: ``least``, or more where shards would be larger than SHARD."""
    return max(least, -(-rows.count() // SHARD))


@dataclass(frozen=True)
class GraphConfig:
    max_degree: int = 32
    build_beam: int = 64
    prune_angle: float = 60.0
    align_degree: bool = False


def squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def beam_search(entries, beam: int, limit: int, neighbours, distance, bounded=None) -> list[tuple[float, int]]:
    """Best-first search with a bounded result: (distance, id) in order. ``distance`` takes an array of ids.

    ``bounded``, if given, takes ids and the distance from which on, the result being full, one is of no use;
    it may give infinity for such an id instead of its distance, which changes no result.
    """
    seen, frontier, found = set(), [], []
    for e in entries:
        if e < limit and e not in seen:
            seen.add(e)
            d = float(distance(np.array([e]))[0])
            heapq.heappush(frontier, (d, e))
            heapq.heappush(found, (-d, -e))
    while len(found) > beam:
        heapq.heappop(found)
    while frontier:
        d, at = heapq.heappop(frontier)
        if len(found) >= beam and d > -found[0][0]:
            break
        fresh = [v for v in neighbours(at) if v < limit and v not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        got = bounded(np.array(fresh), -found[0][0]) if bounded and len(found) >= beam else distance(np.array(fresh))
        for dist, v in zip(got.tolist(), fresh):
            if len(found) < beam or dist < -found[0][0]:
                heapq.heappush(frontier, (dist, v))
                heapq.heappush(found, (-dist, -v))
                if len(found) > beam:
                    heapq.heappop(found)
    return sorted((-d, -v) for d, v in found)


class ProximityGraph:
    """Vectors inserted one by one: candidates by beam search, thinned by angle, edges both ways."""

    def __init__(self, data: np.ndarray, config: GraphConfig = GraphConfig(), adjacency: list[list[int]] | None = None):
        self.data, self.config = data.astype(np.float32), config
        if adjacency is not None:
            self.adjacency = adjacency
            return
        self.adjacency = [[] for _ in range(len(data))]
        for v in range(1, len(data)):
            near = self._search(self.data[v], config.build_beam, v)
            self.adjacency[v] = self.prune(v, [i for _, i in near], config.max_degree, config.prune_angle)
            for t in self.adjacency[v]:
                self.adjacency[t].append(v)
                if len(self.adjacency[t]) > config.max_degree:
                    self.adjacency[t] = self.prune(t, self._by_distance(t, self.adjacency[t]), config.max_degree, config.prune_angle)
        if config.align_degree:
            self._align()

    def _by_distance(self, v: int, ids: list[int]) -> list[int]:
        d = squared(self.data[ids], self.data[v])
        return [ids[i] for i in np.lexsort((ids, d))]

    def _search(self, q: np.ndarray, beam: int, limit: int) -> list[tuple[float, int]]:
        return beam_search([0], max(1, beam), limit, lambda v: self.adjacency[v], lambda ids: squared(self.data[ids], q)) if limit else []

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        return self._search(q.astype(np.float32), max(beam, k), len(self.data))[: max(k, 0)]

    def prune(self, v: int, ids: list[int], most: int, angle: float) -> list[int]:
        """In the order given, an id stays unless its direction is within ``angle`` of one that stayed."""
        ids = [i for i in ids if i != v]
        if not ids:
            return []
        return self._thinned(ids, *self._cosines(v, ids), most, angle)

    def _cosines(self, v: int, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the directions from ``v``, and which of them there are."""
        d = self.data[ids] - self.data[v]
        n = np.sqrt(np.einsum("ij,ij->i", d, d))
        keep_row = n > TINY
        d = d / np.where(keep_row, n, np.float32(1))[:, None]
        return d @ d.T, keep_row

    @staticmethod
    def _thinned(ids: list[int], cosines: np.ndarray, keep_row: np.ndarray, most: int, angle: float) -> list[int]:
        if not ids:
            return []
        close = cosines > np.cos(np.radians(angle))
        kept: list[int] = []
        free = keep_row.copy()
        at = int(free.argmax())
        while len(kept) < most and free[at]:
            kept.append(ids[at])
            free[at] = False
            free &= ~close[at]
            at = int(free.argmax())
        return kept

    def _align(self) -> None:
        """Where a vertex has room, the widest angle by bisection at which its degree is full."""
        most = self.config.max_degree
        for v in range(len(self.data)):
            have = self.adjacency[v]
            if len(have) >= most:
                continue
            near = [i for _, i in self._search(self.data[v], most * 4, len(self.data))]
            if len(near) <= len(have):
                continue
            near = [i for i in near if i != v]
            cosines, keep_row = self._cosines(v, near)
            low, high, best = 0.0, self.config.prune_angle, have
            for _ in range(20):
                mid = (low + high) / 2
                kept = self._thinned(near, cosines, keep_row, most, mid)
                if len(kept) >= most:
                    best, low = kept, mid
                else:
                    high = mid
                if high - low < 0.05:
                    break
            if len(best) > len(have):
                self.adjacency[v] = best

    def mean_out_degree(self) -> float:
        return sum(map(len, self.adjacency)) / len(self.adjacency) if self.adjacency else 0.0


class Symphony:
    """A graph whose edges carry a code of the neighbour relative to the vertex: exact distances are
    computed for visited vertices only, and what to visit next is estimated."""

    def __init__(self, data: np.ndarray, config: GraphConfig = GraphConfig(align_degree=True), bits: int = 5, seed: int = 0x5EED, adjacency=None):
        self.graph = ProximityGraph(data, config, adjacency)
        x = self.graph.data
        self.coder = ResidualCodes(x.shape[1], bits, seed) if len(x) else None
        self.vertices = []
        for v, ids in enumerate(self.graph.adjacency):
            turned = self.coder.turned(x[v][None])[0]
            if not ids:
                self.vertices.append(None)
                continue
            codes, norm, cosine, distance = self.coder.encode(x[ids], x[v][None])
            c = codes.astype(np.float32)
            self.vertices.append((np.array(ids), c, norm, cosine, distance, c @ turned, np.float32(turned.sum())))

    def estimates(self, v: int, turned: np.ndarray, total: float, centre: float) -> np.ndarray:
        ids, c, norm, cosine, distance, projection, centre_sum = self.vertices[v]
        if centre <= TINY:
            return np.full(len(ids), np.inf, np.float32)
        inner = (c @ turned - projection - self.coder.offset * (total - centre_sum)) / (norm * np.float32(centre))
        inner = inner / np.where(np.abs(cosine) < TINY, np.float32(np.nan), cosine)
        d = np.maximum(distance**2 + np.float32(centre) ** 2 - 2 * distance * np.float32(centre) * inner, 0)
        return np.where(np.isnan(d), np.float32(np.inf), d)

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        if k <= 0 or not self.vertices:
            return []
        q = q.astype(np.float32)
        turned = self.coder.turned(q[None])[0]
        total, width = np.float32(turned.sum()), max(beam, k, 1)
        waiting, visited, found = [(0.0, 0)], set(), []
        while True:
            at = next((v for _, v in waiting if v not in visited), None)
            if at is None:
                return sorted(found)[:k]
            visited.add(at)
            exact = float(squared(self.graph.data[at][None], q)[0])
            found.append((exact, at))
            if self.vertices[at] is not None:
                est = self.estimates(at, turned, total, float(np.sqrt(exact)))
                waiting += [(float(e), int(v)) for e, v in zip(est, self.vertices[at][0]) if int(v) not in visited]
                waiting = sorted(waiting)[:width]


def build_sharded(vectors: DataFrame, shards: int, kind: str = "graph", config: GraphConfig | None = None) -> DataFrame:
    """``(shard, pos, id, vector, neighbours)``: one graph a shard of ``vectors (id, vector)``, inserted by id.

    ``neighbours`` are places within the shard. A shard is a task of its own; choose ``shards`` by shards_of().
    """
    config = config or GraphConfig(align_degree=kind == "symphony")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        g = ProximityGraph(np.stack(pdf["vector"].to_numpy()), config)
        return pd.DataFrame({"shard": pdf["shard"], "pos": np.arange(len(pdf), dtype=np.int32), "id": pdf["id"], "vector": pdf["vector"], "neighbours": g.adjacency})

    placed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    return placed.repartitionById(shards, "shard").groupBy("shard").applyInPandas(run, "shard int, pos int, id long, vector array<float>, neighbours array<int>")


def search_sharded(index: DataFrame, queries: DataFrame, k: int, beam: int, kind: str = "graph", bits: int = 5, seed: int = 0x5EED) -> DataFrame:
    """``(query_id, id, distance, rank)``: every shard is searched for every query, and the answers merged.

    Queries are sent to each shard by a join, so neither side has to be small.
    """
    at = index.select(F.col("shard").alias("at")).distinct()
    shards = (at.agg(F.max("at")).first()[0] or 0) + 1
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")).crossJoin(at)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        left = left.sort_values("pos", ignore_index=True)
        data, ids = np.stack(left["vector"].to_numpy()), left["id"].to_numpy()
        adjacency = [list(map(int, n)) for n in left["neighbours"]]
        g = ProximityGraph(data, adjacency=adjacency) if kind == "graph" else Symphony(data, bits=bits, seed=seed, adjacency=adjacency)
        rows = [(q, ids[v], d) for q, x in zip(right["query_id"], right["vector"]) for d, v in g.search(np.asarray(x, np.float32), k, beam)]
        return pd.DataFrame(rows, columns=["query_id", "id", "distance"])

    found = index.repartitionById(shards, "shard").groupBy("shard").cogroup(asked.repartitionById(shards, "at").groupBy("at")).applyInPandas(run, "query_id long, id long, distance double")
    return rank_top(found, k)
