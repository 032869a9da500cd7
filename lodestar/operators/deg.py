"""The two-modality graph whose edges are active on ranges of the weight alpha, built in shards."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.operators.graph import beam_search
from lodestar.operators.knn import rank_top

Intervals = list[tuple[float, float]]
FULL: Intervals = [(0.0, 1.0)]


@dataclass(frozen=True)
class DegConfig:
    max_degree: int = 32
    build_pool: int = 64
    min_active_width: float = 0.05
    max_seeds: int = 16
    #: None: edges live on ranges of alpha; a number: one alpha for all edges (0 and 1 are one modality alone).
    fixed_alpha: float | None = None
    candidates: str = "gps"  # or "beam"
    entries: str = "seeds"  # or "interior"


def joined(pieces: Intervals) -> Intervals:
    out: Intervals = []
    for lo, hi in sorted(pieces):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def complement(a: Intervals) -> Intervals:
    gaps = zip([0.0, *(hi for _, hi in a)], [*(lo for lo, _ in a), 1.0])
    return [(lo, hi) for lo, hi in gaps if lo < hi]


def measure(a: Intervals) -> float:
    return sum(hi - lo for lo, hi in a)


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of {alpha in [0, 1]: a alpha < b}, closed; lo above hi where it is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = b / a
    lo = np.where(b > 0, 0.0, np.where((b < 0) & (a < 0) & (r < 1), r, np.where((b == 0) & (a < 0), 0.0, 2.0)))
    hi = np.where((b > 0) & (a > 0), np.minimum(r, 1.0), np.where(lo <= 1, 1.0, -1.0))
    return lo, hi


def pruned_by(xy, xz, yz) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the weights at which both other sides are shorter than xy; sides are (e, s) pairs, arrays allowed."""
    ends = [solved(np.asarray(o[0] - xy[0] + xy[1] - o[1], float), np.asarray(xy[1] - o[1], float)) for o in (xz, yz)]
    return np.maximum(ends[0][0], ends[1][0]), np.minimum(ends[0][1], ends[1][1])


def split_frontier(e: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which points no point dominates; equal pairs are all in."""
    order = np.lexsort((s, e))
    se, ss = e[order], s[order]
    new_e = np.concatenate([[True], se[1:] != se[:-1]])
    least = ss[np.flatnonzero(new_e)][np.cumsum(new_e) - 1]
    runs = np.minimum.accumulate(np.concatenate([[np.inf], ss[np.flatnonzero(new_e)]]))
    before = runs[np.cumsum(new_e) - 1]
    out = np.zeros(len(e), bool)
    out[order] = (ss == least) & (ss < before)
    return out


def depths(e: list[float], s: list[float]) -> list[int]:
    """The frontier, counted from 0, that each point is on when they are peeled off one by one; equal points share one.

    In order of (e, s) a point lies one below the last frontier that has as small an s already.
    """
    least: list[float] = []
    out, before, at = [0] * len(e), None, 0
    for p in sorted(range(len(e)), key=list(zip(e, s)).__getitem__):
        if (e[p], s[p]) != before:
            before, at = (e[p], s[p]), bisect_right(least, s[p])
            least[at : at + 1] = [s[p]]
        out[p] = at
    return out


def grouped(items: list, depth: list[int]) -> list[list]:
    out: list[list] = [[] for _ in range(max(depth, default=-1) + 1)]
    for x, at in zip(items, depth):
        out[at].append(x)
    return out


def layered(ids: np.ndarray, e: np.ndarray, s: np.ndarray, limit: int) -> list[np.ndarray]:
    """Frontiers peeled off, as places among the points, until ``limit`` are out; the last one whole."""
    out, taken = [], 0
    for places in grouped(list(range(len(ids))), depths(e.tolist(), s.tolist())):
        if taken >= limit:
            break
        out.append(np.array(places))
        taken += len(places)
    return out


class Link:
    """An edge while its graph is built: both lengths, and the range of weights at which each other edge of its vertex prunes it.

    Edges of a vertex have a bit each; that of an edge that is gone isn't given again before shrink().
    """

    __slots__ = ("id", "e", "s", "bit", "pruners", "ranges", "by", "active", "wide")

    def __init__(self, i: int, e: float, s: float, bit: int):
        self.id, self.e, self.s, self.bit = i, e, s, bit
        self.pruners, self.ranges, self.by, self.active, self.wide = 0, [], -1, FULL, False

    def add(self, bit: int, lo: float, hi: float) -> None:
        self.pruners |= bit
        self.ranges.append((bit, lo, hi))

    def rerange(self, by: int, fresh: int, least: float) -> None:
        """``active`` is what the edges ``by`` leave; where only ``fresh``, the last one added, came to them, it is cut out of it."""
        if self.by >= 0 and by == self.by | fresh:
            _, a, b = self.ranges[-1]
            self.active = [p for lo, hi in self.active for p in ((lo, min(hi, a)), (max(lo, b), hi)) if p[0] < p[1]]
        else:
            self.active = complement(joined([(lo, hi) for bit, lo, hi in self.ranges if bit & by]))
        self.by, self.wide = by, bool(self.active) and measure(self.active) >= least


def shrink(links: list[Link]) -> int:
    """Forget what edges that are gone prune, and number those that are left anew; the next bit."""
    bits = {x.bit: 1 << p for p, x in enumerate(links)}
    for x in links:
        x.ranges = [(bits[b], lo, hi) for b, lo, hi in x.ranges if b in bits]
        x.pruners, by = 0, 0
        for b, _, _ in x.ranges:
            x.pruners |= b
        for b, new in bits.items():
            if x.by & b:
                by |= new
        x.by, x.bit = by, bits[x.bit]
    return 1 << len(links)


class Deg:
    def __init__(self, e: np.ndarray, s: np.ndarray, maxima: tuple[float, float], config: DegConfig = DegConfig(), state=None):
        self.e, self.s, self.config = e.astype(np.float32), s.astype(np.float32), config
        self.emax, self.smax = (m if m > 0 else np.inf for m in maxima)
        n = len(e)
        if state is not None:
            self.adjacency, self.seeds = state
            return
        self.near: list[list[int]] = [[] for _ in range(n)]
        self.bits = [1] * n  # the next edge's
        self.links: list[list] = [[] for _ in range(n)]  # interval edges; lengths where alpha is fixed
        self.seeds: list[int] = [0] if n else []
        ce, cs = (self.e[0].astype(float), self.s[0].astype(float)) if n else (None, None)
        fixed = config.fixed_alpha is not None
        for v in range(1, n):
            layers = self._candidates(v)
            if fixed:
                self._select_fixed(v, layers)
                self._link_back_fixed(v)
            else:
                self._select(v, layers)
                self._link_back(v)
            ce, cs = ce + (self.e[v] - ce) / (v + 1), cs + (self.s[v] - cs) / (v + 1)
            pool = np.array([*self.seeds, *([v] if v not in self.seeds else [])])
            de, ds = self.to(ce, cs, pool)
            self.seeds = pool[split_frontier(-de, -ds)].tolist()[: max(1, config.max_seeds)] or [0]
        self.adjacency: list[list[tuple[int, Intervals]]] = [[(i, FULL) for i in ids] if fixed else [(x.id, x.active) for x in ls] for ids, ls in zip(self.near, self.links)]
        del self.near, self.links, self.bits

    #: Neighbours that a search left out by their first component alone.
    skipped = 0

    def one(self, qe, ids) -> np.ndarray:
        """The first of to()."""
        return np.sqrt(((self.e[ids] - qe) ** 2).sum(1)) / self.emax

    def to(self, qe, qs, ids) -> tuple[np.ndarray, np.ndarray]:
        """Both distances of objects from a point, each over its maximum."""
        return np.sqrt(((self.e[ids] - qe) ** 2).sum(1)) / self.emax, np.sqrt(((self.s[ids] - qs) ** 2).sum(1)) / self.smax

    def between(self, v: int, ids) -> tuple[np.ndarray, np.ndarray]:
        return self.to(self.e[v], self.s[v], ids)

    def _entries(self) -> list[int]:
        return self.seeds if self.config.entries == "seeds" else [0]

    def _candidates(self, v: int):
        c = self.config
        if c.candidates == "beam" or c.fixed_alpha is not None:
            alpha = 0.5 if c.fixed_alpha is None else c.fixed_alpha

            def distance(ids):
                de, ds = self.between(v, ids)
                return ds + alpha * (de - ds)

            ids = np.array([i for _, i in beam_search(self._entries(), max(1, c.build_pool), v, lambda u: self.near[u], distance)])
            if c.fixed_alpha is not None or not len(ids):
                de, ds = self.between(v, ids) if len(ids) else (np.empty(0), np.empty(0))
                return [(ids, de, ds)]
            de, ds = self.between(v, ids)
            return [(ids[p], de[p], ds[p]) for p in layered(ids, de, ds, len(ids))]
        return self._gps(v)

    def _gps(self, v: int):
        """Greedy expansion of the nearest Pareto layer that has something to expand, until the layers hold the pool."""
        pool = max(1, self.config.build_pool)
        ids = np.array([i for i in dict.fromkeys(self._entries()) if i < v], int)
        seen, done = set(ids.tolist()), set()
        de, ds = self.between(v, ids)
        while True:
            layers = layered(ids, de, ds, pool)
            if sum(map(len, layers)) >= pool:
                break
            open_ = next((o for p in layers if (o := [i for i in ids[p].tolist() if i not in done])), None)
            if not open_:
                break
            keep = np.concatenate(layers)
            fresh = []
            for u in open_:
                done.add(u)
                for t in self.near[u]:
                    if t < v and t not in seen:
                        seen.add(t)
                        fresh.append(t)
            more = np.array(fresh, int)
            fe, fs = self.between(v, more)
            ids, de, ds = np.concatenate([ids[keep], more]), np.concatenate([de[keep], fe]), np.concatenate([ds[keep], fs])
        return [(ids[p], de[p], ds[p]) for p in layers]

    def _kept(self, layers: list[list[Link]], fresh: int = 0) -> list[Link]:
        """In order, an edge stays where those that stayed before it leave enough of its range; only what these change is computed again."""
        c, out, kept = self.config, [], 0
        for layer in layers:
            for x in layer:
                by = x.pruners & kept
                if by != x.by:
                    x.rerange(by, fresh, c.min_active_width)
                if x.wide:
                    out.append(x)
                    kept |= x.bit
            if len(out) >= c.max_degree:
                break
        return out

    def _select(self, v: int, layers) -> None:
        """The edges of a new vertex; ``layers`` are its candidates in order."""
        ids = np.concatenate([x[0] for x in layers]) if layers else np.empty(0, int)
        if not len(ids):
            return
        de, ds = (np.concatenate([x[k] for x in layers]) for k in (1, 2))
        links = [Link(i, e, s, 1 << p) for p, (i, e, s) in enumerate(zip(ids.tolist(), de.tolist(), ds.tolist()))]
        a, b = np.triu_indices(len(ids), 1)
        xe, xs = self.e[ids], self.s[ids]
        yz = np.sqrt(((xe[a] - xe[b]) ** 2).sum(1)) / self.emax, np.sqrt(((xs[a] - xs[b]) ** 2).sum(1)) / self.smax
        prunes = np.zeros((2, len(ids), len(ids)))  # by pruner and pruned
        prunes[0] = 2
        for i, k in ((b, a), (a, b)):
            prunes[:, k, i] = pruned_by((de[i], ds[i]), (de[k].astype(float), ds[k].astype(float)), yz)
        kept: list[int] = []
        p = 0
        for layer in layers:
            for p in range(p, p + len(layer[0])):
                x = links[p]
                x.rerange(x.pruners, 0, self.config.min_active_width)
                if x.wide:
                    kept.append(p)
                    lo, hi = prunes[:, p, p + 1 :]
                    some = np.flatnonzero(lo <= hi)
                    for y, low, high in zip(some.tolist(), lo[some].tolist(), hi[some].tolist()):
                        links[p + 1 + y].add(x.bit, low, high)
            p += 1
            if len(kept) >= self.config.max_degree:
                break
        lo, hi = prunes[:, kept][:, :, kept]
        for y, x in zip(*(z.tolist() for z in np.nonzero(np.tril(lo <= hi, -1)))):
            links[kept[x]].add(links[kept[y]].bit, float(lo[y, x]), float(hi[y, x]))
        out = [links[p] for p in kept]
        self.links[v], self.near[v] = out, [x.id for x in out]
        self.bits[v] = shrink(out)

    def _link_back(self, v: int) -> None:
        """The edges to a new vertex. What others' edges prune there is known; only pairs with ``v`` are new, one batch for all."""
        mine = self.links[v]
        if not mine:
            return
        theirs = [self.links[x.id] for x in mine]
        lens = [len(ls) for ls in theirs]
        flat = [x for ls in theirs for x in ls]
        e, s = np.array([x.e for x in flat], np.float32), np.array([x.s for x in flat], np.float32)
        ve, vs = (np.repeat(np.array([getattr(x, c) for x in mine], np.float32), lens) for c in ("e", "s"))
        yz = self.between(v, np.array([x.id for x in flat], int))
        new = [Link(v, x.e, x.s, self.bits[x.id]) for x in mine]
        owner = np.repeat(np.arange(len(mine)), lens)
        lo, hi = pruned_by((ve, vs), (e.astype(float), s.astype(float)), yz)
        some = np.flatnonzero(lo <= hi)
        for o, p, low, high in zip(owner[some].tolist(), some.tolist(), lo[some].tolist(), hi[some].tolist()):
            new[o].add(flat[p].bit, low, high)
        lo, hi = pruned_by((e, s), (ve.astype(float), vs.astype(float)), yz)
        some = np.flatnonzero(lo <= hi)
        for o, p, low, high in zip(owner[some].tolist(), some.tolist(), lo[some].tolist(), hi[some].tolist()):
            flat[p].add(new[o].bit, low, high)
        for x, ls, fresh in zip(mine, theirs, new):
            ls.append(fresh)
            out = self._kept(grouped(ls, depths([y.e for y in ls], [y.s for y in ls])), fresh.bit)
            if fresh.wide:
                self.bits[x.id] = shrink(out) if fresh.bit >> 60 else fresh.bit << 1
            else:
                for y in out:
                    if y.pruners & fresh.bit:
                        y.pruners ^= fresh.bit
                        y.ranges.pop()
            self.links[x.id], self.near[x.id] = out, [y.id for y in out]

    def _select_fixed(self, v: int, layers) -> None:
        alpha, most = self.config.fixed_alpha, self.config.max_degree
        at = lambda d: d[1] + alpha * (d[0] - d[1])
        ids = np.concatenate([x[0] for x in layers]) if layers else np.empty(0, int)
        if not len(ids):
            return
        length = at(self.between(v, ids))
        order = np.lexsort((ids, length))
        ids, length = ids[order], length[order]
        blocked = np.zeros(len(ids), bool)
        kept: list[int] = []
        for p in range(len(ids)):
            if len(kept) >= most:
                break
            if not blocked[p]:
                kept.append(p)
                blocked |= (length[p] < length) & (at(self.between(int(ids[p]), ids)) < length)
        self.near[v], self.links[v] = ids[kept].tolist(), length[kept].tolist()

    def _link_back_fixed(self, v: int) -> None:
        """As _link_back(), edges being in order of length: those before ``v`` stay, those after it unless ``v`` prunes them."""
        alpha, most = self.config.fixed_alpha, self.config.max_degree
        mine = self.near[v]
        lens = [len(self.near[t]) for t in mine]
        ids = np.array([i for t in mine for i in self.near[t]], int)
        de, ds = self.between(v, ids)
        d = ds + alpha * (de - ds)
        length = np.array([x for t in mine for x in self.links[t]], np.float32)
        own = np.repeat(np.array(self.links[v], np.float32), lens)
        owner = np.repeat(np.arange(len(mine)), lens)
        out = np.bincount(owner[(length < own) & (d < own)], minlength=len(mine)).tolist()
        pruned = ((own < length) & (d < length)).tolist()
        begin = 0
        for t, l, n, gone in zip(mine, self.links[v], lens, out):
            part, begin = pruned[begin : begin + n], begin + n
            if gone:
                continue
            near, links = self.near[t], self.links[t]
            if any(part):
                near, links = [i for i, p in zip(near, part) if not p], [x for x, p in zip(links, part) if not p]
            place = bisect_right(links, l)
            near.insert(place, v)
            links.insert(place, l)
            self.near[t], self.links[t] = near[:most], links[:most]

    def search(self, qe: np.ndarray, qs: np.ndarray, alpha: float, k: int, beam: int) -> list[tuple[float, int]]:
        """Along the edges that are active at ``alpha``, which is cut to [0, 1]."""
        if k <= 0 or not self.adjacency:
            return []
        alpha = min(max(alpha, 0.0), 1.0)

        def distance(ids):
            de, ds = self.to(qe, qs, ids)
            return ds + alpha * (de - ds)

        def active(u):
            return [t for t, a in self.adjacency[u] if any(lo <= alpha <= hi for lo, hi in a)]

        def bounded(ids, worst):
            de = self.one(qe, ids)
            out = np.full(len(ids), np.inf)
            use = alpha * de <= worst  # the other component can't make up for more than this
            if use.any():
                out[use] = distance(ids[use])
            self.skipped += int((~use).sum())
            return out

        return beam_search(self._entries(), max(beam, k, 1), len(self.adjacency), active, distance, bounded if alpha > 0 else None)[:k]


def build_sharded(objects: DataFrame, maxima: tuple[float, float], shards: int, config: DegConfig = DegConfig()) -> DataFrame:
    """``(shard, pos, id, e, s, targets, active, seeds)``: a graph a shard of ``objects (id, e, s)``; each shard is a task of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        g = Deg(np.stack(pdf["e"].to_numpy()), np.stack(pdf["s"].to_numpy()), maxima, config)
        return pd.DataFrame({"shard": pdf["shard"], "pos": np.arange(len(pdf), dtype=np.int32), "id": pdf["id"], "e": pdf["e"], "s": pdf["s"], "targets": [[t for t, _ in a] for a in g.adjacency], "active": [[[x for p in i for x in p] for _, i in a] for a in g.adjacency], "seeds": [g.seeds if p == 0 else None for p in range(len(pdf))]})

    placed = objects.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("bigint").alias("id"), F.col("e").cast("array<float>").alias("e"), F.col("s").cast("array<float>").alias("s"))
    return placed.repartitionById(shards, "shard").groupBy("shard").applyInPandas(run, "shard int, pos int, id long, e array<float>, s array<float>, targets array<int>, active array<array<double>>, seeds array<int>")


def search_sharded(index: DataFrame, queries: DataFrame, maxima: tuple[float, float], alpha: float, k: int, beam: int, config: DegConfig = DegConfig()) -> DataFrame:
    """``(query_id, id, distance, rank)`` of ``queries (query_id, e, s)``."""
    at = index.select(F.col("shard").alias("at")).distinct()
    shards = (at.agg(F.max("at")).first()[0] or 0) + 1
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("e").cast("array<float>").alias("e"), F.col("s").cast("array<float>").alias("s")).crossJoin(at)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        left = left.sort_values("pos", ignore_index=True)
        edges = [[(int(t), list(zip(a[::2], a[1::2]))) for t, a in zip(ts, acts)] for ts, acts in zip(left["targets"], left["active"])]
        g = Deg(np.stack(left["e"].to_numpy()), np.stack(left["s"].to_numpy()), maxima, config, (edges, [int(x) for x in left["seeds"][0]]))
        ids = left["id"].to_numpy()
        rows = [(q, ids[v], d) for q, e, s in zip(right["query_id"], right["e"], right["s"]) for d, v in g.search(np.asarray(e, np.float32), np.asarray(s, np.float32), alpha, k, beam)]
        return pd.DataFrame(rows, columns=["query_id", "id", "distance"])

    found = index.repartitionById(shards, "shard").groupBy("shard").cogroup(asked.repartitionById(shards, "at").groupBy("at")).applyInPandas(run, "query_id long, id long, distance double")
    return rank_top(found, k)
