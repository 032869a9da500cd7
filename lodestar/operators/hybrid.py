"""Two-modality objects (e, s): maxima, normalised distances, exact search at a weight, Pareto frontiers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.functions.distance import hybrid, squared_l2
from lodestar.operators.knn import as_matrix, rank_top
from lodestar.runtime import cut


def pair_maxima(objects: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(emax, smax)``: the largest distance of any two of ``objects (id, e, s)``, or of the given ``pairs (a, b)``."""
    a = objects.select(F.col("id").alias("a"), F.col("e").alias("ea"), F.col("s").alias("sa"))
    b = objects.select(F.col("id").alias("b"), F.col("e").alias("eb"), F.col("s").alias("sb"))
    both = a.join(b, F.col("a") < F.col("b")) if pairs is None else pairs.join(a, "a").join(b, "b")
    return both.agg(F.sqrt(F.max(squared_l2(F.col("ea"), F.col("eb")))).alias("emax"), F.sqrt(F.max(squared_l2(F.col("sa"), F.col("sb")))).alias("smax"))


#: Objects in a group; a pair of groups is one task of whole_maxima().
GROUP = 50_000


def farthest(a: np.ndarray, b: np.ndarray | None, least: float = 0.0, block: int = 2048) -> float:
    """The largest squared distance of a row of ``a`` and one of ``b``, or of two of ``a``; ``least`` if none is larger.

    Single-precision products select, with room for their rounding; what is selected is computed again in double
    precision from the left. Blocks are by distance from the mean; two that can't hold a larger one are passed over.
    """
    centre = a.mean(0)
    sides = []
    for x in (a,) if b is None else (a, b):
        r = np.sqrt(((x - centre) ** 2).sum(1))
        order = np.argsort(-r, kind="stable")
        x, r = x[order], r[order]
        c = (x - centre).astype(np.float32)
        n, one = (c * c).sum(1, keepdims=True), np.ones((len(c), 1), np.float32)
        sides.append((x, r, np.hstack([c, n, one]), np.hstack([-2 * c, one, n])))
    (x, rx, left, _), (y, ry, _, right) = sides[0], sides[-1]
    for i in range(0, len(x), block):
        for j in range(i if b is None else 0, len(y), block):
            if (rx[i] + ry[j]) ** 2 * (1 + 1e-9) < least:
                break
            near = left[i : i + block] @ right[j : j + block].T
            room = np.float32(2e-5) * np.float32(rx[i] + ry[j]) ** 2
            edge = max(near.max() - room, least - room)
            if near.max() < edge:
                continue
            p, q = np.nonzero(near >= edge)
            for at in range(0, len(p), 1 << 16):
                d = x[i : i + block][p[at : at + (1 << 16)]] - y[j : j + block][q[at : at + (1 << 16)]]
                least = max(least, float(np.cumsum(d * d, axis=1)[:, -1].max(initial=0)) if d.shape[1] else 0.0)
    return least


def whole_maxima(objects: DataFrame) -> tuple[float, float]:
    """As pair_maxima() of all ``objects (id, e, s)``, at any size: groups of fixed size, and a task for each pair of them.

    Every pair of objects is covered, by matrix products, so time is quadratic in the end; memory of a task is bounded.
    """
    groups = max(1, -(-objects.count() // GROUP))
    tasks = groups * (groups + 1) // 2
    number = lambda g, h: F.when(g <= h, h * (h + 1) / 2 + g).otherwise(g * (g + 1) / 2 + h).cast("int")
    placed = objects.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "e", "s")
    sent = placed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(number(F.col("g"), F.col("h")).alias("task"), "g", "e", "s")

    def run(batches):
        parts: dict[int, dict[int, list]] = {}
        for x in batches:
            g, task = (x.column(c).to_numpy() for c in ("g", "task"))
            e, s = (as_matrix(x.column(c), np.float64) for c in ("e", "s"))
            for t, k in sorted(set(zip(task.tolist(), g.tolist()))):
                some = (task == t) & (g == k)
                parts.setdefault(t, {}).setdefault(k, []).append((e[some], s[some]))
        for sides in parts.values():
            found = []
            for c in (0, 1):
                both = [np.concatenate([x[c] for x in sides[k]]) for k in sorted(sides)]
                if not all(np.isfinite(x).all() for x in both):
                    raise ValueError("vectors that aren't finite")
                found.append(farthest(both[0], both[1] if len(both) > 1 else None))
            yield pa.RecordBatch.from_arrays([pa.array([found[0]]), pa.array([found[1]])], ["e", "s"])

    most = sent.repartitionById(tasks, "task").mapInArrow(run, "e double, s double").agg(F.max("e"), F.max("s")).first()
    return math.sqrt(most[0] or 0.0), math.sqrt(most[1] or 0.0)


def sampled_pairs(objects: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(a, b)``: up to ``n`` pairs of different objects, drawn by a seeded hash; a pair_maxima() over them takes no
    product of all objects. The 2 n least hashes are paired, each with the one n places after it."""
    drawn = objects.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2 * n)
    placed = drawn.withColumn("place", F.row_number().over(W.orderBy(F.xxhash64("id", F.lit(seed)), "id")))  # 2 n ids
    half = placed.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    a = placed.crossJoin(F.broadcast(half)).filter("place <= half")  # one row
    return a.select(F.col("id").alias("a"), (F.col("place") + F.col("half")).alias("place")).join(placed.withColumnRenamed("id", "b"), "place").select("a", "b")


def second_modality(objects: DataFrame, seed: int = 0, *, projected: bool = False, size: int = 2) -> DataFrame:
    """``objects (id, e)`` with ``s``: ``size`` numbers uniform over [0, 1) by a seeded hash of the id, or a fixed
    seeded projection of ``e`` whose directions have independent normal coordinates."""
    if not projected:
        return objects.withColumn("s", F.array(*[(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(j)), 11) / F.lit(float(1 << 53))).cast("float") for j in range(size)]))
    import numpy as np

    n = objects.agg(F.max(F.size("e"))).first()[0] or 0
    rows = np.random.default_rng(seed).standard_normal((size, n)) / max(1, n) ** 0.5
    dot = lambda row: F.aggregate(F.zip_with("e", F.array(*map(F.lit, row.tolist())), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x).cast("float")
    return objects.withColumn("s", F.array(*map(dot, rows)) if n else F.array().cast("array<float>"))


def components(queries: DataFrame, objects: DataFrame, maxima: DataFrame) -> DataFrame:
    """``(query_id, id, e, s)``: both distances, each over its maximum; a maximum of 0 gives 0."""
    q = queries.select("query_id", F.col("e").alias("qe"), F.col("s").alias("qs"))
    part = lambda a, b, most: F.coalesce(F.sqrt(squared_l2(F.col(a), F.col(b))) / F.nullif(F.col(most), F.lit(0.0)), F.lit(0.0))
    return objects.crossJoin(q).crossJoin(F.broadcast(maxima)).select("query_id", "id", part("e", "qe", "emax").alias("e"), part("s", "qs", "smax").alias("s"))


def exact_search(queries: DataFrame, objects: DataFrame, maxima: DataFrame, alpha: float, k: int) -> DataFrame:
    d = hybrid(F.col("e"), F.col("s"), F.lit(float(alpha)))
    return rank_top(components(queries, objects, maxima).select("query_id", "id", d.alias("distance")), k)


def merged_baseline(queries: DataFrame, objects: DataFrame, maxima: DataFrame, alpha: float, k: int, each: int) -> DataFrame:
    """Top ``each`` by either component alone, joined into one set, ranked by the hybrid distance."""
    c = components(queries, objects, maxima)
    by_e = rank_top(c, each, order=("e", "id")).select("query_id", "id")
    by_s = rank_top(c, each, order=("s", "id")).select("query_id", "id")
    d = hybrid(F.col("e"), F.col("s"), F.lit(float(alpha)))
    return rank_top(c.join(by_e.union(by_s).distinct(), ["query_id", "id"]).select("query_id", "id", d.alias("distance")), k)


def frontier(points: DataFrame, e: str = "e", s: str = "s", within: list[str] | None = None) -> DataFrame:
    """The rows that no row dominates (as small or smaller in both, smaller in one); equal pairs all stay.

    Per value of e only the least s can be on it, so the running minimum goes over distinct e values.
    """
    within = within or []
    least = points.groupBy(*within, e).agg(F.min(s).alias("_s"))
    if within:
        before = F.min("_s").over(W.partitionBy(*within).orderBy(e).rowsBetween(W.unboundedPreceding, -1))
        best = least.withColumn("_before", before)
    else:
        best = _running_min(least, e)
    best = best.filter(F.col("_before").isNull() | (F.col("_s") < F.col("_before"))).drop("_before")
    return points.join(best, [*within, e]).filter(F.col(s) == F.col("_s")).drop("_s")


def _running_min(rows: DataFrame, key: str) -> DataFrame:
    """``_before``: the least ``_s`` of all rows with a lesser key, without one task that holds them all."""
    parts = cut(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    per = parts.groupBy("_p").agg(F.min("_s").alias("_m"))
    prior = per.withColumn("_prior", F.min("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).drop("_m")
    own = F.min("_s").over(W.partitionBy("_p").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    return parts.withColumn("_own", own).join(prior, "_p").withColumn("_before", F.least("_own", "_prior")).drop("_own", "_prior", "_p")


def frontier_layers(points: DataFrame, key: str, limit: int, e: str = "e", s: str = "s") -> DataFrame:
    """``points`` with ``layer``: frontiers peeled one by one until ``limit`` rows are out, the last layer whole."""
    left, out, taken, layer = points, None, 0, 0
    while taken < limit:
        top = cut(frontier(left, e, s).withColumn("layer", F.lit(layer)))
        n = top.count()
        if not n:
            break
        out = top if out is None else out.union(top)
        left, taken, layer = cut(left.join(top.select(key), key, "left_anti")), taken + n, layer + 1
    return out if out is not None else points.withColumn("layer", F.lit(0)).limit(0)


def dominated_pairs(points: DataFrame, key: str, e: str = "e", s: str = "s") -> DataFrame:
    """``(id, n_dominators)`` of every dominated point."""
    a, b = points.alias("a"), points.alias("b")
    less = (F.col(f"b.{e}") <= F.col(f"a.{e}")) & (F.col(f"b.{s}") <= F.col(f"a.{s}")) & ((F.col(f"b.{e}") < F.col(f"a.{e}")) | (F.col(f"b.{s}") < F.col(f"a.{s}")))
    return a.join(b, less).groupBy(F.col(f"a.{key}").alias("id")).agg(F.count(F.lit(1)).alias("n_dominators"))
