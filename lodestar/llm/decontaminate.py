"""Benchmark decontamination by SimHash over windows of the items' own sizes, verified exactly.

Texts are words in lower case without punctuation; features are pairs of neighbouring words, a
pair's weight being its length in bytes. An item is in a document if some window of the item's size
has LEAST of the item's weight. Windows whose pairs can't give that much weight to any item are left
out first, which is exact. The others get a SimHash of 64 bits. At a similarity s, two fingerprints
differ in about 64 acos(s) / pi bits; RADIUS is at least what FOUND of the windows at LEAST stay
within. A multi-index finds all items within RADIUS: eight tables, by 8-bit block, hold each item
under all blocks within SUB_RADIUS bits, and of RADIUS bits at most SUB_RADIUS fall on some block. An
item with such a window is then weighed in every window of the document, by running sums over the
ranges of windows that hold a pair, so the similarity given is exact and that of the best window.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.textutil import lower, mix64, pieces, text_bytes, words
from lodestar.runtime import table

LEAST = 0.7
FOUND = 0.999


def radius_for(similarity: float, found: float = FOUND) -> int:
    """Bits, of 64, within which the fingerprints of ``found`` of the pairs of this similarity are."""
    p, total, r = acos(similarity) / pi, 0.0, -1
    while total < found:
        r += 1
        total += comb(64, r) * p**r * (1 - p) ** (64 - r)
    return r


BLOCKS = 8
SUB_RADIUS = radius_for(LEAST) // BLOCKS
#: All that the tables are complete for.
RADIUS = BLOCKS * (SUB_RADIUS + 1) - 1
#: Windows that are fingerprinted at once.
STEP = 4096
#: Items that one pass over the documents looks for; a larger benchmark takes more passes.
ITEMS_A_PASS = 20_000


def pairs_of(h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of neighbouring words of one run of words."""
    return mix64(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5)), (length[:-1] + length[1:]).astype(np.int64)


def fingerprints(pairs: np.ndarray, weights: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows of ``size`` pairs that begin at ``starts``, in order; the last ones may be cut off by the end."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), STEP):
        part = starts[lo : lo + STEP]
        while len(part):
            near = part[: np.searchsorted(part, part[0] + STEP)]
            a, b = int(near[0]), min(int(near[-1]) + size, len(pairs))
            bits = np.unpackbits(np.ascontiguousarray(pairs[a:b]).view(np.uint8).reshape(-1, 8), axis=-1, bitorder="little")
            sums = np.zeros((b - a + 1, 64), np.int64)
            np.cumsum(np.where(bits > 0, weights[a:b, None], -weights[a:b, None]), axis=0, out=sums[1:])
            total = sums[np.minimum(near + size, b) - a] - sums[near - a]
            at = lo + int(np.searchsorted(starts[lo : lo + STEP], near[0]))
            out[at : at + len(near)] = np.packbits(total > 0, axis=-1, bitorder="little").view(np.uint64).ravel()
            part = part[len(near) :]
    return out


NEAR = np.array([sum(1 << i for i in c) for r in range(SUB_RADIUS + 1) for c in combinations(range(8), r)], np.uint8)


class Index:
    """The items of a pass: by word pair which items have it, and by size their fingerprints' multi-index."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        found = pa.array([t for _, t in items], pa.string())
        data, off = text_bytes(found)
        start, end, h, at = words(lower(data), off)
        for k, (item, _) in enumerate(items):
            a, b = at[k], at[k + 1]
            if b - a < 2:
                continue
            p, w = pairs_of(h[a:b], end[a:b] - start[a:b])
            u, first = np.unique(p, return_index=True)
            print_ = fingerprints(p, w, len(p), np.zeros(1, np.int64))[0]
            self.items.append({"item": item, "words": int(b - a), "pairs": u, "weights": w[first], "total": int(w[first].sum()), "print": print_})
        self.every = np.unique(np.concatenate([x["pairs"] for x in self.items])) if self.items else np.empty(0, np.uint64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.every >> np.uint64(42)).astype(np.int64)] = True
        self.totals = np.array([x["total"] for x in self.items], np.int64)
        self.need = max(1, int(LEAST * self.totals.min())) if self.items else 1
        for x in self.items:
            x["at"] = np.searchsorted(self.every, x["pairs"])
        at, who, weight = (np.concatenate(c) if self.items else np.empty(0, np.int64) for c in ([x["at"] for x in self.items], [np.full(len(x["at"]), i) for i, x in enumerate(self.items)], [x["weights"] for x in self.items]))
        order = np.argsort(at, kind="stable")
        self.lists, self.who, self.weight = np.searchsorted(at[order], np.arange(len(self.every) + 1)), who[order], weight[order]

        self.sizes: dict[int, dict] = {}
        for i, x in enumerate(self.items):
            self.sizes.setdefault(x["words"], []).append(i)
        for size, own in self.sizes.items():
            prints = np.array([self.items[i]["print"] for i in own], np.uint64)
            tables = []
            for block in range(BLOCKS):
                near = ((prints >> np.uint64(8 * block)).astype(np.uint8)[:, None] ^ NEAR[None]).ravel()
                who = np.repeat(np.array(own, np.int32), len(NEAR))
                order = np.argsort(near, kind="stable")
                tables.append((np.searchsorted(near[order], np.arange(257)), who[order]))
            self.sizes[size] = {"own": np.array(own), "tables": tables}

    def within(self, size: int, prints: np.ndarray) -> set[int]:
        """The items of a size that have one of these fingerprints within RADIUS."""
        prints, out = np.unique(prints), set()
        for block, (at, who) in enumerate(self.sizes[size]["tables"]):
            values = (prints >> np.uint64(8 * block)).astype(np.uint8)
            for value in np.unique(values):
                todo = [i for i in who[at[value] : at[int(value) + 1]].tolist() if i not in out]
                here = prints[values == value]
                out.update(i for i in todo if np.bitwise_count(here ^ self.items[i]["print"]).min() <= RADIUS)
        return out

    def find(self, pairs: np.ndarray, weights: np.ndarray) -> dict[int, tuple[float, int]]:
        """Items in a document's pairs: index of item -> best similarity and the word at which its first best window starts."""
        best: dict[int, tuple[float, int]] = {}
        place = np.flatnonzero(self.seen[(pairs >> np.uint64(42)).astype(np.int64)])
        k = np.searchsorted(self.every, pairs[place])
        k[k == len(self.every)] = 0
        same = self.every[k] == pairs[place]
        place, k = place[same], k[same]
        if not len(k):
            return best
        order = np.lexsort((place, k))
        place, k = place[order], k[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        before = np.where(new, -1, np.concatenate([[-1], place[:-1]]))
        u = k[new]
        count = self.lists[u + 1] - self.lists[u]
        at = np.repeat(self.lists[u] - np.cumsum(count) + count, count) + np.arange(count.sum())
        have = np.bincount(self.who[at], self.weight[at], minlength=len(self.items))
        may = np.flatnonzero(have >= LEAST * self.totals - 1e-6)  # the others have too little of their weight anywhere
        own = {}
        for i in may.tolist():
            at = np.searchsorted(self.items[i]["at"], k)
            at[at == len(self.items[i]["at"])] = 0
            own[i] = at, self.items[i]["at"][at] == k
        for size in {self.items[i]["words"] for i in own}:
            some = [i for i in own if self.items[i]["words"] == size]
            held = np.zeros(len(pairs) + 1, np.int64)
            for i in some:
                held[place[own[i][1]] + 1] = weights[place[own[i][1]]]
            held = np.cumsum(held)
            start = np.arange(max(1, len(pairs) - (size - 1) + 1))
            start = start[held[np.minimum(start + size - 1, len(pairs))] - held[start] >= LEAST * self.totals[some].min() - 1e-6]
            near = self.within(size, fingerprints(pairs, weights, size - 1, start)) if len(start) else set()
            for i in near.intersection(some):
                x, (at, mine) = self.items[i], own[i]
                p, w = place[mine], x["weights"][at[mine]]
                # a pair counts once in a window: for those that begin after its last occurrence before
                first = np.maximum(np.maximum(before[mine] + 1, p - size + 2), 0)
                begin, back = np.unique(np.concatenate([first, p + 1]), return_inverse=True)
                sums = np.cumsum(np.bincount(back, np.concatenate([w, -w]).astype(np.float64)))
                top = int(np.argmax(sums))
                s = float(sums[top] / x["total"])
                if s >= LEAST:
                    best[i] = (s, int(begin[top]))
        return best


def found_in(col: pa.Array, index: Index) -> list[dict[int, tuple[float, int]]]:
    """For each text what ``find`` gives."""
    data, off = text_bytes(col)
    start, end, h, at = words(lower(data), off)
    out: list[dict] = [{} for _ in range(len(col))]
    if len(h) < 2 or not index.items:
        return out
    p, w = pairs_of(h, end - start)
    last = at[1:][np.diff(at) > 0] - 1  # a pair across two texts is none
    hit = index.seen[(p >> np.uint64(42)).astype(np.int64)]
    hit[last[last < len(hit)]] = False
    sums = np.concatenate([[0], np.cumsum(np.where(hit, w, 0))])
    upto = np.minimum(np.maximum(at[1:] - 1, at[:-1]), len(w))
    for i in np.flatnonzero(sums[upto] - sums[np.minimum(at[:-1], len(w))] >= index.need):
        a, b = at[i], at[i + 1]
        if b - a >= 2:
            out[i] = index.find(p[a : b - 1], w[a : b - 1])
    return out


def passes(benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS):
    """The benchmark's items, ``(item_id, text)``, in as many passes as their number asks for; null ids and texts don't count."""
    b = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-b.count() // items_a_pass))
    for k in range(n):
        part = b.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else b
        yield [(r[0], r[1]) for r in part.collect()]  # about items_a_pass rows


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, word)``: the items that a document has, each at its best window.

    Null and empty texts, and items of fewer than two words, match nothing; a null doc_id stays null;
    rows that repeat are each searched, and so are items. Texts are searched whole, whatever their
    length. Of windows that tie, the first counts. Either table may be empty; other columns aren't read.
    """
    out = None
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        part = picked.mapInArrow(_search(shared), "doc_id long, item_id long, similarity double, word long")
        out = part if out is None else out.union(part)
    return out


def _search(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[k], index.items[i]["item"], s, at) for k, got in enumerate(found_in(b.column("text"), index)) for i, (s, at) in sorted(got.items())]
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "word"])

    return run


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns, whatever their names.

    Rows of null or empty texts stay, rows that repeat stay or go together, and an empty benchmark
    removes nothing.
    """
    out = docs
    for items in passes(table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in batches:
                for b in pieces(batch, "text", 1 << 20):
                    yield b.filter(pa.array([not got for got in found_in(b.column("text"), index)]))

        out = out.mapInArrow(run, docs.schema)
    return out


#: Every window weighed in SQL: a pair counts for the windows from ``f``, where it enters, to its own place ``p``.
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') as w from documents where text is not null),
b as (select row_number() over () as i, item_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark where item_id is not null and text is not null),
dp as (select r, doc_id, p, w[p + 1] || ' ' || w[p + 2] as pair from (select *, unnest(range(len(w) - 1)) as p from d)),
ip as (select distinct i, item_id, len(w) as words, w[p + 1] || ' ' || w[p + 2] as pair, strlen(w[p + 1]) + strlen(w[p + 2]) as weight from (select *, unnest(range(len(w) - 1)) as p from b)),
t as (select i, sum(weight) as total from ip group by i),
h as (select r, doc_id, i, item_id, p, weight, greatest(coalesce(lag(p) over (partition by r, i, pair order by p), -1) + 1, p - words + 2, 0) as f, pair from dp join ip using (pair)),
c as (select r, i from (select distinct r, i, pair, weight from h) join t using (i) group by r, i having sum(weight) >= {LEAST} * any_value(total)),
k as (select h.*, total from h join c using (r, i) join t using (i)),
s as (select e.r, e.i, any_value(k.doc_id) as doc_id, any_value(k.item_id) as item_id, e.f as word, sum(k.weight)::double / any_value(k.total) as similarity
      from (select distinct r, i, f from k) e join k on k.r = e.r and k.i = e.i and k.f <= e.f and e.f <= k.p group by e.r, e.i, e.f)
select doc_id, item_id, similarity, word::bigint as word
from (select *, row_number() over (partition by r, i order by similarity desc, word) as n from s) where n = 1 and similarity >= {LEAST}
"""
