"""Near-duplicates by a containment ensemble over MinHash signatures, with exact checks.

A document is the set of its runs of K words, in lower case; it is a copy of another one if T of the
smaller set lies in the larger one. Sets are put into partitions by size, STEPS to an octave. Of two
sets d partitions apart, the larger has less than 2^((d + 1) / STEPS) times as many shingles, so a
containment of T means a Jaccard similarity of T / (1 + that - T) at least. Each distance has a
banding of its own (BANDING), with as many bands as find FOUND of the pairs at that bound. Further
apart the bound falls as fast as sizes rise, and rows of MinHash with it. There the bands are
single shingles: the smaller set asks with its SAMPLE least shingle hashes, and an inverted list
holds all shingles of all sets. A set that holds T of it has at least ``needed`` of these in all but
one case of a hundred, whatever the ratio of sizes, so asking with all but ``needed`` - 1 of them, the
rarest, is enough. Nothing is found by an estimate alone: T is checked on the sets themselves.

Two sets that hold each other to T are copies; copies of copies form a group (connected
components). A set that is only contained in a larger one joins that one's group but ties nothing
together, so two long documents that quote one short one stay apart. The largest document of a
group, of equals the one of least id, is the one to keep.

Groups may have any size. Exact copies are folded first. Each set is held against the top that most
of its buckets have, then components against the tops of their buckets and against a few other
hubs, which folds large groups at little cost. At last every set is held against every member of
its buckets that is still in another component, so each candidate pair is merged or checked, but for
pairs whose signatures agree less than those of 999 in 1,000 pairs at the bound of their distance do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.llm.textutil import distinct, lower, mix64, pieces, shingles, text_bytes, words
from lodestar.runtime import cut, cut_in_place, release

K = 4
T = 0.7
STEPS = 2
#: Share of the pairs at a distance's Jaccard bound that its banding is to find.
FOUND = 0.95


def least_jaccard(distance: int) -> float:
    """What a containment of T means at least for sets so many partitions apart."""
    return T / (1 + 2 ** ((distance + 1) / STEPS) - T)


def bands_for(distance: int, rows: int) -> tuple[int, int]:
    return math.ceil(math.log(1 - FOUND) / math.log(1 - least_jaccard(distance) ** rows)), rows


#: (bands, rows) by distance of partitions; from len(BANDING) on, smaller sets ask by their samples.
BANDING = (bands_for(0, 3), bands_for(1, 2))
FUNCTIONS = max(b * r for b, r in BANDING)
#: Of so many functions, a set carries 4 bits each to the buckets: pairs that agree in too few aren't checked.
AGREE = 128
BRIEF = [f"s{i}" for i in range(AGREE // 16)]
SAMPLE = 24
#: Rounds in which components are compared with some hub of each bucket before members are.
HUBS = 4
#: Entries of one part of a packed shuffle, and shingles that a task holds before it writes them.
PART = 1 << 19
HELD = 3_000_000
#: Shingles of COMMON of about SAMPLED different texts count as common; which ones do decides on the cost, not on the result.
SAMPLED, COMMON = 8_000, 40
#: A set asks for all its shingles where more than this share of them is common.
WARM = 0.1
_HOT = 1 << 30
_SALTS = np.random.default_rng(7).integers(0, 1 << 32, (2, FUNCTIONS), dtype=np.uint32)


def needed(n: int) -> int:
    """How many of the sample of a set of ``n`` shingles a set that holds T of it has in 99 of 100 cases at least."""
    m, c = min(SAMPLE, n), math.ceil(n * T - 1e-9)
    miss, k = 0.0, 0
    while True:  # hypergeometric: k of the sample are among the c that both have
        miss += math.comb(c, k) * math.comb(n - c, m - k) / math.comb(n, m) if m - k <= n - c else 0
        if miss > 0.01 or k == m:
            return max(k, 1)
        k += 1


def agreeing(jaccard: float) -> int:
    """In how many of AGREE 4-bit values 999 of 1,000 pairs of this similarity agree at least."""
    p, total, k = jaccard + (1 - jaccard) / 16, 0.0, -1
    while total <= 0.001:
        k += 1
        total += math.comb(AGREE, k) * p**k * (1 - p) ** (AGREE - k)
    return k


#: By size, from 1 on; larger sets need what the last one needs.
NEEDED = [*(needed(n) for n in range(1, 200)), needed(100_000)]


def partition_of(n: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(n, 1))).astype(np.int8)


def sets_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles (64 bits, ascending) and their offsets, and two hashes of its word sequence."""
    data, off = text_bytes(col)
    _, _, h, at = words(lower(data), off)
    v, vat = distinct(*shingles(h, at, K))
    sums = []
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
    for salt in (1, 2):
        z = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h * np.uint64(2 * salt + 1) + mix64(place + np.uint64(salt << 40))), dtype=np.uint64)])
        sums.append(mix64(z[at[1:]] - z[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return v, vat, sums[0], sums[1]


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles (64 bits, ascending) that many texts of a sample have, of HELD shingles at most."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                v, at, t1, _ = sets_of(b.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array([v[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["id", "v"])

    def count(batches):
        sets, held = {}, 0
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                if i not in sets and held + len(v) // 8 <= HELD * 2:
                    sets[i] = v
                    held += len(v) // 8
        v, n = np.unique(np.frombuffer(b"".join(sets.values()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v[n >= COMMON])], ["key"])

    own = docs.filter("doc_id is not null")
    few = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SAMPLED))) == 0).select(F.col("text").cast("string").alias("text"))
    rows = few.mapInArrow(run, "id long, v binary").repartition(1).mapInArrow(count, "key long").collect()
    return np.sort(np.array([x.key for x in rows], np.int64).view(np.uint64))


def is_in(v: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``v`` are among the few values ``some``, which ascend."""
    out = np.zeros(len(v), bool)
    if len(some):
        head = np.zeros(1 << 16, bool)
        head[some >> np.uint64(48)] = True
        at = np.flatnonzero(head[v >> np.uint64(48)])
        out[at] = some[np.minimum(np.searchsorted(some, v[at]), len(some) - 1)] == v[at]
    return out


def per_set(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over sets, modulo 2^64."""
    z = np.concatenate([[x.dtype.type(0)], np.cumsum(x, dtype=x.dtype)])
    return z[at[1:]] - z[at[:-1]]


def least_shared(n: np.ndarray) -> np.ndarray:
    """T of so many shingles."""
    return np.ceil(n * T - 1e-9).astype(np.int64)


def signatures(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash signatures, a row for each set; sets must not be empty."""
    x = (v >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, FUNCTIONS), np.uint32)
    for i, (a, b) in enumerate(_SALTS.T):
        h = (x ^ a) * (b | np.uint32(1))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(h, at[:-1]) if len(h) else 0
    return out


def band_keys(sig: np.ndarray, part: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Bucket keys, a row for each set; their last bit is the banding, the one before says that all rows are of common shingles.

    Those of distance 0 are of one partition each. ``hot``: which values of ``sig`` are of common shingles.
    """
    out = []
    for d, (bands, rows) in enumerate(BANDING):
        for k in range(bands):
            key = np.full(len(sig), (d << 16 | k) + 1, np.uint64)
            if d == 0:
                key += part.astype(np.uint64) << np.uint64(32)
            for r in range(rows):
                key = mix64(key) + sig[:, k * rows + r]
            out.append(mix64(key) & ~np.uint64(3) | np.uint64(d) | hot[:, k * rows : (k + 1) * rows].all(1).astype(np.uint64) << np.uint64(1))
    return np.stack(out, 1)


def sketch(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """``(doc_id, id, t2, n, h, trace, part, bands, shingles, s0, ...)`` of every row that has an id and a word; ``id`` is a hash of its words.

    ``h`` and ``trace``: how many of its shingles are among ``hot``, and a hash of those. Sets with one
    trace that is T of each of them are copies, and share the last bucket.
    """

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                v, at, t1, t2 = sets_of(b.column("text"))
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                at = np.append(at[:-1][some], len(v))
                n = np.diff(at)
                part = partition_of(n)
                sig = signatures(v, at)
                own = is_in(v, hot)
                h = per_set(own.astype(np.int64), at)
                trace = per_set(np.where(own, mix64(v ^ np.uint64(0x5BD1E995)), np.uint64(0)), at)
                same = np.zeros(sig.shape, bool)
                some_h = np.flatnonzero(h)
                if len(some_h):
                    same[some_h] = signatures(v[own], np.concatenate([[0], np.cumsum(h[some_h])])) == sig[some_h]
                keys = band_keys(sig, part, same)
                last = mix64(np.where(h >= least_shared(n), trace, mix64(t1[some].view(np.uint64) + np.uint64(1))))
                keys = np.column_stack([keys, last & ~np.uint64(3) | np.uint64(2)])
                four = (sig[:, :AGREE] & np.uint32(15)).astype(np.uint8)
                brief = np.ascontiguousarray(four[:, ::2] | four[:, 1::2] << np.uint8(4)).view(np.int64)
                short = (v >> np.uint64(32)).astype(np.uint32)
                own = pa.array(some)
                cols = [b.column("doc_id").take(own), pa.array(t1[some]), pa.array(t2[some]), pa.array(n.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(trace.view(np.int64)), pa.array(part), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([short[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(c)) for c in brief.T)], ["doc_id", "id", "t2", "n", "h", "trace", "part", "bands", "shingles", *BRIEF])

    picked = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, id long, t2 long, n int, h int, trace long, part byte, bands binary, shingles binary, " + ", ".join(f"{c} long" for c in BRIEF))


def _by_part(part: np.ndarray, parts: int, *cols: np.ndarray):
    """The parts that occur and, for each column, the bytes of its entries in each."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(at))
    return some, [pa.array([y[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for y in (x[order] for x in cols)]


def _joined(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)


def _packed(names: str, *cols: np.ndarray) -> pa.Table:
    cuts = range(0, len(cols[0]), 1 << 16)
    return pa.table({c: pa.array([x[i : i + (1 << 16)].tobytes() for i in cuts], pa.binary()) for c, x in zip(names.split(), cols)})


def _unpacked(packed: DataFrame, schema: str, *kinds) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[i].as_py(), k)) for c, k in zip(names, kinds)], names)

    return packed.mapInArrow(run, schema)


def shared_buckets(s: DataFrame, total: int) -> DataFrame:
    """``(key, id, part)`` of the buckets in which two different sets of ``s`` are that may be as far apart as its banding says.

    Keys go to their part of the table packed, 17 bytes each, and are sorted there; ``total`` sets are expected.
    """
    width = sum(b for b, _ in BANDING) + 1
    parts = max(16, total * width // PART)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HELD // width):
                b = batch.slice(at, HELD // width)
                key = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint64)
                ids, part = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), width) for c in ("id", "part"))
                some, cols = _by_part(((key >> np.uint64(1)) % np.uint64(parts)).astype(np.int64), parts, key, ids, part)
                yield pa.RecordBatch.from_arrays([pa.array(some), *cols], ["at", "key", "id", "part"])

    def shared(t: pa.Table) -> pa.Table:
        key, ids, part = (_joined(t, *c) for c in (("key", np.uint64), ("id", np.int64), ("part", np.int8)))
        order = np.lexsort((ids, key))
        key, ids, part = key[order], ids[order], part[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
        key, ids, part = key[new], ids[new], part[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        apart = np.maximum.reduceat(part, first) - np.minimum.reduceat(part, first)
        use = np.repeat((count > 1) & ((key[first] & np.uint64(1) == 0) | (apart > 0)), count)
        return _packed("key id part", key[use].view(np.int64), ids[use], part[use])

    found = s.select("id", "part", "bands").mapInArrow(run, "at long, key binary, id binary, part binary").groupBy("at").applyInArrow(shared, "key binary, id binary, part binary")
    return _unpacked(cut(found), "key long, id long, part byte", np.int64, np.int64, np.int8)


def inverted(docs: DataFrame, total: int, hot: np.ndarray) -> DataFrame:
    """``(key, ref, part, more, id)`` of the shingles by which some set can find one that is len(BANDING) partitions larger or more.

    Sets with more than WARM of common shingles ask with all their shingles, for sets of their own partition or a larger one.
    Askers have in ``more`` how many such sets have the shingle, _HOT more if it is a common one, and in ``part`` the
    least partition they ask for; what they may find has 0 in ``more``.
    ``total`` shingles are expected. A task writes its sets in rounds, numbered by partition, so that a
    shingle takes 6 bytes: its distance from the one before, the set's number, and whether it is in the sample.
    """
    parts = max(16, total // PART)
    far = len(BANDING)
    listed = np.unique((hot >> np.uint64(24) << np.uint64(24)) + (hot & np.uint64(0xFFFFFF)) % np.uint64(parts))

    def packed(texts, sets):
        id_, first = np.unique(np.concatenate(texts), return_index=True)
        sets = [x for group in sets for x in group]
        n = np.array([len(sets[i]) for i in first])
        warm = per_set(is_in(np.concatenate([sets[i] for i in first]), hot).astype(np.int64), np.concatenate([[0], np.cumsum(n)])) > n * WARM
        kind = partition_of(n).astype(np.int64) | warm.astype(np.int64) << 6
        order = np.argsort(kind, kind="stable")
        id_, n, warm, sets = id_[order], n[order], warm[order], [sets[first[i]] for i in order]
        starts = np.searchsorted(kind[order], np.arange(128)).astype(np.uint16)
        round_ = int(np.bitwise_xor.reduce(mix64(id_.view(np.uint64) + np.arange(len(id_), dtype=np.uint64)))) >> 17
        v = np.concatenate(sets)
        who = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        ask = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(np.where(warm, n, SAMPLE), n)
        who |= ask.astype(np.uint16) << np.uint16(15)
        part = ((v & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((v, part))
        part, key, who = part[order], v[order] >> np.uint64(24), who[order]
        gap = np.diff(key, prepend=np.uint64(0))
        at = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(at))
        gap[at[some]] = key[at[some]]
        high = (gap >> np.uint64(32)).astype(np.uint8)
        cols = [pa.array([x[at[i] : at[i + 1]].tobytes() if x is not high or x[at[i] : at[i + 1]].any() else b"" for i in some], pa.binary()) for x in (gap.astype(np.uint32), high, who)]
        k = len(some)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([round_] * k), *cols, pa.array([starts.tobytes()] * k, pa.binary())], ["at", "round", "gap", "high", "who", "extra"])
        yield pa.RecordBatch.from_arrays([pa.array([parts + round_ % parts]), pa.array([round_]), *(pa.array([b""], pa.binary()) for _ in range(3)), pa.array([id_.tobytes()], pa.binary())], ["at", "round", "gap", "high", "who", "extra"])

    def run(batches):
        texts, sets, held = [], [], 0
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                v, at, t1, _ = sets_of(b.column("text"))
                some = np.flatnonzero(np.diff(at))
                for lo in range(0, len(some), 1 << 13):
                    part = some[lo : lo + (1 << 13)]
                    texts.append(t1[part])
                    sets.append([v[at[i] : at[i + 1]] for i in part])
                    held += sum(map(len, sets[-1]))
                    if held > HELD or sum(map(len, texts)) > 3 << 13:
                        yield from packed(texts, sets)
                        texts, sets, held = [], [], 0
        if texts:
            yield from packed(texts, sets)

    def shared(t: pa.Table) -> pa.Table:
        rounds = t.column("round").to_pylist()
        if t.column("at")[0].as_py() >= parts:  # the sets' ids
            ids = [np.frombuffer(x, np.int64) for x in t.column("extra").to_pylist()]
            ref = np.concatenate([(r << 15) + np.arange(len(x)) for r, x in zip(rounds, ids)])
            none = np.zeros(len(ref), np.int64)
            return _packed("key ref part more id", none, ref, np.full(len(ref), -1, np.int8), none.astype(np.int32), np.concatenate(ids))
        keys, refs, kinds, asks = [], [], [], []
        for r, gap, high, who, extra in zip(rounds, *(t.column(c).to_pylist() for c in ("gap", "high", "who", "extra"))):
            g = np.frombuffer(gap, np.uint32).astype(np.int64)
            g = g | np.frombuffer(high, np.uint8).astype(np.int64) << 32 if high else g
            w = np.frombuffer(who, np.uint16)
            keys.append(np.cumsum(g))
            asks.append(w >> 15 > 0)
            w = (w & 0x7FFF).astype(np.int64)
            refs.append((r << 15) + w)
            kinds.append(np.searchsorted(np.frombuffer(extra, np.uint16), w, "right").astype(np.int64) - 1)
        key, ref, kind, ask = (np.concatenate(x) for x in (keys, refs, kinds, asks))
        order = np.argsort(key << 7 | kind & 63, kind="stable")
        key, ref, kind, ask = key[order], ref[order], kind[order], ask[order]
        size, warm = kind & 63, kind >> 6
        goal = np.where(warm, size, size + far)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        seg = np.repeat(np.arange(len(first)), count)
        least = np.repeat(np.minimum.reduceat(np.where(ask, goal, 127), first), count)
        more = np.repeat(first + count, count) - np.searchsorted(seg << 7 | size, seg << 7 | goal) - warm
        out = [np.empty(0, np.int64)] * 2, [np.empty(0, np.int8)], [np.empty(0, np.int32)]
        asker, held = np.flatnonzero(ask & (more > 0)), np.flatnonzero(size >= least)
        whole = (key << 24) + t.column("at")[0].as_py()
        more += np.where(ask & is_in(whole.view(np.uint64), listed), _HOT, 0) * (more > 0)
        use = np.concatenate([asker, held])
        return _packed("key ref part more id", whole[use], ref[use], np.concatenate([goal[asker], size[held]]).astype(np.int8), np.concatenate([more[asker], np.zeros(len(held), np.int64)]).astype(np.int32), np.zeros(len(use), np.int64))

    picked = docs.filter("doc_id is not null").select(F.col("text").cast("string").alias("text"))
    found = picked.mapInArrow(run, "at long, round long, gap binary, high binary, who binary, extra binary").groupBy("at").applyInArrow(shared, "key binary, ref binary, part binary, more binary, id binary")
    return _unpacked(cut(found), "key long, ref long, part byte, more int, id long", np.int64, np.int64, np.int8, np.int32, np.int64)


def far_lists(docs: DataFrame, reps: DataFrame, total: int, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``(key, b, least, common)``, the shingles by which sets ask for others, and ``(key, a, above)`` of the sets that have these.

    A shingle is ``common`` here where it is one of ``hot`` and T of the asking set are, so that it has to ask with them.
    """
    listed = inverted(docs, total, hot)
    ids = listed.filter("part < 0").select("ref", "id").distinct()
    rows = cut(listed.filter("part >= 0").drop("id").join(ids, "ref").groupBy("key", "id", "part", F.col("more") > 0).agg(F.max("more").alias("more")).select("key", "id", "part", "more"))
    release(docs.sparkSession)
    warm = F.col("h") > F.col("n") * WARM
    need = F.when(warm, F.ceil(F.col("n") * T - 1e-9)).otherwise(F.try_element_at(F.array(*map(F.lit, NEEDED)), F.least(F.col("n"), F.lit(len(NEEDED)))))
    asks = rows.filter("more > 0").join(reps.select("id", "n", "h"), "id").withColumn("k", F.count(F.lit(1)).over(W.partitionBy("id"))).withColumn("need", need).filter("k >= need")
    asks = asks.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("more", "key"))).filter("rank <= k - need + 1")
    asks = cut(asks.select("key", F.col("id").alias("b"), F.col("part").alias("least"), ((F.col("more") >= _HOT) & warm).alias("common")))
    return asks, cut(rows.filter("more = 0").select("key", F.col("id").alias("a"), F.col("part").alias("above")).join(asks.select("key").distinct(), "key", "left_semi"))


def across(asks: DataFrame, held: DataFrame) -> DataFrame:
    """``asks (key, b, least, of)`` with the ``held (key, a, above, has)`` that they find in other groups, ``of`` and ``has``.

    All but those of the group that has a key most often look at the whole list, that group at the rest of it only.
    """
    most = held.groupBy("key", "has").count().groupBy("key").agg(F.max(F.struct("count", "has"))["has"].alias("most"))
    left, right = asks.join(most, "key"), held.join(most, "key")
    one = left.filter("of != most").drop("most").join(right.drop("most"), "key").filter("of != has and above >= least")
    return one.union(left.filter("of = most").drop("most").join(right.filter("has != most").drop("most"), "key").filter("above >= least").select(*one.columns))


def set_table(s: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, warm, shingles, s0, ...)`` of the sets of ``ids``, by id."""
    return cut_in_place(s.select("id", (F.col("h") > F.col("n") * WARM).alias("warm"), "shingles", *BRIEF).dropDuplicates(["id"]).join(ids.distinct(), "id", "left_semi").sortWithinPartitions("id"))


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the sizes of both sets and of what they share, where the smaller lies in the larger to T."""

    def run(batches):
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                b = batch.slice(p, 512)
                na, nb, both = [], [], []
                for xa, xb in zip(b.column("sa"), b.column("sb")):
                    x, y = np.frombuffer(xa.as_buffer(), np.uint32), np.frombuffer(xb.as_buffer(), np.uint32)
                    na.append(len(x))
                    nb.append(len(y))
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both.append(int((y[at] == x).sum()))
                out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(c, pa.int32()) for c in (na, nb, both))], ["a", "b", "na", "nb", "both"])
                yield out.filter(pa.array([m >= T * min(i, j) - 1e-9 for i, j, m in zip(na, nb, both)], pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, na int, nb int, both int")


def components(edges: DataFrame) -> DataFrame:
    """``(id, comp)`` of every end of an edge ``(a, b)``: the least id of its connected component.

    Each round links every node's neighbours to the least label about it and then halves the paths;
    rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    while True:
        # large star: neighbours above a node hang on the least node about it; small star: so do those below
        least = F.least(F.col("a"), F.min("b").over(W.partitionBy("a")))
        large = e.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a > b").distinct()
        m = F.min("b").over(W.partitionBy("a"))
        small = down.withColumn("m", m)
        star = small.select("a", F.col("m").alias("b")).union(small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        star = cut(star)
        tops = star.select(F.col("b").alias("a")).distinct().join(star.select("a"), "a", "left_semi")
        twice = star.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        if tops.isEmpty() and twice.isEmpty():
            return star.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(star.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
        e = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _mutual(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("both") >= F.lit(T) * F.greatest("na", "nb") - 1e-9)


def _merged(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components ``(id, comp)`` after the mutual ones of new edges."""
    e = _mutual(edges).select("a", "b")
    if comps is None:
        return cut(components(e))
    for c in ("a", "b"):
        e = e.join(comps.select(F.col("id").alias(c), F.col("comp").alias("now")), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
    up = components(e)
    all_ = comps.union(up.select("id", F.col("id").alias("comp")).join(comps, "id", "left_anti"))
    return cut(all_.join(up.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))


def _now(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows (key, comp, x)`` under the components of now, of the buckets that still hold two or more."""
    m = rows.join(comps.select(F.col("id").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("key", F.coalesce("now", "comp").alias("comp"), "x")
    some = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return m.join(some, "key", "left_semi")


def _may(key, above, below):
    """Whether a bucket's banding is for a pair of partitions."""
    return F.when(key.bitwiseAND(1) == 0, F.lit(True)).otherwise((above - below).between(1, len(BANDING)))


def _hub(members: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``, a above b: the top of some component of each bucket, that of the top member in turn 0, and of each other one."""
    heads = members.groupBy("key", "comp").agg(F.max("x").alias("x"))
    first = F.col("x") if turn == 0 else F.struct(F.xxhash64("comp", F.lit(turn)), "comp")
    hub = heads.groupBy("key").agg(F.max_by("x", first).alias("hub"))
    pair = heads.join(hub, "key").filter(F.col("hub") != F.col("x")).select("key", F.greatest("x", "hub").alias("x"), F.least("x", "hub").alias("y"))
    return pair.filter(_may(F.col("key"), F.col("x.part"), F.col("y.part"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _agree(key, one: list, two: list):
    """Whether two sets' 4-bit values agree as often as the bound of a bucket's banding asks."""
    same = F.lit(0)
    for a, b in zip(one, two):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        same = same + 16 - F.bit_count(x)
    return same >= F.when(key.bitwiseAND(1) == 0, F.lit(agreeing(least_jaccard(0)))).otherwise(F.lit(agreeing(least_jaccard(1))))


def _every(members: DataFrame, sets: DataFrame, lead: DataFrame) -> DataFrame:
    """``(a, b)``, a above b: each member of a bucket and each larger one there of another component, but for pairs that agree in too little.

    In buckets of common shingles alone only the sets ``lead (id)`` are compared: sets with more than WARM of these
    ask for what they lie in, and with less of them a pair meets by its other shingles.
    """
    m = members.select("key", "comp", "x", F.col("x.id").alias("id")).join(sets.select("id", "warm", *BRIEF), "id").join(lead.select("id", F.lit(True).alias("lead")), "id", "left")
    m = m.filter((F.col("key").bitwiseAND(2) == 0) | F.col("lead")).select("key", "comp", "x", "warm", *BRIEF)
    # of two components one is not the one with most members
    most = m.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("most"))
    left, right = m.join(most, "key").filter("comp != most").alias("l"), m.alias("r")
    over = F.col("l.x") > F.col("r.x")
    above, below = (F.when(over, F.struct(f"{i}.x", f"{i}.warm")).otherwise(F.struct(f"{j}.x", f"{j}.warm")) for i, j in ("lr", "rl"))
    asked = below["warm"] & (above["warm"] | (above["x"]["part"] > below["x"]["part"])) & (F.col("l.key").bitwiseAND(2) == 0)
    far = (F.col("l.comp") != F.col("r.comp")) & _may(F.col("l.key"), above["x"]["part"], below["x"]["part"]) & ~asked
    pair = left.join(right, (F.col("l.key") == F.col("r.key")) & far & _agree(F.col("l.key"), *([F.col(f"{side}.{c}") for c in BRIEF] for side in "lr")))
    return pair.select(above["x"]["id"].alias("a"), below["x"]["id"].alias("b")).distinct()


def tops(reps: DataFrame, comps: DataFrame) -> DataFrame:
    """``(id, top)``: the set to keep of the component of each."""
    head = reps.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("id", "comp", RANK().alias("x"))
    return cut(head.withColumn("top", F.max("x").over(W.partitionBy("comp"))).select("id", "top"))


def RANK():
    return F.struct("n", (-F.col("least")).alias("neg"), "id")


def linked(docs: DataFrame, sketches: list[DataFrame], reps: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Verified edges ``(a, b, na, nb, both)`` among ``reps``, and ``(id, top)``.

    The edges are all those between components of copies, but of sets that are alike in their common shingles, and so
    share as many with any set that only has common ones of theirs, the one with the highest top stands for the others.

    Takes the one table out of ``sketches``, so that its files can go as soon as they are not needed.
    """
    spark, s = docs.sparkSession, sketches.pop()
    sizes = reps.agg(F.count(F.lit(1)), F.sum("n")).first()
    asks, held = far_lists(docs, reps, sizes[1] or 0, hot)
    release(spark)  # the packed shingles
    buckets = cut(shared_buckets(s, sizes[0]))
    release(spark)
    bounds = asks.filter("not common").groupBy("key").agg(F.min("least").alias("lo")).join(held.groupBy("key").agg(F.max("above").alias("hi")), "key").filter("hi >= lo")
    ids = buckets.select("id").union(held.join(bounds, "key").filter("above >= lo").select("a")).union(asks.filter("not common").join(bounds, "key").filter("least <= hi").select("b"))
    # of one trace: the smallest set of which it is T, and the highest
    full = reps.filter(F.col("h") >= F.ceil(F.col("n") * T - 1e-9))
    small = cut(full.groupBy("trace").agg(F.min(F.struct("n", "id"))["id"].alias("id")).select("id"))
    ids = ids.union(full.select("id")).union(reps.filter("h > 0").groupBy("trace").agg(F.max(RANK())["id"].alias("id")).select("id"))
    sets, s = set_table(s, ids), None
    release(spark)  # the sketches
    # the top that most of a set's buckets have
    x = F.struct("part", "id")
    top = buckets.groupBy("key").agg(F.max(x).alias("top"))
    seen = buckets.join(top, "key").filter((F.col("id") != F.col("top.id")) & _may(F.col("key"), F.col("top.part"), F.col("part"))).groupBy("id", "top").agg(F.count(F.lit(1)).alias("c"))
    done = cut(seen.groupBy("id").agg(F.max(F.struct("c", "top"))["top"].alias("top")).select(F.col("top.id").alias("a"), F.col("id").alias("b")))
    edges = [cut(common(done, sets))]
    comps = _merged(None, edges[0])
    members = buckets.select("key", F.col("id").alias("comp"), x.alias("x"))
    for turn in range(HUBS):
        members = cut(_now(members, comps))
        release(spark)
        todo = cut(_hub(members, turn).join(done, ["a", "b"], "left_anti"))
        if todo.isEmpty():
            continue
        done = done.union(todo)
        edges.append(cut(common(todo, sets)))
        comps = _merged(comps, edges[-1])
        if _mutual(edges[-1]).count() < 0.1 * todo.count():
            break
    now = lambda x, c, name: x.join(comps.select(F.col("id").alias(c), F.col("comp").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    far = across(now(asks.filter("not common").drop("common"), "b", "of"), now(held, "a", "has")).select("a", "b", (F.col("above") == F.col("least")).alias("level"))
    # sets of one partition are told apart by id; others ask for larger ones
    swap = F.col("level") & (F.col("a") < F.col("b"))
    far = far.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    todo = cut(_every(_now(members, comps), sets, small).union(far).distinct().join(done, ["a", "b"], "left_anti"))
    members = buckets = None
    release(spark)
    edges.append(cut(common(todo, sets)))
    comps = _merged(comps, edges[-1])
    head = tops(reps, comps)
    # containment by common shingles alone, once for all sets of a trace
    now = reps.join(head, "id")
    large = now.filter("h > 0").groupBy("trace").agg(F.max(F.struct("top", RANK().alias("x"))).alias("m")).select(F.col("m.x.id").alias("a"), F.col("m.top").alias("ta"))
    small = now.join(full.select("id").distinct(), "id", "left_semi").groupBy("trace", "n", "top").agg(F.min("id").alias("b")).select("b", F.col("top").alias("tb"))
    some = asks.filter("common").drop("common").join(small, "b").withColumn("of", F.col("tb.id"))
    rest = across(some, held.join(some.select("key").distinct(), "key", "left_semi").join(large, "a").withColumn("has", F.col("ta.id"))).filter("ta > tb")
    edges.append(cut(common(rest.select("a", "b").distinct(), sets)))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out, head


def placed(docs: DataFrame) -> DataFrame:
    """``(doc_id, id, group_id, kept)`` of every document that is in a group of two or more; ``id`` stands for its words."""
    hot = common_shingles(docs)
    sketches = [cut(sketch(docs, hot))]
    exact = cut(sketches[0].select("doc_id", "id").distinct())
    reps = cut(sketches[0].groupBy("id", "t2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("h").alias("h"), F.first("trace").alias("trace")))
    edges, head = linked(docs, sketches, reps, hot)
    # a group whose member lies in a larger group's member joins the group it lies in most
    up = edges.select(F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("small"), F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("large"), (F.col("both") / F.least("na", "nb")).alias("share"))
    up = up.join(head.select(F.col("id").alias("small"), F.col("top").alias("ts")), "small").join(head.select(F.col("id").alias("large"), F.col("top").alias("tl")), "large").filter("tl > ts")
    up = cut(up.groupBy("ts").agg(F.max(F.struct("share", "tl")).alias("best")).select("ts", F.col("best.tl").alias("tl")))
    while True:  # follow to the root, twice as far each time
        nxt = cut(up.join(up.select(F.col("ts").alias("tl"), F.col("tl").alias("far")), "tl", "left").select("ts", F.coalesce("far", "tl").alias("tl")))
        moved = nxt.join(up, ["ts", "tl"], "left_anti").isEmpty()
        up = nxt
        if moved:
            break
    root = head.join(up.withColumnRenamed("ts", "top"), "top", "left").select("id", F.coalesce("tl", "top").alias("root"))
    every = exact.join(root, "id").select("doc_id", "id", (-F.col("root.neg")).alias("group_id"), F.col("root.id").alias("top"))
    w = W.partitionBy("top")
    return every.withColumn("size", F.count(F.lit(1)).over(w)).filter("size > 1").select("doc_id", "id", "group_id", ((F.col("doc_id") == F.col("group_id")) & (F.col("id") == F.col("top"))).alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, group_id, kept)`` of every document that is in a group of two or more.

    ``group_id`` is the id of the document to keep. Null ids, null texts and texts without a word are
    in no group; an empty table gives no rows. Texts have no greatest length. Rows of one id and the
    same words are one document; rows of one id and other words are documents of their own, so an id
    may come twice. Of equal sizes, the least id is kept. Columns other than doc_id and text aren't read.
    """
    return placed(docs).select("doc_id", "group_id", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that a group can spare; its columns may have any names.

    Where an id has several rows, those go whose own text is a copy, and of rows with the same words
    one stays. Rows of null ids, null texts or texts without a word stay.
    """
    found = cut(placed(docs))
    twice = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("doc_id")))
    gone = found.filter("not kept").select("doc_id")
    once = docs.join(gone.union(twice), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return once
    again = docs.join(twice, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def words_of(batches):
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                v, at, t1, _ = sets_of(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(t1, mask=np.diff(at) == 0)], ["row", "doc_id", "id"])

    from pyspark.sql.types import LongType, StructField, StructType

    known = again.mapInArrow(words_of, StructType([StructField("row", docs.schema), StructField("doc_id", LongType()), StructField("id", LongType())]))
    known = known.join(found.filter("not kept").select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    one = known.filter("id is not null").groupBy("doc_id", "id").agg(F.first("row").alias("row")).select("row")
    return once.union(one.union(known.filter("id is null").select("row")).select("row.*"))
