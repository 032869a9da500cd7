"""Quality rules: a hashed word and character n-gram logistic regression with calibrated probabilities.

Features are hashed into 2**BITS slots: words, pairs of neighbouring words (a word followed by
itself is one feature, whatever the word), runs of 3 bytes, and runs of 4, 6 and 8 bytes at word
starts. For quality each family's counts are divided by its total, since junk is a matter of
shares; for toxicity by the square root of it, since a few words decide and chance hits then weigh
the same at every length. One set of features serves two heads, trained on
the labels ``quality`` and ``toxic``: L-BFGS on three quarters of the sample, then Platt scaling on
the rest, split by text so that copies don't fall on both sides. A document is kept if the
probability of quality is at least KEEP_QUALITY and that of toxicity below REJECT_TOXIC.

The labelled sample is bounded by ``sample`` rows, those whose id hashes lowest; scoring has no
bound, covers whole texts and runs in Arrow batches with one pass over the bytes.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.textutil import lower, mix64, pieces, text_bytes, words
from lodestar.runtime import table

BITS = 18
SAMPLE = 6000
#: Bytes of text that the sample has at most; rows beyond it, in the order of the hash, aren't trained on.
SAMPLE_BYTES = 128 << 20
KEEP_QUALITY = 0.5
REJECT_TOXIC = 0.5
#: Penalties; the second is on weights of slots scaled to their usual value, the first on plain ones.
L2 = (1e-7, 1e-4)
SCALED = (False, True)
#: Slots that fewer training rows have are left out.
LEAST_ROWS = 2
_SALT = np.array([0x51ED270B, 0x2545F491, 0x9E3779B9, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)
_STARTS = (4, 6, 8)
#: A family's counts are divided by this power of its total, for quality and toxicity.
POWERS = (1.0, 0.5)


def _slots(h: np.ndarray, family: int) -> np.ndarray:
    h = (h ^ _SALT[family]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def families(col: pa.Array):
    """For each family in turn the slots of all features, and each text's offsets among them."""
    data, off = text_bytes(col)
    low = lower(data)
    start, end, h, at = words(low, off)
    yield _slots(h, 0), at
    if len(h):
        same = h[1:] == h[:-1]
        pair = np.where(same, np.uint64(7), h[:-1] * np.uint64(3) + h[1:] * np.uint64(5))
        ends = at[1:][np.diff(at) > 0]
        inside = np.ones(len(h), bool)
        inside[ends - 1] = False
        keep = inside[:-1]
        yield _slots(mix64(pair[keep]), 1), np.concatenate([[0], np.cumsum(inside)])[at]
    else:
        yield np.empty(0, np.int32), np.zeros(len(off), np.int64)
    n = len(data)
    if n < 3:
        yield np.empty(0, np.int32), np.zeros(len(off), np.int64)
    else:
        gram = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
        inside = np.ones(n - 2, bool)
        size = np.diff(off)
        for back in (1, 2):  # these would reach into the next text
            at_end = off[1:][size >= back] - back
            inside[at_end[at_end < n - 2]] = False
        yield _slots(gram[inside], 2), np.concatenate([[0], np.cumsum(inside), [inside.sum()] * 2])[off]
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    head, done = np.zeros(len(start), np.uint64), 0
    for k, width in enumerate(_STARTS):
        for j in range(done, width):
            head |= np.where(start + j < end, padded[start + j], 0).astype(np.uint64) << np.uint64(8 * j)
        done = width
        yield _slots(mix64(head), 3 + k), at


def margins(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Per text and head the weighted sum of features; ``weights`` is slots by heads."""
    out = np.zeros((len(col), weights.shape[1]))
    for slots, at in families(col):
        n = np.diff(at)
        some = n > 0
        if not some.any():
            continue
        for k in range(weights.shape[1]):
            out[some, k] += np.add.reduceat(weights[:, k][slots].astype(np.float64), at[:-1][some]) / n[some] ** POWERS[k]
    return out


class Rows:
    """The features of the labelled rows as a sparse matrix, in blocks of 200 rows, 8 bytes an entry.

    A block holds slots, rows, families and counts (in 4 bytes where 2 are too few), and each row's totals by family.
    """

    def __init__(self, texts: list[str]):
        self.n, self.blocks = len(texts), []
        self.df = np.zeros(1 << BITS, np.int32)
        for lo in range(0, len(texts), 200):
            part = pa.array(texts[lo : lo + 200], pa.string())
            found, totals = [], []
            for family, (s, at) in enumerate(families(part)):
                n = np.diff(at)
                key = np.repeat(np.arange(len(part), dtype=np.int64), n) << BITS | s
                u, c = np.unique(key, return_counts=True)
                found.append(((u & ((1 << BITS) - 1)).astype(np.int32), (u >> BITS).astype(np.uint8), np.full(len(u), family, np.uint8), c.astype(np.uint16 if not len(c) or c.max() < 1 << 16 else np.uint32)))
                totals.append(np.maximum(n, 1).astype(np.float32))
            block = [np.concatenate(x) for x in zip(*found)]
            self.df += np.bincount(block[0], minlength=1 << BITS).astype(np.int32)
            self.blocks.append((lo, len(part), np.stack(totals), *block))
        keep = self.df >= LEAST_ROWS
        for k, (lo, n, totals, *block) in enumerate(self.blocks):  # one at a time, so that the memory isn't needed twice
            some = keep[block[0]]
            self.blocks[k] = (lo, n, totals, *(x[some] for x in block))

    def of(self, power: float, scaled: bool, y: np.ndarray, use: np.ndarray) -> "Rows":
        """Set values for one head: counts over totals to ``power``. If ``scaled``, a slot's usual value where
        it occurs becomes, in training, how many deviations its share of positive rows (of those that
        ``use`` marks) is off the share of all: a penalty then weighs on chance more than on evidence."""
        self.power = power
        self.scale = np.where(self.df >= LEAST_ROWS, 1.0, 0.0)
        if not scaled:
            return self
        square = np.zeros(1 << BITS)
        for block in self.blocks:
            square += np.bincount(block[3], self._values(block) ** 2, 1 << BITS)
        self.scale = np.where(square > 0, 1 / np.sqrt(np.maximum(square, 1e-30) / np.maximum(self.df, 1)), 0)
        share = y[use].mean()
        seen, positive = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for lo, n, _, slots, rows, _, _ in self.blocks:
            w = use[lo : lo + n].astype(np.float32)
            seen += np.bincount(slots, w[rows], 1 << BITS)
            positive += np.bincount(slots, (w * y[lo : lo + n])[rows], 1 << BITS)
        self.scale *= np.abs(positive - share * seen) / np.sqrt(share * (1 - share) * seen + 1)
        return self

    def _values(self, block) -> np.ndarray:
        _, _, totals, _, rows, family, counts = block
        return counts / (totals**self.power)[family, rows]

    def dot(self, w: np.ndarray) -> np.ndarray:
        w = (w * self.scale).astype(np.float32)
        return np.concatenate([np.bincount(b[4], self._values(b) * w[b[3]], b[1]) for b in self.blocks]) if self.blocks else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        out, g = np.zeros(1 << BITS), g.astype(np.float32)
        for b in self.blocks:
            out += np.bincount(b[3], self._values(b) * g[b[0] : b[0] + b[1]][b[4]], 1 << BITS)
        return out * self.scale


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(x: Rows, y: np.ndarray, use: np.ndarray, *, l2: float = L2[1], steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept by L-BFGS; ``use`` marks the rows that count."""
    m = max(1, int(use.sum()))

    def loss(p):
        z = x.dot(p[:-1]) + p[-1]
        g = np.where(use, _sigmoid(z) - y, 0.0) / m
        value = np.sum(np.where(use, np.logaddexp(0, z) - y * z, 0.0)) / m + 0.5 * l2 * np.dot(p[:-1], p[:-1])
        return value, np.append(x.back(g) + l2 * p[:-1], g.sum())

    p = np.zeros((1 << BITS) + 1)
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, d in reversed(past):
            a = s @ q / (s @ d)
            alphas.append(a)
            q -= a * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.abs(g).max())
        for (s, d), a in zip(past, reversed(alphas)):
            q += s * (a - d @ q / (s @ d))
        slope, t = g @ q, 1.0
        if slope <= 1e-14:
            break
        while True:
            f2, g2 = loss(p - t * q)
            if f2 <= f - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        step, change = -t * q, g2 - g
        if step @ change > 1e-16:
            past = [*past[-7:], (step, change)]
        done = f - f2 < 1e-7 * max(1e-3, f)
        p, f, g = p - t * q, f2, g2
        if done:
            break
    return (p[:-1] * x.scale).astype(np.float32), float(p[-1])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, b`` such that sigmoid(a z + b) is calibrated, by Newton's method with Platt's smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = np.sum((p - target) * z), np.sum(p - target)
        haa, hab, hbb = np.sum(w * z * z) + 1e-3, np.sum(w * z), np.sum(w) + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        limit = max(1.0, abs(da) / 2, abs(db) / 2)
        a, b = a - da / limit, b - db / limit
        if abs(da) + abs(db) < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def train(rows: list[tuple[str, int, int]]) -> dict:
    """A model from ``(text, quality, toxic)`` rows. A head whose rows are all of one class, or that
    has none, gives that class's smoothed share to every text."""
    texts = [t or "" for t, _, _ in rows]
    held = np.array([hashlib.md5(t.encode("utf-8", "replace")).digest()[0] % 4 == 0 for t in texts], bool)
    x = Rows(texts)
    heads = []
    for k in (1, 2):
        y = np.array([r[k] for r in rows], float)
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            share = (y.sum() + 1) / (len(y) + 2)
            heads.append((np.zeros(1 << BITS, np.float32), 0.0, float(np.log(share / (1 - share)))))
            continue
        w, b = fit(x.of(POWERS[k - 1], SCALED[k - 1], y, ~held), y, ~held, l2=L2[k - 1])
        z = x.dot(np.divide(w, x.scale, out=np.zeros(1 << BITS), where=x.scale > 0)) + b
        a, c = platt(z[held], y[held])
        heads.append((w, a, a * b + c))
    return {"weights": np.stack([h[0] for h in heads], 1), "scale": [h[1] for h in heads], "shift": [h[2] for h in heads]}


def probabilities(col: pa.Array, model: dict) -> np.ndarray:
    return _sigmoid(margins(col, model["weights"]) * model["scale"] + model["shift"])


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Up to ``sample`` labelled rows with their texts, those of lowest id hash; null labels don't count."""
    picked = labels.filter("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_x"))
    picked = picked.orderBy(F.md5(F.col("_id").cast("string")), "_q", "_x").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # of ``sample`` rows at most
    return got.select("_id", "text", "_q", "_x").orderBy(F.md5(F.col("_id").cast("string")), "text", "_q", "_x").limit(sample)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int, int]]:
    """labelled_rows() as ``(text, quality, toxic)``."""
    return [(r[1], int(r[2] > 0), int(r[3] > 0)) for r in labelled_rows(docs, labels, sample).collect()]


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> dict:
    """train() on the labelled sample, of ``most`` bytes at most, as one task; the driver gets the weights alone."""

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for t, q, x in zip(*(b.column(c) for c in ("text", "_q", "_x"))):
                held += len(t.as_buffer()) if t.is_valid else 0
                if held <= most:
                    rows.append((t.as_py(), int(q.as_py() > 0), int(x.as_py() > 0)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    out = labelled_rows(docs, labels, sample).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(out[0][0]) if out else train([])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``_p_quality`` and ``_p_toxic``. A null text, or one without a word, has quality 0 and toxicity 0."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                p = probabilities(b.column("text"), m)
                data, off = text_bytes(b.column("text"))
                blank = np.diff(words(data, off)[3]) == 0
                p[blank] = 0
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], [*b.schema.names, "_p_quality", "_p_toxic"])

    schema = StructType([*docs.schema.fields, StructField("_p_quality", DoubleType()), StructField("_p_toxic", DoubleType())])
    return docs.mapInArrow(run, schema)


def kept(scored: DataFrame) -> DataFrame:
    return scored.filter((F.col("_p_quality") >= KEEP_QUALITY) & (F.col("_p_toxic") < REJECT_TOXIC))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    A null or empty text, or one without a word, is not kept; rows that repeat stay or go together. Texts
    are scored whole. Without labels every text has an even chance in both heads, and none is kept.
    """
    shared = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                p = probabilities(b.column("text"), shared.value)
                blank = np.diff(words(*text_bytes(b.column("text")))[3]) == 0
                yield b.filter(pa.array((p[:, 0] >= KEEP_QUALITY) & (p[:, 1] < REJECT_TOXIC) & ~blank))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, p_quality, p_toxic)`` of the documents that the rules keep."""
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return kept(score(docs.select("doc_id", "text"), model)).select("doc_id", F.col("_p_quality").alias("p_quality"), F.col("_p_toxic").alias("p_toxic"))
