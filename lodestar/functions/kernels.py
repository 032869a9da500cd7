"""NumPy kernels: seeded generators, rotation, residual codes, Bloom filters."""

from __future__ import annotations

import math

import numpy as np

_M = (1 << 64) - 1


class Xorshift:
    """The xorshift64* generator; a state of 0 is replaced."""

    def __init__(self, seed: int):
        self.state = seed & _M or 0x9E3779B97F4A7C15

    def u64(self) -> int:
        x = self.state
        for shift in (-12, 25, -27):
            x ^= (x >> -shift) if shift < 0 else (x << shift) & _M
        self.state = x
        return x * 0x2545F4914F6CDD1D & _M

    def unit(self) -> float:
        return (self.u64() >> 11) / (1 << 53)

    def below(self, bound: int) -> int:
        """Uniform in [0, bound), by rejection; 0 for a bound of 0."""
        if not bound:
            return 0
        last = _M - _M % bound - 1
        while (v := self.u64()) > last:
            pass
        return v % bound

    def normal(self) -> float:
        u = max(self.unit(), 2.2250738585072014e-308)
        v = self.unit()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def rotation(dimension: int, seed: int) -> np.ndarray:
    """A seeded orthogonal matrix: normal entries drawn by column and made orthonormal, each column in turn."""
    rng = Xorshift(seed)
    m = np.array([rng.normal() for _ in range(dimension * dimension)], np.float32).reshape(dimension, dimension)
    for i in range(dimension):
        for j in range(i):
            m[i] -= np.float32(np.dot(m[i], m[j])) * m[j]
        norm = np.float32(np.sqrt(np.dot(m[i], m[i])))
        if norm <= 1e-6:
            raise ValueError("the rows drawn are dependent")
        m[i] /= norm
    return np.ascontiguousarray(m.T)


class ResidualCodes:
    """Codes of ``bits`` bits a dimension for residuals about a centroid, after a random rotation.

    A unit residual is replaced by the grid point that has the largest cosine with it. Along the ray
    from the origin each coordinate's magnitude grows by one at known places; the sums that make the
    cosine are cumulative over those places in order, so the best state is an argmax.
    """

    def __init__(self, dimension: int, bits: int, seed: int):
        if dimension <= 0 or not 1 <= bits <= 8:
            raise ValueError("a dimension of 1 or more and 1 to 8 bits")
        self.dimension, self.bits = dimension, bits
        self.offset = np.float32(((1 << bits) - 1) / 2)
        self.matrix = rotation(dimension, seed)

    def turned(self, x: np.ndarray) -> np.ndarray:
        """The inverse rotation of row vectors."""
        return x.astype(np.float32) @ self.matrix

    def encode(self, vectors: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, grid norms, cosines and distances to the centroid (one row, or one for each vector)."""
        r = vectors.astype(np.float32) - centroid.astype(np.float32)
        distance = np.sqrt((r * r).sum(1, dtype=np.float32))
        zero = distance <= np.finfo(np.float32).tiny
        o = self.turned(r / np.where(zero, np.float32(1), distance)[:, None])
        codes = np.empty((len(o), self.dimension), np.uint8)
        norm, cosine = np.empty(len(o), np.float32), np.empty(len(o), np.float32)
        steps = (1 << (self.bits - 1)) - 1
        width = max(1, (1 << 20) // max(1, self.dimension * max(1, steps)))
        for at in range(0, len(o), width):
            part = o[at : at + width]
            m = self._magnitudes(np.abs(part), steps)
            inner, square = (m * np.abs(part)).sum(1), (m * m).sum(1)
            norm[at : at + width] = np.sqrt(square)
            cosine[at : at + width] = inner / np.sqrt(square)
            codes[at : at + width] = np.floor(np.where(part < 0, -m, m) + self.offset + np.float32(0.5))
        codes[zero], norm[zero], cosine[zero] = ((1 << self.bits) - 1) // 2, 1, 1
        return codes, norm, cosine, np.where(zero, np.float32(0), distance)

    def _magnitudes(self, a: np.ndarray, steps: int) -> np.ndarray:
        n, d = a.shape
        half = np.full((n, d), 0.5, np.float32)
        if not steps:
            return half
        k = np.arange(1, steps + 1, dtype=np.float32)
        with np.errstate(divide="ignore"):
            t = (k[None, None, :] / a[:, :, None]).reshape(n, -1)
        order = np.argsort(t, axis=1, kind="stable")  # by place, then dimension, then step
        ends = np.isinf(np.take_along_axis(t, order, 1))
        gain = np.repeat(a, steps, axis=1)
        square = np.tile(2 * (k - np.float32(0.5)) + 1, d)[None]
        inner = np.cumsum(np.concatenate([(a * np.float32(0.5)).sum(1, keepdims=True), np.take_along_axis(gain, order, 1)], 1), axis=1, dtype=np.float32)
        norm = np.cumsum(np.concatenate([np.full((n, 1), 0.25 * d, np.float32), np.take_along_axis(np.broadcast_to(square, t.shape), order, 1)], 1), axis=1, dtype=np.float32)
        goal = inner / np.sqrt(norm)
        goal[:, 1:][ends] = -np.inf
        best = goal.argmax(1)
        taken = np.zeros((n, d * steps), bool)
        np.put_along_axis(taken, order, np.arange(d * steps)[None] < best[:, None], 1)
        return half + taken.reshape(n, d, steps).sum(2).astype(np.float32)

    def prepare(self, queries: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated unit residuals of queries, their sums and lengths; a zero residual stays zero."""
        r = queries.astype(np.float32) - centroid.astype(np.float32)
        length = np.sqrt((r * r).sum(1, dtype=np.float32))
        q = self.turned(r / np.where(length <= np.finfo(np.float32).tiny, np.float32(np.inf), length)[:, None])
        return q, q.sum(1), length

    def estimate(self, codes, norm, cosine, distance, prepared) -> np.ndarray:
        """Estimated squared distances, queries by codes; never negative."""
        q, total, length = prepared
        dot = q @ codes.astype(np.float32).T
        safe = np.where(np.abs(cosine) < np.finfo(np.float32).tiny, np.float32(np.inf), cosine)
        inner = (dot - self.offset * total[:, None]) / norm[None] / safe[None]
        d = distance[None] ** 2 + length[:, None] ** 2 - 2 * distance[None] * length[:, None] * inner
        return np.maximum(d, 0)

    def error_bound(self) -> float:
        return 2.0**-self.bits * 5.75 / math.sqrt(self.dimension)


def fnv_mix(data: bytes) -> int:
    """64-bit FNV-1a and a finaliser."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & _M
    for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, None):
        h ^= h >> 33
        h = h * mult & _M if mult else h
    return h


class Bloom:
    """A Bloom filter by double hashing: two 32-bit halves of one hash, the second made odd."""

    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    @classmethod
    def sized(cls, n: int, p: float) -> "Bloom":
        n = max(1, n)
        bits = max(8, -(-math.ceil(-n * math.log(p) / math.log(2) ** 2) // 8) * 8)
        return cls(bits, min(30, max(1, round(bits / n * math.log(2)))))

    def places(self, keys: list[bytes]) -> np.ndarray:
        h = np.array([fnv_mix(k) for k in keys], np.uint64)
        one, two = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        i = np.arange(self.hashes, dtype=np.uint32)
        return (one[:, None] + i[None] * two[:, None]) % np.uint32(self.bits)

    def add(self, keys: list[bytes]) -> "Bloom":
        if keys:
            at = self.places(keys).ravel()
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return self

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = self.places(keys)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    def fill(self) -> float:
        return float(np.unpackbits(self.data).mean())

    def encode(self) -> bytes:
        return np.array([self.bits, self.hashes], "<u4").tobytes() + self.data.tobytes()

    @classmethod
    def decode(cls, raw: bytes) -> "Bloom":
        if len(raw) < 8:
            raise ValueError("no header")
        bits, hashes = (int(x) for x in np.frombuffer(raw[:8], "<u4"))
        if not bits or bits % 8 or not 1 <= hashes <= 30 or len(raw) != 8 + bits // 8:
            raise ValueError("not a filter")
        return cls(bits, hashes, np.frombuffer(raw[8:], np.uint8).copy())
