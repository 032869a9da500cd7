import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import intervals as iv
from lodestar.functions.distance import finite, inner_product, squared_l2, unit_direction
from lodestar.functions.kernels import Bloom, ResidualCodes, Xorshift, fnv_mix, rotation
from lodestar.operators.workload import Keys, Workload


def test_generator_golden():
    r = Xorshift(42)
    assert [r.u64() for _ in range(3)] == [6255019084209693600, 14430073426741505498, 14575455857230217846]
    r = Xorshift(0)
    assert [r.u64() for _ in range(2)] == [973819730272012410, 6108091081255984487]
    r = Xorshift(42)
    assert (r.unit(), r.unit()) == (0.33908526400192196, 0.7822558479199243)
    assert [r.below(10) for _ in range(5)] == [6, 5, 8, 5, 2] and r.below(0) == 0


def test_zipf_golden():
    r, k = Xorshift(42), Keys("zipfian", 1000)
    assert [k.next(r) for _ in range(12)] == [6, 193, 205, 657, 168, 290, 2, 13, 4, 84, 12, 6]
    k = Keys("sequential", 3)
    assert [k.next(r) for _ in range(4)] == [0, 1, 2, 0]


def test_workload_is_deterministic(spark):
    w = Workload(keys=50, gets=0.3, scans=0.2, deletes=0.1)
    assert list(w.operations(200)) == list(w.operations(200))
    assert w.rows(spark, 200).select("kind").distinct().count() == 4


def test_rotation_golden():
    m = rotation(3, 7)
    want = [[0.26339632, 0.7967186, -0.54393184], [0.8389434, 0.089169264, 0.53686374], [0.47623137, -0.59773606, -0.6449149]]
    assert np.allclose(m.T, want, atol=1e-5) and np.allclose(m @ m.T, np.eye(3), atol=1e-5)


@pytest.mark.parametrize("bits,codes,norm,cosine,estimate", [(1, [0, 1, 0, 1], 1.0, 0.86278003, 4.9573483), (2, [0, 2, 0, 2], 2.236068, 0.99247843, 5.0501313), (4, [0, 10, 1, 9], 10.34408, 0.99969435, 5.633539), (8, [45, 153, 59, 143], 111.305885, 0.9999997, 5.812554)])
def test_codes_golden(bits, codes, norm, cosine, estimate):
    c, x, zero = ResidualCodes(4, bits, 7), np.array([[0.5, -1, 2, 0.25]], np.float32), np.zeros((1, 4), np.float32)
    got = c.encode(x, zero)
    assert got[0][0].tolist() == codes and np.allclose([got[1][0], got[2][0], got[3][0]], [norm, cosine, 2.304886], rtol=1e-5)
    assert np.allclose(c.estimate(*got, c.prepare(np.ones((1, 4), np.float32), zero)), estimate, rtol=1e-4)


def test_best_grid_point_is_best():
    rng = np.random.default_rng(3)
    c = ResidualCodes(3, 2, 1)
    o = np.abs(rng.normal(size=(50, 3))).astype(np.float32)
    got = c._magnitudes(o, 1)
    grid = np.array(np.meshgrid(*[[0.5, 1.5]] * 3)).reshape(3, -1).T
    best = ((o @ grid.T) / np.sqrt((grid * grid).sum(1))).max(1)
    assert np.allclose((got * o).sum(1) / np.sqrt((got * got).sum(1)), best, rtol=1e-6)


def test_error_falls_with_bits_and_zero_residual():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 32)).astype(np.float32), rng.normal(size=(20, 32)).astype(np.float32)
    centre = np.zeros((1, 32), np.float32)
    true = ((q[:, None] - x[None]) ** 2).sum(-1)
    errors = []
    for bits in (1, 3, 5, 8):
        c = ResidualCodes(32, bits, 5)
        est = c.estimate(*c.encode(x, centre), c.prepare(q, centre))
        errors.append(np.abs(est - true).mean())
        scale = 2 * np.linalg.norm(x, axis=1)[None] * np.linalg.norm(q, axis=1)[:, None]
        assert (np.abs(est - true) / scale < c.error_bound()).mean() > 0.99
    assert errors == sorted(errors, reverse=True)
    codes, norm, cosine, distance = ResidualCodes(32, 4, 5).encode(centre, centre)
    assert set(codes[0]) == {7} and (norm[0], cosine[0], distance[0]) == (1, 1, 0)


def test_bloom():
    assert fnv_mix(b"a") == 0x82A2A958A9BECE5B
    b = Bloom.sized(1000, 0.01)
    assert (b.bits, b.hashes) == (9592, 7)
    have, other = ([i.to_bytes(8, "big") for i in range(k, 4000, 2)][:1000] for k in (0, 1))
    b.add(have)
    assert b.may_contain(have).all() and b.may_contain(other).mean() < 0.03 and 0.4 < b.fill() < 0.6
    assert (Bloom.decode(b.encode()).data == b.data).all()
    for raw in (b"", b"12345678", b.encode()[:-1]):
        with pytest.raises(ValueError):
            Bloom.decode(raw)


def test_crc_is_the_usual_one(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 0xCBF43926 == zlib.crc32(b"123456789")


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(squared_l2(F.col("a"), F.col("b")), inner_product(F.col("a"), F.col("b")), unit_direction(F.col("a"), F.col("a")), finite(F.col("a"))).first()
    assert tuple(r) == (25.0, 0.0, None, True)
    with pytest.raises(Exception, match="different lengths"):
        df.select(squared_l2(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_intervals_against_definition(spark):
    """Closed forms against the pointwise condition, for random triangles and 101 weights."""
    rng = random.Random(7)
    rows = [(i, *(rng.random() for _ in range(6))) for i in range(60)]
    t = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double")
    s = lambda x, y: F.struct(F.col(x).alias("e"), F.col(y).alias("s"))
    sides = s("a", "b"), s("c", "d"), s("e", "f")
    p = t.select("id", *(x.alias(n) for x, n in zip(sides, ("xy", "xz", "yz")))).withColumn("set", iv.pruned_by(F.col("xy"), F.col("xz"), F.col("yz")))
    p = p.crossJoin(spark.range(101).select(((F.col("id") + 0.5) / 101).alias("alpha")))
    wrong = p.filter(iv.contains(F.col("set"), F.col("alpha")) != iv.prunes_at(F.col("alpha"), F.col("xy"), F.col("xz"), F.col("yz")))
    assert wrong.count() == 0


def test_interval_algebra(spark):
    def of(*pieces):
        return F.concat(*(iv.interval(F.lit(a), F.lit(b)) for a, b in pieces)) if pieces else iv.empty()

    def got(c):
        return [tuple(p) for p in spark.range(1).select(c.alias("x")).first().x]

    a, b = of((0.1, 0.3), (0.3, 0.4), (0.7, 0.9)), of((0.2, 0.8))
    assert got(iv.normalise(a)) == [(0.1, 0.4), (0.7, 0.9)]
    assert got(iv.union(a, b)) == [(0.1, 0.9)]
    assert got(iv.intersect(iv.normalise(a), b)) == [(0.2, 0.4), (0.7, 0.8)]
    assert got(iv.complement(iv.normalise(a))) == [(0.0, 0.1), (0.4, 0.7), (0.9, 1.0)]
    assert got(iv.complement(of())) == [(0.0, 1.0)] and got(iv.complement(iv.full())) == []
    row = ((1.0, 1.0), (0.5, 1.0), (0.5, 0.5))
    x = [F.struct(F.lit(e).alias("e"), F.lit(s).alias("s")) for e, s in row]
    assert len(got(iv.pruned_by(*x))) <= 1
