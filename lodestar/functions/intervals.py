"""Sets of weights in [0, 1] as sorted disjoint closed intervals: ``array<struct<lo double, hi double>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TYPE = "array<struct<lo:double,hi:double>>"


def empty() -> Column:
    return F.array().cast(TYPE)


def interval(lo: Column, hi: Column) -> Column:
    """[lo, hi] cut to [0, 1]; empty if nothing is left."""
    a, b = F.greatest(lo.cast("double"), F.lit(0.0)), F.least(hi.cast("double"), F.lit(1.0))
    return F.when(a <= b, F.array(F.struct(a.alias("lo"), b.alias("hi")))).otherwise(empty())


def full() -> Column:
    return interval(F.lit(0.0), F.lit(1.0))


def normalise(pieces: Column) -> Column:
    """Sort pieces and join those that overlap or touch."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["lo"] <= last["hi"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(pieces), empty(), step)


def union(a: Column, b: Column) -> Column:
    return normalise(F.concat(a, b))


def intersect(a: Column, b: Column) -> Column:
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi")))))
    return normalise(F.filter(both, lambda p: p["lo"] <= p["hi"]))


def complement(a: Column) -> Column:
    """What [0, 1] has beyond ``a``, as closed intervals of positive length."""
    starts = F.concat(F.array(F.lit(0.0)), F.transform(a, lambda p: p["hi"]))
    ends = F.concat(F.transform(a, lambda p: p["lo"]), F.array(F.lit(1.0)))
    gaps = F.zip_with(starts, ends, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return F.filter(gaps, lambda p: p["lo"] < p["hi"])


def measure(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, p: acc + (p["hi"] - p["lo"]))


def contains(a: Column, alpha: Column) -> Column:
    return F.exists(a, lambda p: (p["lo"] <= alpha) & (alpha <= p["hi"]))


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def is_full(a: Column) -> Column:
    return F.exists(a, lambda p: (p["lo"] <= 0.0) & (p["hi"] >= 1.0))


def solve(a: Column, b: Column) -> Column:
    """The weights alpha in [0, 1] at which a * alpha is less than b, as a closed set."""
    ratio = b / F.nullif(a, F.lit(0.0))
    return (
        F.when((b > 0) & (a > 0), interval(F.lit(0.0), F.least(ratio, F.lit(1.0))))
        .when(b > 0, full())
        .when((b < 0) & (a < 0) & (ratio < 1), interval(ratio, F.lit(1.0)))
        .when((b == 0) & (a < 0), full())
        .otherwise(empty())
    )


def pruned_by(xy: Column, xz: Column, yz: Column) -> Column:
    """Where both other sides of a triangle are shorter than xy; arguments are structs of e and s."""
    side = lambda other: solve(other["e"] - xy["e"] + xy["s"] - other["s"], xy["s"] - other["s"])
    return intersect(side(xz), side(yz))


def prunes_at(alpha: Column, xy: Column, xz: Column, yz: Column) -> Column:
    at = lambda d: d["s"] + alpha * (d["e"] - d["s"])
    return (at(xz) < at(xy)) & (at(yz) < at(xy))


def dominates(a: Column, b: Column) -> Column:
    return (a["e"] <= b["e"]) & (a["s"] <= b["s"]) & ((a["e"] < b["e"]) | (a["s"] < b["s"]))
