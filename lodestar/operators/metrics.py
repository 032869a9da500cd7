"""Measures: percentiles, amplification, level statistics, memory, correlation, cost models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RESULT_COLUMNS = [
    "workload", "growth", "merge", "key_count", "value_bytes", "operations", "throughput_kops", "mean_put_us", "p50_put_us", "p99_put_us", "p999_put_us",
    "mean_get_us", "p50_get_us", "p99_get_us", "mean_scan_us", "p50_scan_us", "p99_scan_us", "write_amplification", "tree_write_amplification",
    "space_amplification", "blocks_per_get", "blocks_per_scan", "levels", "runs", "files", "disk_bytes", "live_bytes",
]


def percentiles(rows: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group, exact; null where a group has no values."""
    return rows.groupBy(*by).agg(*(F.expr(f"percentile_disc({p}) within group (order by {value})").alias(n) for n, p in points.items()))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A ratio in double precision, null where there is nothing to divide by."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def level_stats(files: DataFrame) -> DataFrame:
    """Per level of ``files (level, run, file, bytes, entries, min_key, max_key)``: runs, files, bytes, entries, key span."""
    return files.groupBy("level").agg(
        F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
        F.sum("entries").alias("entries"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"),
    )


def overlapping(files: DataFrame, low: Column, high: Column) -> DataFrame:
    """Files whose key range meets [low, high]; those without a range don't."""
    return files.filter((F.col("min_key") <= high) & (low <= F.col("max_key")))


def packed_code_bytes(dimension: Column, bits: Column) -> Column:
    return F.ceil(dimension * bits / 8).cast("bigint")


def index_bytes(dimension: Column, bits: Column, vectors: Column, clusters: Column) -> Column:
    """Bytes of packed codes and of single-precision centroids."""
    return packed_code_bytes(dimension, bits) * vectors + clusters * dimension * 4


def error_bound(bits: Column, dimension: Column) -> Column:
    """The empirical bound on the error of an estimated inner product of unit vectors."""
    return F.pow(F.lit(2.0), -bits) * 5.75 / F.sqrt(dimension.cast("double"))


def query_speed(main_runs: Column, long_range: float = 0.3, false_positives: float = 0.01) -> Column:
    cost = (main_runs + 2.0) * long_range + (1.0 - long_range) * (1.0 + false_positives)
    return F.when(cost > 0, 1.0 / cost).otherwise(0.0)


def bloom_size(n: Column, p: Column) -> tuple[Column, Column]:
    """Bits, in whole bytes, and hashes of a filter for ``n`` keys at false-positive rate ``p``."""
    bits = F.greatest(F.ceil(F.ceil(-n * F.log(p) / F.lit(0.6931471805599453**2)) / 8) * 8, F.lit(8)).cast("bigint")
    hashes = F.least(F.greatest(F.round(bits / n * 0.6931471805599453), F.lit(1)), F.lit(30)).cast("int")
    return bits, hashes


def write_results_csv(results: DataFrame, path: str) -> None:
    """The result table, one row a run; what wasn't measured is an empty cell, never 0."""
    have = set(results.columns)
    results.select(*(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in RESULT_COLUMNS)).write.option("nullValue", "").option("emptyValue", "").csv(path, header=True)
