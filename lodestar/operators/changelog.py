"""Change logs: newest-wins views, reads, merges of runs, replay, placement of large values.

A log has a key, an order (``seq`` columns, later wins), ``is_tombstone`` and values. A tombstone is a
row like any other until the newest row of a key has been chosen, and only then dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def newest(log: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last row of every key, tombstones included; combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row"))
    return best.select(*key, *(F.col("_row")[c].alias(c) for c in rest)).select(*log.columns)


def live(log: DataFrame, key: list[str], seq: list[str], tombstone: str = "is_tombstone") -> DataFrame:
    return newest(log, key, seq).filter(~F.col(tombstone))


def merge_runs(runs: list[DataFrame], key: list[str], drop_tombstones: bool = False, tombstone: str = "is_tombstone") -> DataFrame:
    """Runs in order of age, newest first, as one: a key's row comes from the newest run that has it."""
    out = None
    for age, run in enumerate(runs):
        tagged = run.withColumn("_age", F.lit(-age))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    merged = newest(out, key, ["_age"]).drop("_age")
    return merged.filter(~F.col(tombstone)) if drop_tombstones else merged


def get(log: DataFrame, keys: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """Point reads of many keys: the log is cut to them before versions are compared."""
    return live(log.join(keys.select(*key).distinct(), key, "left_semi"), key, seq)


def scan_from(log: DataFrame, key: str, start, n: int, seq: list[str]) -> DataFrame:
    """The first ``n`` live rows at or after ``start``, in key order; the bound reaches the files."""
    return live(log.filter(F.col(key) >= F.lit(start)), [key], seq).orderBy(key).limit(n)


def scan_between(log: DataFrame, key: str, low, high, seq: list[str]) -> DataFrame:
    return live(log.filter(F.col(key).between(low, high)), [key], seq)


def replay(records: DataFrame, seq: str, sound: str) -> DataFrame:
    """The records before the first that isn't sound: what a reader of an append-only log may trust."""
    first_bad = records.filter(~F.col(sound)).agg(F.min(seq).alias("_bad"))
    return records.crossJoin(F.broadcast(first_bad)).filter(F.col("_bad").isNull() | (F.col(seq) < F.col("_bad"))).drop("_bad")  # one row


def split_values(rows: DataFrame, value: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows with values below ``threshold`` bytes in place and a pointer for the rest, and the table of the rest.

    The pointer is the hash of the value's bytes, so the table can be rebuilt and holds a value once.
    """
    size = F.octet_length(value)
    pointer = F.sha2(F.col(value).cast("binary"), 256)
    far = size >= threshold
    inline = rows.withColumn("pointer", F.when(far, pointer)).withColumn("length", size).withColumn(value, F.when(~far, F.col(value)))
    values = rows.filter(far).select(pointer.alias("pointer"), F.col(value).alias("far_value")).dropDuplicates(["pointer"])
    return inline, values


def resolve_values(inline: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """The rows of split_values() put together again; a pointer without its value, or of another length, is an error."""
    pointed = inline.filter(F.col("pointer").isNotNull()).join(values, "pointer", "left")
    whole = F.when(F.octet_length("far_value") == F.col("length"), F.col("far_value")).otherwise(F.raise_error(F.lit("value log: no such value")))
    far = pointed.withColumn(value, whole).drop("far_value", "pointer", "length")
    return inline.filter(F.col("pointer").isNull()).drop("pointer", "length").unionByName(far)  # they would all meet in one task of a join


def deduplicated_by_age(rows: DataFrame, key: list[str], age: str) -> DataFrame:
    """As newest(), by a window: for use inside a pipeline that is partitioned by key already."""
    w = W.partitionBy(*key).orderBy(F.desc(age))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
