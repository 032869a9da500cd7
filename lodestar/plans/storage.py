"""Queries over change logs, values and files, with their SQL twins.

``events`` is the change log: key ``user_id``, order ``(ts, event_id)``, a row of type ``error`` a tombstone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import changelog as cl, metrics
from lodestar.runtime import table

SEQ = ["ts", "event_id"]


def _log(spark, sf):
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("is_tombstone"))


def _runs(spark, sf):
    """The log as five runs by age, each deduplicated."""
    e = _log(spark, sf)
    return [cl.newest(e.filter(F.col("event_id") % 5 == r), ["user_id"], SEQ) for r in range(5)]


def latest_by_key(spark, sf):
    return cl.newest(_log(spark, sf), ["user_id"], SEQ).select("user_id", "event_id", "value", "is_tombstone")


def tombstone_drop(spark, sf):
    return cl.live(_log(spark, sf), ["user_id"], SEQ).select("user_id", "event_id", "value")


def point_get(spark, sf):
    keys = spark.range(0, 40).select((F.col("id") * 3).alias("user_id"))
    return cl.get(_log(spark, sf), keys, ["user_id"], SEQ).select("user_id", "event_id", "value")


def range_scan_limit(spark, sf):
    return cl.scan_from(_log(spark, sf), "user_id", 20, 15, SEQ).select("user_id", "event_id")


def range_scan_between(spark, sf):
    return cl.scan_between(_log(spark, sf), "user_id", 10, 60, SEQ).select("user_id", "event_id")


def full_scan(spark, sf):
    return cl.live(_log(spark, sf), ["user_id"], SEQ).orderBy("user_id").select("user_id", "value")


def run_merge_newest_wins(spark, sf):
    return cl.merge_runs(_runs(spark, sf), ["user_id"]).select("user_id", "event_id", "is_tombstone")


def compaction_drop_tombstones(spark, sf):
    return cl.merge_runs(_runs(spark, sf), ["user_id"], drop_tombstones=True).select("user_id", "event_id")


def deleted_then_revived(spark, sf):
    e = _log(spark, sf)
    dead = e.filter("is_tombstone").select("user_id").distinct()
    return cl.live(e, ["user_id"], SEQ).join(dead, "user_id", "left_semi").select("user_id", "event_id")


def _files(spark, sf):
    """Files of runs of levels: events by id hashed into levels, cut by ranges of the key."""
    e = _log(spark, sf).withColumn("level", (F.col("event_id") % 3).cast("int")).withColumn("run", (F.floor(F.col("event_id") / 3) % 2).cast("int")).withColumn("file", F.floor(F.col("user_id") / 25).cast("int"))
    return e.groupBy("level", "run", "file").agg((F.count(F.lit(1)) * 40).alias("bytes"), F.count(F.lit(1)).alias("entries"), F.min("user_id").alias("min_key"), F.max("user_id").alias("max_key"))


def level_stats(spark, sf):
    return metrics.level_stats(_files(spark, sf))


def files_overlapping_span(spark, sf):
    return metrics.overlapping(_files(spark, sf), F.lit(30), F.lit(70)).select("level", "run", "file")


def run_overlap(spark, sf):
    f = _files(spark, sf).groupBy("level", "run").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    a, b = f.alias("a"), f.alias("b")
    meets = (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    later = (F.col("b.level") > F.col("a.level")) | ((F.col("b.level") == F.col("a.level")) & (F.col("b.run") > F.col("a.run")))
    return a.join(b, meets & later).select(F.col("a.level").alias("level_a"), F.col("a.run").alias("run_a"), F.col("b.level").alias("level_b"), F.col("b.run").alias("run_b"))


def compaction_targets(spark, sf):
    """Source files of level 0 with the files of level 1 that a merge must read."""
    f = _files(spark, sf)
    a, b = f.filter("level = 0").alias("a"), f.filter("level = 1").alias("b")
    return a.join(b, (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key"))).select(F.col("a.run").alias("source_run"), F.col("a.file").alias("source_file"), F.col("b.run").alias("target_run"), F.col("b.file").alias("target_file"))


def is_deepest_level(spark, sf):
    f = _files(spark, sf).filter("level < 3")
    deepest = f.agg(F.max("level").alias("deepest"))
    return f.select("level").distinct().crossJoin(F.broadcast(deepest)).select("level", (F.col("level") >= F.col("deepest")).alias("is_deepest"))


def newest_runs_by_units(spark, sf):
    from pyspark.sql import Window as W

    runs = _log(spark, sf).groupBy((F.col("event_id") % 7).cast("int").alias("run")).agg((F.count(F.lit(1)) % 3 + 1).alias("units"))
    total = F.sum("units").over(W.partitionBy(F.lit(0)).orderBy("run"))
    return runs.withColumn("upto", total).filter("upto <= 8").select("run", "units", "upto")


def memtable_bytes(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.sum(F.lit(24) + 8 + F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def live_bytes(spark, sf):
    c = cl.live(_log(spark, sf).join(table(spark, sf, "events").select("event_id", "props"), "event_id"), ["user_id"], SEQ)
    return c.agg(F.sum(F.lit(8) + F.octet_length("props")).cast("bigint").alias("live_bytes"), F.count(F.lit(1)).alias("n"))


def value_split_resolve(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    inline, values = cl.split_values(d, "text", 2000)
    return cl.resolve_values(inline, values, "text").select("doc_id", F.md5("text").alias("h"))


def value_split_stats(spark, sf):
    inline, values = cl.split_values(table(spark, sf, "documents").select("doc_id", "text"), "text", 2000)
    tree = inline.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(12))).cast("bigint").alias("tree_bytes"), F.count("pointer").alias("pointers"))
    log = values.agg(F.sum(F.octet_length("far_value")).cast("bigint").alias("log_bytes"), F.count(F.lit(1)).alias("stored_values"))
    return tree.crossJoin(log)


def write_amplification(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.lit(8) + F.octet_length("props")).alias("bytes"))
    user = e.agg(F.sum("bytes").cast("bigint").alias("user_bytes"))
    flushed = cl.newest(e.withColumn("run", F.floor(F.col("event_id") / 500)), ["run", "user_id"], SEQ).agg(F.sum("bytes").cast("bigint").alias("flush_bytes"))
    merged = cl.newest(e, ["user_id"], SEQ).agg(F.sum("bytes").cast("bigint").alias("merge_bytes"))
    a = user.crossJoin(flushed).crossJoin(merged)
    return a.select("user_bytes", "flush_bytes", "merge_bytes", F.round(metrics.ratio(F.col("flush_bytes") + F.col("merge_bytes"), F.col("user_bytes")), 9).alias("write_amplification"))


def space_amplification(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.lit(8) + F.octet_length("props")).alias("bytes"))
    disk = e.agg(F.sum("bytes").cast("bigint").alias("disk_bytes"))
    kept = cl.newest(e, ["user_id"], SEQ).agg(F.sum("bytes").cast("bigint").alias("live"))
    return disk.crossJoin(kept).select(F.round(metrics.ratio(F.col("disk_bytes"), F.col("live")), 9).alias("space_amplification"))


def latency_percentiles(spark, sf):
    return metrics.percentiles(table(spark, sf, "events"), "value", ["event_type"], {"p50": 0.5, "p99": 0.99, "p999": 0.999})


def mean_latency(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("mean"))


def throughput_wa_corr(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


def zeta_constant(spark, sf):
    return spark.range(1, 1001).agg(F.round(F.sum(F.pow(F.col("id").cast("double"), F.lit(-0.99))), 9).alias("zeta"))


def op_mix_thresholds(spark, sf):
    from pyspark.sql import Window as W

    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    one = W.partitionBy(F.lit(0))
    upto = F.sum("n").over(one.orderBy("event_type").rowsBetween(W.unboundedPreceding, W.currentRow))
    return n.select("event_type", F.round(upto / F.sum("n").over(one), 9).alias("threshold"))


def bloom_sizing(spark, sf):
    g = spark.range(1, 8).select(F.pow(F.lit(10.0), F.col("id")).cast("bigint").alias("n")).crossJoin(spark.range(1, 5).select(F.pow(F.lit(10.0), -F.col("id")).alias("p")))
    bits, hashes = metrics.bloom_size(F.col("n"), F.col("p"))
    return g.select("n", F.round("p", 6).alias("p"), bits.alias("bits"), hashes.alias("hashes"))


def query_speed_model(spark, sf):
    q = metrics.query_speed(F.col("id"))
    return spark.range(0, 20).select("id", F.round(q, 12).alias("speed"), F.round(q * 0.5, 12).alias("merging_speed"))


def wal_prefix_replay(spark, sf):
    e = _log(spark, sf).withColumn("sound", F.col("event_id") != 700)
    return cl.replay(e, "event_id", "sound").select("event_id", "user_id")


def table_filenames(spark, sf):
    f = _files(spark, sf)
    return f.select(F.format_string("L%02d-R%010d-P%04d.sst", "level", "run", "file").alias("name"), "entries")


def orphan_sweep(spark, sf):
    f = _files(spark, sf).select(F.format_string("L%02d-R%010d-P%04d.sst", "level", "run", "file").alias("name"), "level")
    return f.select("name").join(f.filter("level <> 2").select("name"), "name", "left_anti")


def conversation_range(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("conv_id").between(3, 9))
    return c.select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("bytes"))


def sorted_run_bounds(spark, sf):
    """Entries and key bounds of eight sorted runs of lineitem, by ranges of the order key."""
    li = table(spark, sf, "lineitem").withColumn("run", (F.col("l_orderkey") % 8).cast("int"))
    return li.groupBy("run").agg(F.count(F.lit(1)).alias("entries"), F.min("l_orderkey").alias("min_key"), F.max("l_orderkey").alias("max_key"))


def crc32_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


NAMES = [
    latest_by_key, tombstone_drop, point_get, range_scan_limit, range_scan_between, full_scan, run_merge_newest_wins, compaction_drop_tombstones, deleted_then_revived,
    level_stats, files_overlapping_span, run_overlap, compaction_targets, is_deepest_level, newest_runs_by_units, memtable_bytes, live_bytes, value_split_resolve,
    value_split_stats, write_amplification, space_amplification, latency_percentiles, mean_latency, throughput_wa_corr, zeta_constant, op_mix_thresholds, bloom_sizing,
    query_speed_model, wal_prefix_replay, table_filenames, orphan_sweep, conversation_range, sorted_run_bounds, crc32_text,
]
QUERIES = {f.__name__: f for f in NAMES}

_L = "l as (select user_id, ts, event_id, value, event_type = 'error' as is_tombstone from events), n as (select * from l qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"
_RUNS = "l as (select user_id, ts, event_id, event_type = 'error' as is_tombstone, event_id % 5 as run from events), r as (select * from l qualify row_number() over (partition by run, user_id order by ts desc, event_id desc) = 1), m as (select * from r qualify row_number() over (partition by user_id order by run) = 1)"
_FILES = "f as (select (event_id % 3)::integer as level, ((event_id // 3) % 2)::integer as run, (user_id // 25)::integer as file, count(*) * 40 as bytes, count(*) as entries, min(user_id) as min_key, max(user_id) as max_key from events group by all)"
_B = "b as (select user_id, ts, event_id, 8 + strlen(props) as bytes from events)"
_NAME = "format('L{:02d}-R{:010d}-P{:04d}.sst', level, run, file)"

ORACLES = {
    "latest_by_key": f"with {_L} select user_id, event_id, value, is_tombstone from n",
    "tombstone_drop": f"with {_L} select user_id, event_id, value from n where not is_tombstone",
    "point_get": f"with {_L} select user_id, event_id, value from n where not is_tombstone and user_id % 3 = 0 and user_id between 0 and 117",
    "range_scan_limit": f"with {_L} select user_id, event_id from n where not is_tombstone and user_id >= 20 order by user_id limit 15",
    "range_scan_between": f"with {_L} select user_id, event_id from n where not is_tombstone and user_id between 10 and 60",
    "full_scan": f"with {_L} select user_id, value from n where not is_tombstone",
    "run_merge_newest_wins": f"with {_RUNS} select user_id, event_id, is_tombstone from m",
    "compaction_drop_tombstones": f"with {_RUNS} select user_id, event_id from m where not is_tombstone",
    "deleted_then_revived": f"with {_L} select user_id, event_id from n where not is_tombstone and user_id in (select user_id from l where is_tombstone)",
    "level_stats": f"with {_FILES} select level, count(distinct run) as runs, count(*) as files, sum(bytes)::bigint as bytes, sum(entries)::bigint as entries, min(min_key) as min_key, max(max_key) as max_key from f group by level",
    "files_overlapping_span": f"with {_FILES} select level, run, file from f where min_key <= 70 and max_key >= 30",
    "run_overlap": f"with {_FILES}, r as (select level, run, min(min_key) as lo, max(max_key) as hi from f group by level, run) select a.level as level_a, a.run as run_a, b.level as level_b, b.run as run_b from r a join r b on a.lo <= b.hi and b.lo <= a.hi and (b.level > a.level or (b.level = a.level and b.run > a.run))",
    "compaction_targets": f"with {_FILES} select a.run as source_run, a.file as source_file, b.run as target_run, b.file as target_file from f a join f b on a.level = 0 and b.level = 1 and a.min_key <= b.max_key and b.min_key <= a.max_key",
    "is_deepest_level": f"with {_FILES} select distinct level, level >= (select max(level) from f) as is_deepest from f",
    "newest_runs_by_units": "with r as (select (event_id % 7)::integer as run, count(*) % 3 + 1 as units from events group by 1), u as (select run, units, (sum(units) over (order by run))::bigint as upto from r) select * from u where upto <= 8",
    "memtable_bytes": "select sum(32 + coalesce(strlen(text), 0))::bigint as bytes, count(*) as entries from documents",
    "live_bytes": f"with {_L} select sum(8 + strlen(props))::bigint as live_bytes, count(*) as n from n join (select event_id, props from events) using (event_id) where not is_tombstone",
    "value_split_resolve": "select doc_id, md5(text) as h from documents",
    "value_split_stats": "select sum(case when strlen(text) >= 2000 then 12 else strlen(text) end)::bigint as tree_bytes, count(*) filter (strlen(text) >= 2000) as pointers, (select sum(strlen(text))::bigint from (select distinct text from documents where strlen(text) >= 2000)) as log_bytes, (select count(distinct text) from documents where strlen(text) >= 2000) as stored_values from documents",
    "write_amplification": f"with {_B}, u as (select sum(bytes)::bigint as user_bytes from b), fl as (select sum(bytes)::bigint as flush_bytes from (select bytes from b qualify row_number() over (partition by event_id // 500, user_id order by ts desc, event_id desc) = 1)), m as (select sum(bytes)::bigint as merge_bytes from (select bytes from b qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)) select *, round((flush_bytes + merge_bytes)::double / user_bytes, 9) as write_amplification from u, fl, m",
    "space_amplification": f"with {_B} select round((select sum(bytes) from b)::double / (select sum(bytes) from (select bytes from b qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)), 9) as space_amplification",
    "latency_percentiles": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.99) as p99, quantile_disc(value, 0.999) as p999 from events group by event_type",
    "mean_latency": "select event_type, round(avg(value), 9) as mean from events group by event_type",
    "throughput_wa_corr": "select round(corr(l_quantity, l_extendedprice), 9) as r from lineitem",
    "zeta_constant": "select round(sum(pow(i::double, -0.99)), 9) as zeta from range(1, 1001) t(i)",
    "op_mix_thresholds": "with n as (select event_type, count(*) as n from events group by 1) select event_type, round(sum(n) over (order by event_type) / (select sum(n) from n), 9) as threshold from n",
    "bloom_sizing": "with g as (select pow(10.0, i)::bigint as n, pow(10.0, -j) as p from range(1, 8) a(i), range(1, 5) b(j)), s as (select n, p, greatest(8, ceil(ceil(-n * ln(p) / pow(0.6931471805599453, 2)) / 8) * 8)::bigint as bits from g) select n, round(p, 6) as p, bits, least(30, greatest(1, round(bits / n * 0.6931471805599453)))::integer as hashes from s",
    "query_speed_model": "select i as id, round(1.0::double / ((i + 2.0::double) * 0.3::double + (1.0::double - 0.3::double) * 1.01::double), 12) as speed, round(0.5::double / ((i + 2.0::double) * 0.3::double + (1.0::double - 0.3::double) * 1.01::double), 12) as merging_speed from range(20) t(i)",
    "wal_prefix_replay": "select event_id, user_id from events where event_id < 700",
    "table_filenames": f"with {_FILES} select {_NAME} as name, entries from f",
    "orphan_sweep": f"with {_FILES} select {_NAME} as name from f where level = 2",
    "conversation_range": "select conv_id, turn, strlen(text) as bytes from conversations where conv_id between 3 and 9",
    "sorted_run_bounds": "select (l_orderkey % 8)::integer as run, count(*) as entries, min(l_orderkey) as min_key, max(l_orderkey) as max_key from lineitem group by 1",
}
