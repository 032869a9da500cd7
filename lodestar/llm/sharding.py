"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Runs of similar size, those of one tier
(sizes within a factor ``FANOUT``), are merged as soon as there are ``FANOUT`` of them, into files
of about ``TARGET_BYTES``; merged files join higher tiers and may be merged again until no tier is
due. Which files are live is said by a manifest alone: version n + 1 is written whole beside
version n and appears by an atomic rename that fails if the version exists.

A merge is a task that reads its run's files and writes one file, without a shuffle: each text is
moved between files once a round. A task that runs again replaces its file with the same one.
"""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from lodestar.sources.files import commit_json, names, open_fs, read_json
from lodestar.llm.textutil import unused
from lodestar.runtime import scratch

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Sizes up to this are of tier 0.
FLOOR_BYTES = 1 << 20


def tier(size: int, *, floor: int = FLOOR_BYTES, fanout: int = FANOUT) -> int:
    """0 for up to ``floor`` bytes, then one more for each factor ``fanout``."""
    t = 0
    while size > floor:
        floor, t = floor * fanout, t + 1
    return t


def plan(files: list[dict], *, target: int = TARGET_BYTES, fanout: int = FANOUT, floor: int = FLOOR_BYTES) -> list[list[str]]:
    """The merges that are due: for each tier below the target with ``fanout`` files or more, its
    files in order of age, packed into groups of up to ``target`` bytes; a group of one isn't merged."""
    tiers: dict[int, list[dict]] = {}
    for f in files:
        if f["bytes"] < target / 2:
            tiers.setdefault(tier(f["bytes"], floor=floor, fanout=fanout), []).append(f)
    out = []
    for t in sorted(tiers):
        runs = sorted(tiers[t], key=lambda f: (f["version"], f["file"]))
        if len(runs) < fanout:
            continue
        group, total = [], 0
        for f in runs:
            if group and total + f["bytes"] > target:
                out.append(group)
                group, total = [], 0
            group.append(f["file"])
            total += f["bytes"]
        out.append(group)
    return [g for g in out if len(g) > 1]


class ShardStore:
    """A folder of immutable shards and versioned manifests."""

    def __init__(self, spark, folder: str, *, target: int = TARGET_BYTES, fanout: int = FANOUT, floor: int = FLOOR_BYTES):
        self.spark, self.folder, self.target, self.fanout, self.floor = spark, folder.rstrip("/"), target, fanout, floor

    def version(self) -> int:
        """The latest committed version, 0 if there is none."""
        found = [int(n[9:-5]) for n, _ in names(f"{self.folder}/manifest") if n.startswith("manifest-") and n.endswith(".json")]
        return max(found, default=0)

    def files(self, version: int | None = None) -> list[dict]:
        v = self.version() if version is None else version
        return read_json(f"{self.folder}/manifest/manifest-{v:010d}.json")["files"] if v else []

    def _commit(self, base: int, files: list[dict]) -> int:
        files = sorted(files, key=lambda f: f["file"])
        commit_json(self.spark, f"{self.folder}/manifest", f"manifest-{base + 1:010d}.json", {"version": base + 1, "files": files})
        return base + 1

    def append(self, rows: DataFrame) -> int:
        """Write an arrival's partitions as shards of their own and commit them, on whatever version is the latest by then."""
        sub = f"data/arrival-{self.version() + 1:010d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{sub}")
        new = [(f"{sub}/{n}", size) for n, size in names(f"{self.folder}/{sub}") if n.endswith(".parquet")]
        return self._replace(set(), new)

    def _replace(self, gone: set[str], new: list[tuple[str, int]]) -> int:
        """Commit ``new`` in place of ``gone``; where another writer was faster, again on its version."""
        while True:
            base = self.version()
            files = self.files(base)
            if not gone <= {f["file"] for f in files}:
                raise RuntimeError("another writer has merged the same shards")
            try:
                return self._commit(base, [f for f in files if f["file"] not in gone] + [{"file": n, "bytes": size, "version": base + 1} for n, size in new])
            except Exception:
                if self.version() <= base:
                    raise

    def compact_once(self) -> bool:
        """Run the merges that are due, as one job, and commit; False if none is."""
        base = self.version()
        files = self.files(base)
        groups = plan(files, target=self.target, fanout=self.fanout, floor=self.floor)
        if not groups:
            return False
        folder, sub = self.folder, f"data/merge-{base + 1:010d}-{uuid.uuid4().hex[:8]}"

        def merge(batches):
            system, root = open_fs(folder)
            system.create_dir(f"{root}/{sub}", recursive=True)
            for batch in batches:
                for name, members in zip(batch.column("name").to_pylist(), batch.column("members").to_pylist()):
                    own = f"{root}/{sub}/.{name}.{uuid.uuid4().hex}"
                    out = None
                    for m in members:
                        with pq.ParquetFile(system.open_input_file(f"{root}/{m}")) as f:
                            out = out or pq.ParquetWriter(own, f.schema_arrow, filesystem=system, compression="zstd")
                            for rows in f.iter_batches(8192):
                                out.write_batch(rows.cast(out.schema), row_group_size=None)
                    out.close()
                    system.move(own, f"{root}/{sub}/{name}")
                    yield pa.RecordBatch.from_arrays([pa.array([f"{sub}/{name}"]), pa.array([system.get_file_info(f"{root}/{sub}/{name}").size], pa.int64())], ["file", "bytes"])

        todo = self.spark.createDataFrame([(f"run-{k:06d}.parquet", g) for k, g in enumerate(groups)], "name string, members array<string>").repartition(len(groups), "name")
        new = [(r["file"], r["bytes"]) for r in todo.mapInArrow(merge, "file string, bytes long").collect()]  # a row a file
        self._replace({m for g in groups for m in g}, new)
        return True

    def compact(self) -> int:
        while self.compact_once():
            pass
        return self.version()

    def vacuum(self, older_than: float = 7 * 86400, versions: int = 1) -> int:
        """Delete shards that none of the latest ``versions`` manifests names and that are ``older_than`` seconds old.

        Older versions can't be read after it. The age spares what others have written and not committed yet.
        """
        latest, before = self.version(), time.time() - older_than
        live = {f["file"] for v in range(max(1, latest - versions + 1), latest + 1) for f in self.files(v)}
        system, root = open_fs(self.folder)
        from pyarrow.fs import FileSelector

        gone = [i.path for i in system.get_file_info(FileSelector(f"{root}/data", recursive=True, allow_not_found=True)) if i.is_file and i.path.endswith(".parquet") and i.mtime.timestamp() <= before and i.path[len(root) + 1 :] not in live]
        for p in gone:
            system.delete_file(p)
        return len(gone)

    def read(self, version: int | None = None, shard: str = "_shard") -> DataFrame | None:
        """The rows of a version, with the shard of each in the column ``shard``, which takes more
        underscores if there is such a column; None if it has no files."""
        files = self.files(version)
        if not files:
            return None
        df = self.spark.read.parquet(*(f"{self.folder}/{f['file']}" for f in files))
        return df.withColumn(unused(df.columns, shard), F.concat_ws("/", F.slice(F.split(F.input_file_name(), "/"), -2, 2)))


def shard(docs: DataFrame, *, target: int = TARGET_BYTES, fanout: int = FANOUT, floor: int = FLOOR_BYTES) -> DataFrame:
    """Append ``docs`` as arrivals, compact, commit; ``(doc_id, source, n_chars, shard, version)`` of every row.

    Each partition of ``docs`` arrives as one small shard. All columns are stored, whatever their
    names, nulls, repeated rows and texts of any length included; an empty table gives no rows. Empty
    partitions leave no shard behind. Shards of one size are merged in the order of their age and names.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch(spark, "shards"), target=target, fanout=fanout, floor=floor)
    store.append(docs)
    version = store.compact()
    store.vacuum(0)  # no one else writes here
    live, at = store.read(), unused(docs.columns, "_shard")
    if live is None:
        live = docs.limit(0).withColumn(at, F.lit(""))
    return live.select("doc_id", "source", "n_chars", F.col(at).alias("shard"), F.lit(version).cast("int").alias("version"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)
