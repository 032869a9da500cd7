"""A keyed, versioned store on sorted Parquet runs, and a vector store on top of it.

Every write appends a run; a manifest, written whole and renamed into place, says which files are
live. Reads take the newest row of a key. Merges are planned by lodestar.operators.planners on the
shape that the manifest records and carried out as Spark jobs.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.functions.distance import finite
from lodestar.operators import changelog as cl, knn
from lodestar.operators.ivf import IvfConfig, IvfIndex
from lodestar.operators.planners import File, GrowthScheme, Leveling, MergePolicy, Run, Tree, Vertical
from lodestar.sources.files import commit_json, names, open_fs, read_json


@dataclass
class StoreConfig:
    growth: GrowthScheme = field(default_factory=lambda: Vertical(4 << 20, 10))
    merge: MergePolicy = field(default_factory=Leveling)
    file_bytes: int = 8 << 20
    max_compactions: int = 64
    #: Values of so many bytes and more are kept beside the tree; 0: none are.
    value_threshold: int = 0


class KeyedStore:
    """``key`` columns may be of any type that Parquet orders as Spark does: numbers, strings, bytes.

    One writer at a time: of two that commit the same version one fails. Opening a store changes nothing;
    files that no manifest needs any more are deleted by ``sweep`` alone.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "key", config: StoreConfig | None = None):
        self.spark, self.folder, self.key, self.config = spark, folder.rstrip("/"), key, config or StoreConfig()

    # -- manifest -------------------------------------------------------------------------------
    def version(self) -> int:
        return max((int(n[9:19]) for n, _ in names(f"{self.folder}/manifest") if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The recorded state; an error if its checksum doesn't hold."""
        v = self.version() if version is None else version
        if not v:
            return {"sequence": 0, "runs": [], "values": [], "user_bytes": 0, "written_bytes": 0}
        m = read_json(f"{self.folder}/manifest/manifest-{v:010d}.json")
        if m["crc"] != _crc(m["state"]):
            raise ValueError(f"manifest {v} is corrupt")
        return m["state"]

    def _commit(self, state: dict) -> None:
        v = self.version() + 1
        commit_json(self.spark, f"{self.folder}/manifest", f"manifest-{v:010d}.json", {"state": state, "crc": _crc(state)})

    def tree(self, state: dict | None = None) -> Tree:
        """The shape: levels of runs, newest first."""
        runs = (state or self.manifest())["runs"]
        levels = []
        for level in range(max((r["level"] for r in runs), default=-1) + 1):
            own = sorted((r for r in runs if r["level"] == level), key=lambda r: -r["sequence"])
            levels.append(tuple(Run(r["sequence"], tuple(File(i, f["bytes"], typed(f["min"]), typed(f["max"])) for i, f in enumerate(r["files"])), r["units"]) for r in own))
        return Tree(tuple(levels))

    def files(self) -> DataFrame:
        rows = [(r["level"], r["sequence"], i, f["path"], f["bytes"], f["entries"], str(typed(f["min"])), str(typed(f["max"]))) for r in self.manifest()["runs"] for i, f in enumerate(r["files"])]
        return self.spark.createDataFrame(rows, "level int, run long, file int, path string, bytes long, entries long, min_key string, max_key string")

    # -- writing --------------------------------------------------------------------------------
    def put(self, rows: DataFrame) -> None:
        """Append ``rows``: the key and any values. Of rows with one key, the one with the greatest ``seq``
        counts, if there is such a column; else keys must be distinct."""
        self._append(rows.withColumn("is_tombstone", F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        """Append tombstones; keys that aren't there may be deleted too."""
        self._append(keys.select(self.key).distinct().withColumn("is_tombstone", F.lit(True)))

    def _append(self, rows: DataFrame) -> None:
        state = self.manifest()
        if "seq" in rows.columns:
            rows = cl.newest(rows, [self.key], ["seq"]).drop("seq")
        if self.config.value_threshold and "value" in rows.columns:
            rows, values = cl.split_values(rows, "value", self.config.value_threshold)
            path = f"values/{uuid.uuid4().hex}"
            values.write.parquet(f"{self.folder}/{path}")
            state["values"].append(path)
        sequence = state["sequence"] + 1
        files = self._write(rows, sequence, 0)
        if not files:
            return
        written = sum(f["bytes"] for f in files)
        state["runs"].append({"level": 0, "sequence": sequence, "units": 1, "files": files})
        state.update(sequence=sequence, user_bytes=state["user_bytes"] + written, written_bytes=state["written_bytes"] + written)
        self._commit(state)
        self.config.growth.note_flush()
        self.compact()

    def _write(self, rows: DataFrame, sequence: int, level: int, about_bytes: int = 0) -> list[dict]:
        """A run: files of disjoint key ranges, each sorted by key."""
        path = f"data/L{level:02d}-R{sequence:010d}-{uuid.uuid4().hex[:8]}"
        parts = max(1, -(-about_bytes // self.config.file_bytes))
        placed = rows.repartitionByRange(parts, self.key).sortWithinPartitions(self.key)
        placed.write.parquet(f"{self.folder}/{path}")
        found = {n: size for n, size in names(f"{self.folder}/{path}") if n.endswith(".parquet")}
        if not found:
            return []
        written = self.spark.read.parquet(f"{self.folder}/{path}")
        bounds = written.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n")).agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi"), F.count(F.lit(1)).alias("c")).collect()  # a row a file
        return [{"path": f"{path}/{r['n']}", "bytes": found[r["n"]], "entries": r["c"], "min": plain(r["lo"]), "max": plain(r["hi"])} for r in sorted(bounds, key=lambda r: r["lo"])]

    # -- compaction -----------------------------------------------------------------------------
    def compact(self) -> int:
        """Carry out what the growth scheme asks for, up to ``max_compactions`` merges."""
        done = 0
        while done < self.config.max_compactions:
            tree = self.tree()
            request = self.config.growth.next_compaction(tree)
            if request is None:
                break
            job = self.config.merge.plan(tree, request)
            if job is None:
                break
            self.execute(job)
            done += 1
        return done

    def execute(self, job) -> None:
        """Merge a job's files, newest wins, into one run of the target level; commit; the inputs are then unreferenced.

        A merged run counts the units of all its inputs. Files of a target run that aren't touched stay in it.
        """
        state = self.manifest()
        by = {(r["level"], r["sequence"]): r for r in state["runs"]}
        picks = [(level, run, files) for level, run, files in job.sources] + [(job.target, run, files) for run, files in job.targets]
        merged, about, units, kept = [], 0, 0, []
        for level, run, files in sorted(picks, key=lambda p: (p[0], -p[1])):  # lower levels are newer
            r = by[level, run]
            chosen = [r["files"][i] for i in files]
            merged.append(self._read([f["path"] for f in chosen]))
            about += sum(f["bytes"] for f in chosen)
            units += r["units"]
            r["files"] = [f for i, f in enumerate(r["files"]) if i not in files]
            if r["files"] and level == job.target:
                kept += r["files"]
                r["files"] = []
        rows = cl.merge_runs(merged, [self.key], job.drop_tombstones)
        sequence = state["sequence"] + 1
        new = self._write(rows, sequence, job.target, about)
        state["runs"] = [r for r in state["runs"] if r["files"]]
        if new or kept:
            state["runs"].append({"level": job.target, "sequence": sequence, "units": units, "files": sorted(new + kept, key=lambda f: typed(f["min"]))})
        state.update(sequence=sequence, written_bytes=state["written_bytes"] + sum(f["bytes"] for f in new))
        self._commit(state)

    def sweep(self, older_than: float = 7 * 86400, versions: int = 1) -> list[str]:
        """Delete data files that none of the latest ``versions`` manifests names and that are ``older_than``
        seconds old, and unfinished manifests of that age; the paths that went.

        Older versions can then not be read. The age spares runs that are being written and not committed yet.
        """
        latest, before = self.version(), time.time() - older_than
        live = {f["path"] for v in range(max(0, latest - versions + 1), latest + 1) for r in self.manifest(v)["runs"] for f in r["files"]}
        system, root = open_fs(self.folder)
        from pyarrow.fs import FileSelector

        gone = [i.path for i in system.get_file_info(FileSelector(f"{root}/data", recursive=True, allow_not_found=True)) if i.is_file and i.path.endswith(".parquet") and i.mtime.timestamp() <= before and i.path[len(root) + 1 :] not in live]
        gone += [i.path for i in system.get_file_info(FileSelector(f"{root}/manifest", allow_not_found=True)) if i.base_name.endswith(".tmp") and i.mtime.timestamp() <= before]
        for p in gone:
            system.delete_file(p)
        return gone

    # -- reading --------------------------------------------------------------------------------
    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{p}" for p in paths))

    def log(self, version: int | None = None, low=None, high=None) -> DataFrame | None:
        """All live rows with ``_seq``, their run's place in time; files whose keys lie outside [low, high] aren't opened."""
        out = None
        runs = self.manifest(version)["runs"]
        # deeper levels are older; within a level the sequence decides
        for age, r in enumerate(sorted(runs, key=lambda r: (-r["level"], r["sequence"]))):
            paths = [f["path"] for f in r["files"] if (high is None or typed(f["min"]) <= high) and (low is None or typed(f["max"]) >= low)]
            if paths:
                part = self._read(paths).withColumn("_seq", F.lit(age))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _resolved(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        values = self.manifest(version)["values"]
        if "pointer" not in rows.columns:
            return rows
        far = self._read(values).dropDuplicates(["pointer"])
        return cl.resolve_values(rows, far, "value")

    def scan(self, low=None, high=None, version: int | None = None) -> DataFrame | None:
        """The live rows of a key range, in key order."""
        log = self.log(version, low, high)
        if log is None:
            return None
        if low is not None:
            log = log.filter(F.col(self.key) >= F.lit(low))
        if high is not None:
            log = log.filter(F.col(self.key) <= F.lit(high))
        return self._resolved(cl.live(log, [self.key], ["_seq"]).drop("_seq", "is_tombstone"), version).orderBy(self.key)

    def get(self, keys: DataFrame) -> DataFrame | None:
        """The live rows of ``keys``; of each run only files whose bounds meet the span of the keys are opened."""
        low, high = keys.agg(F.min(self.key), F.max(self.key)).first()
        if low is None:
            return self.scan().limit(0) if self.manifest()["runs"] else None
        if isinstance(low, bytearray):
            low, high = bytes(low), bytes(high)
        log = self.log(low=low, high=high)
        if log is None and self.manifest()["runs"]:
            return self.scan().limit(0)
        return None if log is None else self._resolved(cl.get(log, keys, [self.key], ["_seq"]).drop("_seq", "is_tombstone"))

    def stats(self) -> dict:
        """Counts and bytes; ``tree_bytes`` is without the values kept beside it, ``disk_bytes`` with them."""
        state = self.manifest()
        files = [f for r in state["runs"] for f in r["files"]]
        tree = sum(f["bytes"] for f in files)
        far = sum(size for v in state["values"] for n, size in names(f"{self.folder}/{v}") if n.endswith(".parquet"))
        return {"levels": len(self.tree(state).levels), "runs": len(state["runs"]), "files": len(files), "entries": sum(f["entries"] for f in files), "tree_bytes": tree, "disk_bytes": tree + far, "write_amplification": state["written_bytes"] / state["user_bytes"] if state["user_bytes"] else None}


def plain(v):
    """A key's bound as JSON: bytes, dates and times say their type, other values stand for themselves."""
    if isinstance(v, (bytes, bytearray)):
        return {"bytes": bytes(v).hex()}
    if isinstance(v, datetime.datetime):
        return {"time": v.isoformat()}
    return {"date": v.isoformat()} if isinstance(v, datetime.date) else v


def typed(v):
    """What plain() was made from."""
    if not isinstance(v, dict):
        return v
    (kind, text), = v.items()
    return bytes.fromhex(text) if kind == "bytes" else datetime.datetime.fromisoformat(text) if kind == "time" else datetime.date.fromisoformat(text)


def _crc(state: dict) -> int:
    return zlib.crc32(json.dumps(state, sort_keys=True).encode())


class VectorStore:
    """Vectors with opaque metadata; search proposes from an index that is rebuilt on demand and scores what is stored."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int, index: IvfConfig = IvfConfig(), store: StoreConfig | None = None, training_threshold: int = 1000):
        self.spark, self.dimension, self.index_config, self.threshold = spark, dimension, index, training_threshold
        self.rows = KeyedStore(spark, folder, "id", store)
        self.index: IvfIndex | None = None
        self.indexed: int | None = None

    def insert(self, vectors: DataFrame) -> None:
        """``(id, vector[, metadata])``; an id that exists is overwritten. Vectors of another length, or not finite, are an error."""
        ok = F.when((F.size("vector") == self.dimension) & finite(F.col("vector")), F.col("vector").cast("array<float>")).otherwise(F.raise_error(F.lit(f"not {self.dimension} finite numbers")))
        meta = F.col("metadata").cast("binary") if "metadata" in vectors.columns else F.lit(None).cast("binary")
        extra = ["seq"] if "seq" in vectors.columns else []
        self.rows.put(vectors.select(F.col("id").cast("bigint").alias("id"), ok.alias("vector"), meta.alias("metadata"), *extra))

    def delete(self, ids: DataFrame) -> None:
        self.rows.delete(ids.select(F.col("id").cast("bigint").alias("id")))

    def all(self) -> DataFrame:
        got = self.rows.scan()
        return got if got is not None else self.spark.createDataFrame([], "id long, vector array<float>, metadata binary")

    def get(self, ids: DataFrame) -> DataFrame:
        got = self.rows.get(ids)
        return got if got is not None else self.all()

    def __len__(self) -> int:
        return self.all().count()

    def rebuild_index(self) -> bool:
        """Train and encode what is stored; below the threshold there is no index and search reads everything."""
        vectors = self.all().select("id", "vector")
        self.indexed = self.rows.version()
        self.index = IvfIndex.build(vectors, self.index_config) if vectors.count() >= self.threshold else None
        return self.index is not None

    def search(self, queries: DataFrame, k: int, nprobe: int = 32, candidates: int = 100) -> DataFrame:
        """``(query_id, id, distance, rank)``; codes that are stale, by writes after the index, never change a distance.

        Rows written since are searched exactly, and deleted ones are left out before candidates are counted.
        """
        vectors = self.all().select("id", "vector")
        if self.index is None:
            return knn.knn(queries, vectors, k)
        then = self.rows.scan(version=self.indexed).select("id", F.col("vector").alias("then"))
        changed = vectors.join(then, "id", "left").filter(F.col("then").isNull() | (F.col("then") != F.col("vector"))).select("id", "vector")
        hidden = then.select("id").join(vectors.select("id"), "id", "left_anti").union(changed.select("id"))
        proposed = self.index.candidates(queries, nprobe, max(candidates, k) if k > 0 else 0, hidden).select("query_id", "id")
        fresh = knn.knn(queries, changed, k).select("query_id", "id")
        return knn.rerank(proposed.union(fresh), queries, vectors, k)

    def stale_deletes(self) -> int:
        """How many ids the index still holds that are deleted by now."""
        if self.index is None:
            return 0
        return self.rows.scan(version=self.indexed).select("id").join(self.all().select("id"), "id", "left_anti").count()

    def footprint(self) -> dict:
        s = self.rows.stats()
        return {"disk_bytes": s["disk_bytes"], "tree_bytes": s["tree_bytes"], "index_vectors": self.index.codes.count() if self.index else 0}
