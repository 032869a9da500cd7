"""Vector files: records of a little-endian 32-bit length and that many components (fvecs float, ivecs int, bvecs byte)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.sources.files import names, open_fs

MOST = 1 << 20
KINDS = {"fvecs": ("<f4", 4, "float"), "ivecs": ("<i4", 4, "int"), "bvecs": ("u1", 1, "int")}


def read_vecs(spark: SparkSession, path: str, kind: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """``(vec_id, vector)`` of a file, read in blocks of whole records by many tasks.

    Lengths that aren't positive, are above 2**20 or differ, and a record cut short, are errors.
    Integers stay integers, so ids above 2**24 survive. An empty file gives no rows.
    """
    kind = kind or path.rsplit(".", 1)[-1]
    dtype, width, sql = KINDS[kind]
    system, at = open_fs(path)
    size = system.get_file_info(at).size
    schema = f"vec_id long, vector array<{sql}>"
    if not size:
        return spark.createDataFrame([], schema)
    with system.open_input_file(at) as f:
        d = int(np.frombuffer(f.read(4).ljust(4, b"\0"), "<i4")[0]) if size >= 4 else 0
    if not 0 < d <= MOST:
        raise ValueError(f"{path}: a vector of {d} components")
    record = 4 + width * d
    if size % record:
        raise ValueError(f"{path}: lengths differ or the last record is cut short")
    per = max(1, block_bytes // record)
    blocks = spark.range(0, -(-size // record), per, numPartitions=max(1, min(10_000, -(-size // (record * per)))))

    def run(batches):
        system, at = open_fs(path)
        for b in batches:
            for first in b.column("id").to_pylist():
                with system.open_input_file(at) as f:
                    raw = np.frombuffer(f.read_at(min(per * record, size - first * record), first * record), np.uint8).reshape(-1, record)
                if (raw[:, :4].copy().view("<i4") != d).any():
                    raise ValueError(f"{path}: lengths differ")
                values = np.ascontiguousarray(raw[:, 4:]).view(dtype)
                flat = pa.array(values.ravel().astype(np.int32) if sql == "int" else values.ravel().astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(raw))), pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * d), flat)], ["vec_id", "vector"])

    return blocks.mapInArrow(run, schema)


def write_vecs(vectors: DataFrame, folder: str, kind: str = "fvecs", key: str = "vec_id", vector: str = "vector") -> list[str]:
    """Write one file a partition, in key order within and across files; the files' paths in order.

    Each file appears by a rename once it is whole.
    """
    import uuid

    dtype, _, _ = KINDS[kind]

    def run(batches):
        from pyspark import TaskContext

        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.{kind}"
        own, out, d = f"{root}/.{name}.{uuid.uuid4().hex}", None, None
        for b in batches:
            for v in b.column(0).to_pylist():
                if d not in (None, len(v)) or not 0 < len(v) <= MOST:
                    raise ValueError("lengths differ or are out of bounds")
                d = len(v)
                out = out or system.open_output_stream(own)
                out.write(np.array([d], "<i4").tobytes() + np.array(v).astype(dtype).tobytes())
        if out:
            out.close()
            system.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    rows = vectors.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(vector)
    done = {r[0] for r in rows.mapInArrow(run, "name string").collect()}  # a row a file
    return [f"{folder}/{n}" for n, _ in names(folder) if n in done]
