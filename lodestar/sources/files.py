"""Files of the shared folder, for executors (through Arrow) and the driver (through Hadoop's rename)."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs


def open_fs(uri: str):
    """``(file system, path)`` of a URI or an absolute path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)  # Hadoop's names for S3


def commit_json(spark, folder: str, name: str, value) -> None:
    """Write ``folder/name`` so that it appears whole, once, or not at all.

    Raises if the name is taken: of two writers of one version, one fails. Hadoop's rename without
    overwriting is atomic on the file systems that Spark's own commit protocols rely on.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    tmp = path(f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")
    system = tmp.getFileSystem(conf)
    out = system.create(tmp, False)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), conf)
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(system.makeQualified(tmp), system.makeQualified(path(f"{folder}/{name}")), rename)


def read_json(uri: str):
    system, path = open_fs(uri)
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def names(uri: str) -> list[tuple[str, int]]:
    """Base name and size of the files right below a folder, by name; none if there is no folder."""
    system, path = open_fs(uri)
    found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((i.base_name, i.size) for i in found if i.is_file)
