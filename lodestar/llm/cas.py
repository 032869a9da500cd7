"""Token-id output as a content-addressed store.

A rolling hash over the last ``WINDOW`` ids decides where an id stream is cut, so equal passages
are cut alike wherever they stand. A chunk is stored once under the hash of its bytes; a document
is a recipe, the hashes of its chunks in order, and a Merkle root over them. Chunks, and recipes,
of one two-byte prefix have a Merkle root too, and the store's manifest holds those and their root.
"""

from __future__ import annotations

import array
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestar.sources.files import commit_json, open_fs, read_json
from lodestar.llm.tokens import TOKENIZER, encode, encoder
from lodestar.runtime import scratch

WINDOW = 16
MIN_IDS, MASK_BITS, MAX_IDS = 64, 8, 2048
_MULT = 0x9E3779B97F4A7C15 | 1
DIGEST = 16


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a 64-bit polynomial hash of the last ``WINDOW`` ids, by doubling the window."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = 1
    while width < WINDOW:
        factor = np.uint64(pow(_MULT, width, 1 << 64))
        nxt = h.copy()
        nxt[width:] += h[:-width] * factor
        h, width = nxt, width * 2
    return h


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of chunks: where the rolling hash's top bits are 0, at least MIN_IDS and at most MAX_IDS apart."""
    n = len(ids)
    marks = (np.flatnonzero(rolling(ids) >> np.uint64(64 - MASK_BITS) == 0) + 1).tolist() if n else []
    out, start, k = [], 0, 0
    while n - start > MIN_IDS:
        while k < len(marks) and marks[k] < start + MIN_IDS:
            k += 1
        end = min(marks[k] if k < len(marks) else n, start + MAX_IDS, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; leaf and inner nodes are told apart, an odd node goes up as it is."""
    level = [digest(b"\0" + x) for x in leaves]
    if not level:
        return digest(b"")
    while len(level) > 1:
        up = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


def chunks_of(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each document, its recipe, and one for each chunk that its partition sees first."""

    def run(batches):
        enc, seen = encoder(tokenizer), set()
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("recipe", pa.list_(pa.binary())), ("root", pa.binary()), ("digest", pa.binary()), ("ids", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cols: list[list] = [[] for _ in schema]
                for doc_id, text in zip(b.column("doc_id").slice(at, 512).to_pylist(), b.column("text").slice(at, 512)):
                    whole = array.array("H", encode(enc, text.as_py())).tobytes()
                    ids = np.frombuffer(whole, "<u2")
                    recipe, start = [], 0
                    for end in cuts(ids):
                        data = whole[2 * start : 2 * end]
                        d, start = digest(data), end
                        recipe.append(d)
                        if d not in seen:
                            if len(seen) > 200_000:  # the shuffle drops what this forgets
                                seen.clear()
                            seen.add(d)
                            for c, v in zip(cols, (None, None, None, None, d, data)):
                                c.append(v)
                    for c, v in zip(cols, (doc_id, len(ids), recipe, merkle(recipe), None, None)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, recipe array<binary>, root binary, digest binary, ids binary")


def write_store(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> None:
    """Write ``folder/recipes`` and ``folder/chunks``; texts are tokenised once.

    Recipes and chunks go through one shuffle: a chunk to the partition of its hash, where it is
    kept once; a recipe to that of its root and id, so that equal documents are spread.
    """
    key = F.coalesce("digest", F.md5(F.concat_ws(":", F.hex("root"), "doc_id")).cast("binary"))
    both = chunks_of(docs, tokenizer).withColumn("kind", F.when(F.col("digest").isNull(), F.lit("recipes")).otherwise(F.lit("chunks")))
    placed = both.repartition(key).sortWithinPartitions("kind", "digest")

    def once(batches):
        last = pa.scalar(None, pa.binary())
        for b in batches:
            d = b.column("digest")
            before = pa.concat_arrays([pa.array([last.as_py()], pa.binary()), d.slice(0, len(d) - 1)]) if len(d) else d
            last = d[len(d) - 1] if len(d) else last
            yield b.filter(pc.fill_null(pc.not_equal(d, before), True))

    placed.mapInArrow(once, placed.schema).write.option("compression", "snappy").option("parquet.enable.dictionary", "false").partitionBy("kind").parquet(folder)


def recipes(spark, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, recipe array<binary>, root binary").parquet(f"{folder}/kind=recipes")


def chunks(spark, folder: str) -> DataFrame:
    return spark.read.schema("digest binary, ids binary").parquet(f"{folder}/kind=chunks")


def _digests(ids):
    def run(batches):
        for b in batches:
            data = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(x) // 2 for x in data], pa.int64()), pa.array([digest(x) == d for x, d in zip(data, b.column("digest").to_pylist())])], ["digest", "n", "sound"])

    return ids.mapInArrow(run, "digest binary, n long, sound boolean")


def manifest(spark, folder: str) -> DataFrame:
    """``(part, n, root)``: a Merkle root over the leaves, in order, of each two-byte prefix.

    Parts ``c....`` are of chunks, whose leaves are their hashes; parts ``r....`` of recipes, whose leaves
    are hashes of id, length and root, and which come by the prefix of the root.
    """

    def leaves(batches):
        for b in batches:
            ids, sizes, roots = (b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root"))
            out = [digest(repr((i, n)).encode() + r) for i, n, r in zip(ids, sizes, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(["r" + r[:2].hex() for r in roots], pa.string()), pa.array(out, pa.binary())], ["part", "leaf"])

    def roots(batches):
        part, held = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(held)], pa.int64()), pa.array([merkle(held)])], ["part", "n", "root"])

        for b in batches:
            for p, d in zip(b.column("part").to_pylist(), b.column("leaf").to_pylist()):
                if p != part:
                    if held:
                        yield row()
                    part, held = p, []
                held.append(d)
        if held:
            yield row()

    own = recipes(spark, folder).select("doc_id", "n_tokens", "root").mapInArrow(leaves, "part string, leaf binary")
    of = chunks(spark, folder).select(F.concat(F.lit("c"), F.lower(F.hex(F.substring("digest", 1, 2)))).alias("part"), F.col("digest").alias("leaf"))
    placed = own.union(of).repartition("part").sortWithinPartitions("part", "leaf")
    return placed.mapInArrow(roots, "part string, n long, root binary")


def parts_of(spark, folder: str) -> list[list]:
    """manifest() as ``[part, n, root]`` in order; 131,072 short rows at most."""
    return sorted([r["part"], r["n"], r["root"].hex()] for r in manifest(spark, folder).collect())


def _root_of(parts: list[list]) -> str:
    return merkle([f"{p}:{n}:{r}".encode() for p, n, r in parts]).hex()


def commit(spark, folder: str) -> list[list]:
    """Write the manifest of a store beside it; returns its parts."""
    parts = parts_of(spark, folder)
    commit_json(spark, folder, "manifest.json", {"parts": parts, "root": _root_of(parts)})
    return parts


def verify(spark, folder: str, found: list[list] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_chunks, merkle_root, verified)`` of every recipe.

    A document is verified if each of its chunks is in the store, has the bytes that its hash
    stands for, if their lengths add up, if the root follows from the recipe, and if the store has a
    manifest that is whole and gives the part in which the recipe is as it is now: where a recipe is
    lost or added, those of its part aren't verified. A part that is gone gives one row of nulls that isn't
    verified. Lost chunks show in the documents that need them. ``found`` is parts_of() the store, if known.
    """
    found = parts_of(spark, folder) if found is None else found
    try:
        known = read_json(f"{folder}/manifest.json")
    except FileNotFoundError:
        known = {"parts": [], "root": ""}
    whole = _root_of(known["parts"]) == known["root"]
    now, then = ({p: (n, r) for p, n, r in x if p[0] == "r"} for x in (found, known["parts"]))
    damaged = [p[1:] for p in now if not whole or then.get(p) != now[p]]
    lost = [p for p in then if p not in now]
    docs = recipes(spark, folder).withColumn("row", F.monotonically_increasing_id())
    parts = docs.select("row", F.explode("recipe").alias("digest"))
    got = parts.join(_digests(chunks(spark, folder)), "digest", "left").groupBy("row").agg(F.sum("n").alias("n"), F.min(F.coalesce("sound", F.lit(False))).alias("sound"))

    def roots(batches):
        bad = {bytes.fromhex(p) for p in damaged}
        for b in batches:
            ok = [merkle(r) == x and x[:2] not in bad for r, x in zip(b.column("recipe").to_pylist(), b.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(ok, pa.bool_())], [*b.schema.names[:-2], "follows"])

    own = docs.select("row", "doc_id", "n_tokens", F.size("recipe").alias("n_chunks"), F.lower(F.hex("root")).alias("merkle_root"), "recipe", "root").mapInArrow(roots, "row long, doc_id long, n_tokens long, n_chunks int, merkle_root string, follows boolean")
    out = own.join(got, "row", "left").select("doc_id", "n_tokens", "n_chunks", "merkle_root", (F.col("follows") & F.coalesce(F.col("sound"), F.lit(True)) & (F.coalesce("n", F.lit(0)) == F.col("n_tokens"))).alias("verified"))
    if lost:
        out = out.union(spark.createDataFrame([(None, None, None, None, False)] * len(lost), out.schema))
    return out


def reconstruct(spark, folder: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every document, put together from the store."""
    docs = recipes(spark, folder).withColumn("row", F.monotonically_increasing_id())
    parts = docs.select("row", F.posexplode("recipe").alias("pos", "digest")).join(chunks(spark, folder), "digest")
    whole = parts.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("parts"))

    def ids(batches):
        for b in batches:
            rows = [np.frombuffer(b"".join(p or []), "<u2").astype(np.int32) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("row", "doc_id").join(whole, "row", "left").select("doc_id", "parts").mapInArrow(ids, "doc_id long, ids array<int>")


def store(docs: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write a store of ``docs``, commit its manifest, and return verify() of it.

    Nulls: a null text is a document of no ids and no chunks, as an empty one is; a null id stays null.
    Rows that repeat have a recipe each and share their chunks. Texts have no greatest length. An empty
    table gives no rows. Columns besides doc_id and text, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "cas")
    if "text" not in docs.columns:
        raise ValueError("no column text")
    write_store(docs, folder, tokenizer)
    from pyarrow.fs import FileType

    system, path = open_fs(folder)
    if system.get_file_info(f"{path}/kind=recipes").type == FileType.NotFound:  # no row was written
        return docs.limit(0).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).alias("n_chunks"), F.lit("").alias("merkle_root"), F.lit(True).alias("verified"))
    if system.get_file_info(f"{path}/kind=chunks").type == FileType.NotFound:
        system.create_dir(f"{path}/kind=chunks")
    return verify(spark, folder, commit(spark, folder))
