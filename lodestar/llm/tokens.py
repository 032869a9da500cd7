"""Token counts from flat token files, by a scan for end-of-document identifiers.

A token file is nothing but little-endian 16-bit ids, each document closed by a separator id; there
is no index. Files are read in blocks of ``BLOCK_BYTES``, wherever those fall. A block is searched
for separators as one vector; a prefix scan over the blocks' summaries (separators so far, place
of the last one) then gives each document its ordinal and its length, across block edges too.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.sources.files import open_fs
from lodestar.runtime import cut, scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
BLOCK_BYTES = 4 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    """The byte-level BPE of a rank file; its ids fit 16 bits."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _safe(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def encode(enc, text: str | None) -> list[int]:
    """Ids of a text; strings of special tokens are ordinary text, a null is empty."""
    if not text:
        return []
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(_safe(text))


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Tokenise ``docs`` into one flat file a partition; return ``(file, ordinal, doc_id)``, computed.

    A file is written under a name of its own and then renamed, so a task that runs again, on
    another executor or beside itself, leaves the same file.
    """

    def write(batches):
        from pyspark import TaskContext

        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        own, ordinal, out, enc = f"{path}/.{name}.{uuid.uuid4().hex}", 0, None, encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(own)
            for text in batch.column("text"):
                out.write(np.array([*encode(enc, text.as_py()), separator], "<u2").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id").cast(pa.int64())], ["file", "ordinal", "doc_id"])
            ordinal += n
        if out:
            out.close()
            system.move(own, f"{path}/{name}")

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(picked.mapInArrow(write, "file string, ordinal long, doc_id long"))


def scan(spark, folder: str, *, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, ordinal, n_tokens)`` of every document in the token files of a folder.

    Tokens after a file's last separator are a last document; an empty document counts 0. A file of
    an odd number of bytes is an error. An empty or missing folder gives no rows.
    """
    assert block_bytes % 2 == 0
    system, path = open_fs(folder)
    from pyarrow.fs import FileSelector

    files = [(i.base_name, i.size) for i in system.get_file_info(FileSelector(path, allow_not_found=True)) if i.is_file and i.base_name.endswith(".bin")]
    if odd := [n for n, size in files if size % 2]:
        raise ValueError(f"not whole 16-bit ids: {odd[:3]}")
    listed = spark.createDataFrame(files, "file string, bytes long").filter("bytes > 0")
    blocks = listed.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    n = max(1, sum(-(-size // block_bytes) for _, size in files))
    blocks = blocks.repartition(min(n, 100_000))  # a few rows of names and numbers; spreads the reading

    def search(batches):
        system, path = open_fs(folder)
        for batch in batches:
            for file, size, block in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "block"))):
                with system.open_input_file(f"{path}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), "<u2")
                base = block * block_bytes // 2
                found = np.flatnonzero(ids == separator) + base
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([base + len(ids)], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "block", "upto", "found"])

    # separators take 8 bytes a document; only a block's number of them and the last one go through the scan
    each = cut(blocks.mapInArrow(search, "file string, block long, upto long, found array<long>"))
    own_last = F.element_at(F.when(F.size("found") > 0, F.col("found")), -1)
    brief = each.select("file", "block", "upto", F.size("found").alias("n"), own_last.alias("own"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    brief = brief.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", F.coalesce(F.max("own").over(before), F.lit(-1).cast("bigint")))
    # the end of a file closes a document that no separator does
    end = F.col("block") == F.max("block").over(W.partitionBy("file"))
    brief = brief.withColumn("open", end & (F.coalesce("own", "last") < F.col("upto") - 1)).select("file", "block", "ordinal", "last", "open")
    each = each.join(brief.hint("merge"), ["file", "block"])
    each = each.withColumn("found", F.when(F.col("open"), F.concat("found", F.array("upto"))).otherwise(F.col("found")))
    places = each.select("file", "ordinal", "last", F.col("found"), F.posexplode("found").alias("i", "at"))
    previous = F.when(F.col("i") == 0, F.col("last")).otherwise(F.element_at("found", F.greatest(F.col("i"), F.lit(1))))
    return places.select("file", (F.col("ordinal") + F.col("i")).cast("bigint").alias("ordinal"), (F.col("at") - previous - 1).cast("bigint").alias("n_tokens"))


def token_counts(docs: DataFrame, *, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, file, ordinal, n_tokens)`` of every row of ``docs``, by writing token files and scanning them.

    Nulls: a null text is an empty document, as an empty one is; a null id stays null. Rows that repeat
    each count. Texts have no greatest length. An empty table gives no rows. Columns besides doc_id and
    text, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    rows = write_token_files(docs, folder, tokenizer=tokenizer, separator=separator)
    counts = scan(spark, folder, separator=separator, block_bytes=block_bytes)
    # the planner takes counts for as small as the list of files that they come from, and would broadcast them
    return rows.join(counts.hint("merge"), ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "n_tokens")
