import os

import numpy as np
import pytest

from lodestar.llm import cas, tokens
from lodestar.runtime import scratch, table


def test_counts_equal_direct_encoding(spark, sf):
    docs = table(spark, sf, "documents")
    enc = tokens.encoder(tokens.TOKENIZER)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, block_bytes=1 << 12).collect()}
    assert got == want


@pytest.mark.parametrize("block", [2, 4, 6, 10, 1 << 20])
def test_blocks_are_stitched(spark, block):
    rng = np.random.default_rng(block)
    folder = scratch(spark, "flat").removeprefix("file:")
    os.makedirs(folder)
    want = {}
    for name in ("a", "b"):
        ids = np.where(rng.random(57) < 0.3, tokens.SEPARATOR, rng.integers(0, 50_000, 57)).astype("<u2")
        ids[-1] = 7  # no separator closes the last document
        ids.tofile(f"{folder}/{name}.bin")
        lengths, n = [], 0
        for x in ids:
            if x == tokens.SEPARATOR:
                lengths.append(n)
                n = 0
            else:
                n += 1
        want |= {(f"{name}.bin", i): v for i, v in enumerate([*lengths, n])}
    got = {(r.file, r.ordinal): r.n_tokens for r in tokens.scan(spark, folder, block_bytes=block).collect()}
    assert got == want


def test_odd_bytes_are_an_error(spark):
    folder = scratch(spark, "flat").removeprefix("file:")
    os.makedirs(folder)
    open(f"{folder}/x.bin", "wb").write(b"abc")
    with pytest.raises(ValueError):
        tokens.scan(spark, folder)


def test_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tokens.token_counts(odd_docs).collect())
    assert len(got) == 10 and dict(got)[1] == 0 and dict(got)[2] == 0
    assert tokens.token_counts(no_docs).collect() == []


def test_store_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    folder = scratch(spark, "cas")
    cas.write_store(docs, folder)
    enc = tokens.encoder(tokens.TOKENIZER)
    want = {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in cas.reconstruct(spark, folder).collect()} == want
    cas.commit(spark, folder)
    c = cas.chunks(spark, folder)
    assert c.count() == c.select("digest").distinct().count()
    assert all(r.verified for r in cas.verify(spark, folder).collect())


def test_damage_is_found(spark, docs_of, tmp_path):
    from pyspark.sql import functions as F

    docs = docs_of(["one two three four " * 200, "another text altogether " * 150])
    folder = str(tmp_path / "cas")
    cas.write_store(docs, folder)
    cas.commit(spark, folder)
    kept = cas.chunks(spark, folder).collect()
    bad = [(bytearray(r.digest), bytearray(r.ids[:-2] + b"\x01\x00") if i == 0 else r.ids) for i, r in enumerate(kept)]
    spark.createDataFrame(bad, "digest binary, ids binary").write.mode("overwrite").parquet(f"{folder}/kind=chunks")
    assert not all(r.verified for r in cas.verify(spark, folder).collect())
    spark.createDataFrame(bad[1:], "digest binary, ids binary").write.mode("overwrite").parquet(f"{folder}/kind=chunks")
    assert cas.verify(spark, folder).filter(~F.col("verified")).count() >= 1


def test_lost_recipes_are_found(spark, docs_of, tmp_path):
    docs = docs_of(["one two three four " * 200, "another text altogether " * 150, "one two three four " * 200, ""])
    folder = str(tmp_path / "cas")
    cas.write_store(docs, folder)
    assert not any(r.verified for r in cas.verify(spark, folder).collect())  # no manifest yet
    cas.commit(spark, folder)
    assert all(r.verified for r in cas.verify(spark, folder).collect())
    kept = [(r.doc_id, r.n_tokens, r.recipe, r.root) for r in cas.recipes(spark, folder).collect()]
    for lose, left in ((2, {0: False, 1: True, 3: True}), (1, {0: True, 2: True, 3: True, None: False})):
        rows = [r for r in kept if r[0] != lose]
        spark.createDataFrame(rows, "doc_id long, n_tokens long, recipe array<binary>, root binary").write.mode("overwrite").parquet(f"{folder}/kind=recipes")
        assert {r.doc_id: r.verified for r in cas.verify(spark, folder).collect()} == left


def test_cuts_cover_and_realign():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    ends = cas.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= cas.MAX_IDS and sizes[:-1].min() >= cas.MIN_IDS
    shifted = np.concatenate([rng.integers(0, 50_000, 37).astype("<u2"), ids])
    assert len({e + 37 for e in ends} & set(cas.cuts(shifted))) > 0.9 * len(ends)
    assert cas.cuts(ids[:0]) == [] and cas.cuts(ids[:3]) == [3]


def test_store_odd_rows(odd_docs, no_docs):
    got = cas.store(odd_docs).collect()
    assert len(got) == 10 and all(r.verified for r in got)
    assert cas.store(no_docs).collect() == []
