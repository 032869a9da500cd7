"""Upserts from a stream into a KeyedStore: one run a micro-batch. An extension; the batch API does not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestar.operators.store import KeyedStore


def upserts(changes: DataFrame, store: KeyedStore, checkpoint: str, tombstone: str = "is_tombstone", seq: str = "seq"):
    """A writer of ``changes``: of each key in a batch the row with the greatest ``seq`` counts, a tombstone deletes.

    A batch that is delivered again after a failure writes the same rows as a newer run, which reads the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from lodestar.operators import changelog as cl

        last = cl.newest(batch, [store.key], [seq]).persist()
        try:
            puts, gone = last.filter(~F.col(tombstone)).drop(tombstone, seq), last.filter(F.col(tombstone)).select(store.key)
            if not puts.isEmpty():
                store.put(puts)
            if not gone.isEmpty():
                store.delete(gone)
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
