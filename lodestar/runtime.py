"""Session helpers: the shared folder, lineage cuts and table loading."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is absent and the master is a single JVM (tests), a fresh folder is set;
    on a cluster its absence is an error, since a machine-local folder would not be shared.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(at)
        return at
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestar-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the reliable checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_place(df: DataFrame) -> DataFrame:
    """cut() that keeps how ``df`` is partitioned and sorted, so that joins on these columns don't shuffle it again.

    Plans that adapt at run time don't tell their partitioning, so this one doesn't adapt.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the plan is made when it is first asked for, and must be made under this setting
        return cut(df.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints that nothing refers to; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
