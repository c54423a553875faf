"""Cutting lineage on storage that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a temporary one on a local master and an error on a cluster."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read back: smaller than a checkpoint, for wide rows that are read by columns."""
    at = f"{shared_dir(df.sparkSession)}/gridloom-{uuid.uuid4()}.parquet"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop shuffle files and checkpoints that no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
