"""Cutting lineage in the folder the cluster names, never in a machine's own."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset, a folder of our own (tests, local mode)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="spanforge-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, so that later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
