"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foliospark", master: str | None = None, partitions: int | None = None, scratch: str | None = None) -> SparkSession:
    """Session with adaptive execution and skew-join splitting on.

    Estimates do not see how much a table grows when its arrays are exploded, so no join is broadcast on an estimate:
    a side is broadcast only after it was shuffled and measured.
    `partitions` is left to the cluster when not given: AQE coalesces from the configured number. `scratch` is for sessions of
    one machine; on a cluster `spark.checkpoint.dir` names the folder.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can read: `spark.checkpoint.dir`, or the checkpoint folder set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    named = spark.sparkContext.getCheckpointDir()
    if named:
        return os.path.dirname(named.rstrip("/"))
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the scratch folder and read back, for what is used several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that an iterative plan stays short and survives a lost executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)
