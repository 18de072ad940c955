"""Session-level helpers shared by every module: table access, checkpointing, sizing."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``, never redirected.

    Only where the setting is absent and all work is done on this machine a folder below the warehouse is set. On a cluster
    without the setting a RuntimeError is raised: executors would write to disks that others cannot read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        configured = f"{warehouse.rstrip('/')}/_checkpoints"
        if not re.match(r"[a-z][a-z0-9+.-]*:", configured):
            configured = "file:" + os.path.abspath(configured)
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut`` but as Parquet, which keeps column pruning and compression for wide rows. The table goes when the
    driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Task slots to fill: the shuffle partition setting or the default parallelism, whichever is larger."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
