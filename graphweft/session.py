"""Session helpers: table paths, and cutting a plan's lineage where every executor can read the cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as it is. Only a session that names none (a
    local one, as in tests) gets a folder under the machine's temporary directory.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphweft-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, for files that a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(df: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for ``df``, which must not be read again; does nothing for other DataFrames."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly work on each row where it lies: as it is if it has a split for every core, else dealt out evenly.
    Files of many splits, as any large table has, are never shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, so that a loop's plan stays small and a lost executor
    costs no recomputation of earlier supersteps."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
