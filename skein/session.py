"""Session helpers: reliable checkpoints, and the package on the workers."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is only made in local mode, where driver and executors share a disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skein-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts both sides: a table that grows with the input never goes through the driver, whatever size Spark takes it for."""
    return df.hint("merge")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Even out CPU-heavy rows when the input has fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def many_tasks(spark: SparkSession) -> int:
    """Partitions for CPU-heavy work on few bytes: a number that is given is kept, where Spark would join small partitions to a few tasks."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per session, whatever folder the driver was started in."""
    from pyspark import SparkFiles

    sc = spark.sparkContext
    target = os.path.join(SparkFiles.getRootDirectory(), "package", "skein.zip")
    if getattr(sc, "_skein_shipped", False):
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    here = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._skein_shipped = True


def shipped(fn):
    """``fn(spark, sf_dir)`` that finds the package on its workers."""
    @functools.wraps(fn)
    def call(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)
    return call
