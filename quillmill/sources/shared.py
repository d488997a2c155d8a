"""The folder that driver and executors share, and tables kept there for the time of a job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later plans start from it and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on this session sends so many rows at most to Python at once.

    Plans read that setting when they run, which may be long after they are made, so it stays. The JVM holds the texts of
    a batch twice and keeps that memory: of the 10,000 rows that are usual, long documents take gigabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


class Kept:
    """One table at a time in the shared folder: each call writes a new one, from which the next plan starts, and drops the one before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, None

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def __call__(self, df: DataFrame, *partitions: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/kept-{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(path)
        self.drop()
        self.path = path
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        if self.path:
            remove(self.spark, self.path)
            self.path = None
