"""What several operators share: the shared folder, checkpoints and document keys."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmill.sources.shared import bound_batches, remove, settle, shared_dir  # noqa: F401

#: What separates words in most contracts here: ASCII white space only.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the storage that it is in, its folders made: what others than Spark need to find it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    return fs.makeQualified(where).toString()


def release(spark: SparkSession) -> None:
    """Lets go of shuffles whose plans are out of use: their files stay on executors' disks until the driver collects its garbage, which long jobs on small plans hardly make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def split_by_ids(docs: DataFrame, ids: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose key is surely none of ids (one column of the key's type), and those of ids with perhaps a few more.

    A filter of 16 bits for each id, 8 MB at most, is broadcast. What stands on the first side needs no join, which would
    move all texts; beyond 8 MB more rows than needed are on the second side.
    """
    n, spark = ids.count(), docs.sparkSession
    power = min(26, max(16, (16 * n - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << power)) + 1  # noqa: E731  the functions count values from 1
    bits = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    met = docs.withColumn("__p", place(key)).withColumn("__b", F.bitmap_bucket_number("__p")).join(F.broadcast(settle(bits)), "__b", "left")
    at = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_there = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    release(spark)
    return tuple(met.where(c).select(*(docs[x] for x in docs.columns)) for c in (~set_there, set_there))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else left."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables in the shared folder that go when the work ends. Unlike checkpoints they are compressed, and only columns that are read again are read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for name in list(self.paths):
            self.drop(name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of this name, in place of an earlier one, which df may still read."""
        path = scratch_table(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            remove(self.spark, path)
