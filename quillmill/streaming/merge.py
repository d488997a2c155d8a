"""A stream of new rows merged into a table without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.ingest import new_rows
from quillmill.sources.files import read_table


def merge_stream(spark: SparkSession, source: DataFrame, table: str, schema: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends to table, for each batch, the first row of every key that it lacks.

    Batches are numbered in the table's partitions and written by overwriting their own, so a batch that runs twice leaves no row twice.
    """
    def one(batch: DataFrame, number: int) -> None:
        old = read_table(spark, table, f"{schema}, batch bigint").where(f"batch <> {number}").drop("batch")
        new_rows(old, batch, keys, order).select(*old.columns).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
