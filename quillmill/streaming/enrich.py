"""Enrichment of rows by an outside model: resumable, with errors set aside, the model pluggable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillmill.functions.text import filled, strip
from quillmill.sources.shared import bound_batches


def pending(docs: DataFrame, done: DataFrame, key: str, start: int | None = 0, limit: int | None = None) -> DataFrame:
    """Rows from start on, of all keys if it is None, whose key has no filled result in done (key, value)."""
    ready = done.where(strip(filled("value")) != "").select(key)
    rest = (docs if start is None else docs.where(F.col(key) >= start)).join(ready, key, "left_anti")
    return rest.orderBy(key).limit(limit) if limit is not None else rest


def row_at(docs: DataFrame, key: str, place: int) -> DataFrame:
    """The row at a place, from 0, in the order of key; none beyond the end."""
    return docs.orderBy(key).offset(place).limit(1)


def enrich(docs: DataFrame, model: Callable[[str], str], key: str, text: str, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """(key, value, error): model(text) of each row. Blank texts give the empty string without a call; a call is tried again after a wait."""
    def one(content: str | None) -> tuple[str | None, str | None]:
        if not (content or "").strip():
            return "", None
        last = ""
        for k in range(tries):
            try:
                return model(content), None
            except Exception as e:  # noqa: BLE001  any model's failure
                last = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(wait)
        return None, last

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(t) for t in b[text]]
            yield pd.DataFrame({key: b[key], "value": [x[0] for x in got], "error": [x[1] for x in got]})

    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(rows, f"`{key}` {kind}, value string, error string")


def run(docs: DataFrame, path: str, model: Callable[[str], str], key: str, text: str, every: int = 1000, tries: int = 3, wait: float = 2.0) -> None:
    """Enriches what is pending, about every rows at a time, each lot appended to path/values and path/errors as it ends: a run that stops goes on where it was.

    What is pending is found once and kept in the shared folder, cut to lots by a hash of the key: how ids are spread does
    not matter, and each lot is read by itself.
    """
    from quillmill.sources.files import append_errors, read_table
    from quillmill.sources.shared import Kept

    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    done = read_table(spark, f"{path}/values", f"`{key}` {kind}, value string")
    with Kept(spark) as keep:
        rest = keep(pending(docs.select(key, text), done, key, start=None))
        lots = -(-rest.count() // every)
        if lots > 1:
            rest = keep(rest.withColumn("lot", F.pmod(F.xxhash64(key), F.lit(lots))).repartition("lot"), "lot")
        for lot in range(lots):
            found = enrich(rest.where(F.col("lot") == lot) if lots > 1 else rest, model, key, text, tries, wait).persist()
            found.where("error IS NULL").select(key, "value").write.mode("append").parquet(f"{path}/values")
            append_errors(found.select(key, "error"), f"{path}/errors")
            found.unpersist()


def align(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """docs with the columns of done, which must have a row for each of theirs and no other: else a ValueError says how many rows are without a partner.

    Rows are matched by key, never by place. Repeated keys on either side are refused too: they cannot be told apart.
    """
    keys = lambda df, name: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(name))
    both = keys(docs, "a").join(keys(done, "b"), "k", "full")
    odd = both.agg(F.count_if(F.col("b").isNull()).alias("lacking"), F.count_if(F.col("a").isNull()).alias("unknown"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated")).first()
    if odd.lacking or odd.unknown or odd.repeated:
        raise ValueError(f"tables do not match by {key}: {odd.lacking} keys without a result, {odd.unknown} results without a row, {odd.repeated} repeated keys")
    return docs.join(done, key)


def enriched(docs: DataFrame, done: DataFrame, key: str, name: str = "modern_text") -> DataFrame:
    """docs with the results of done, the first of each key, as a column."""
    one = done.groupBy(key).agg(F.min("value").alias(name))
    return docs.join(one, key, "left")
