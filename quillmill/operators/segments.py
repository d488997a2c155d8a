"""Segments of text columns by each method, and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillmill.functions.segment import CUTTERS, MEASURES, METHODS, SEGMENTERS, measures, metrics

#: Texts that are cut at once, and the types of what is made of them.
AT_ONCE = 500
KINDS = {"int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def _cut(docs: DataFrame, texts: dict[str, str], key: str, methods: tuple[str, ...], of: Callable, schema: str) -> DataFrame:
    """(key, text_type, method) with the columns of schema: what of gives for the segments of each text by each method.

    Texts are cut in Python, some at once: as expressions within lambdas the patterns are compiled for each piece, and
    columns that read them cut the text again.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    columns = list(texts.values())
    types = pa.schema([pa.field(f.split()[0], KINDS[f.split()[1]]) for f in schema.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), AT_ONCE):
                b = whole.slice(start, AT_ONCE)
                found = [of(CUTTERS[m](t or "")) for row in zip(*(b.column(1 + i).to_pylist() for i in range(len(columns)))) for t in row for m in methods]
                each = len(columns) * len(methods)
                keys = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), each)))
                kinds = pa.array([k for k in texts for _ in methods] * len(b), pa.string())
                arrays = [pa.array(x, types.field(n).type) for n, x in zip(names, zip(*found))]
                yield pa.RecordBatch.from_arrays([keys, kinds, pa.array(list(methods) * (len(columns) * len(b)), pa.string()), *arrays], [key, "text_type", "method", *names])

    rest = [F.col(c).alias(f"__t{i}") for i, c in enumerate(columns)]
    return docs.select(key, *rest).mapInArrow(rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, text_type string, method string, {schema}")


def segmented(docs: DataFrame, texts: dict[str, str], key: str = "doc_id", methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(key, text_type, method, segments): long form of each text column by each method. texts: text_type -> column."""
    return _cut(docs, texts, key, methods, lambda segments: (segments,), "segments array<string>")


def measures_of(docs: DataFrame, texts: dict[str, str], key: str = "doc_id", methods: tuple[str, ...] = METHODS) -> DataFrame:
    """measured() of segmented(), without the segments being moved."""
    return _cut(docs, texts, key, methods, measures, MEASURES)


def measured(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_type, method) with the metrics of the segments."""
    return segments.select(key, "text_type", "method", metrics(F.col("segments")).alias("m")).select(key, "text_type", "method", "m.*")


def statistics(measures: DataFrame) -> DataFrame:
    """By text_type and method: totals, segments a text over all of them, and lengths over texts that have any."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return measures.groupBy("text_type", "method").agg(
        F.count("*").alias("total_texts"), F.sum("num_segments").alias("total_segments"), F.sum("total_chars").alias("total_chars"), F.avg("num_segments").alias("avg_segments"),
        F.avg(some("avg_length")).alias("avg_segment_length"), F.median(some("median_length")).alias("median_segment_length"), F.sum("empty_segments").alias("empty_segments_total"))


def nested(stats: DataFrame) -> DataFrame:
    """One row with report: text_type -> method -> the statistics of that row, for export as one object."""
    own = F.struct(*(c for c in stats.columns if c not in ("text_type", "method")))
    methods = stats.groupBy("text_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("method"), own))).alias("m"))
    return methods.agg(F.map_from_entries(F.collect_list(F.struct("text_type", "m"))).alias("report"))


def markdown(stats: DataFrame) -> DataFrame:
    """(line, value): a Markdown table of the totals by text_type and method."""
    from quillmill.sources.files import report_line

    head = stats.sparkSession.createDataFrame([(0, "| text | method | texts | segments | characters |"), (1, "|---|---|---|---|---|")], "line int, value string")
    place = F.row_number().over(Window.orderBy("text_type", "method")) + 1  # a row for each method
    return head.unionByName(report_line(stats.withColumn("line", place), "| %s | %s | %d | %d | %d |", "text_type", "method", "total_texts", "total_segments", "total_chars", keep=["line"]))


def box(measures: DataFrame) -> DataFrame:
    """Quartiles of average lengths by text_type and method, each text weighing as many segments as it has."""
    weighed = measures.where("num_segments > 0")
    q = F.percentile("avg_length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("num_segments"))
    out = weighed.groupBy("text_type", "method").agg(q.alias("q"), F.min("avg_length").alias("least"), F.max("avg_length").alias("most"))
    return out.select("text_type", "method", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "most")


def examples(docs: DataFrame, texts: dict[str, str], n: int = 3, key: str = "doc_id") -> DataFrame:
    """The first n rows with all segments in one struct for each text column."""
    first = docs.orderBy(key).limit(n)
    return first.select(key, *(F.struct(*(f(F.col(c)).alias(m) for m, f in SEGMENTERS.items())).alias(t) for t, c in texts.items()))
