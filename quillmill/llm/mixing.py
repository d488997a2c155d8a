"""Mixing sources to target weights with exact budgets.

Every document gets a hash-random key. Within a source the key space is cut into equal ranges, about as many as each
holds documents, so that no task holds a source: sizes are summed by range, the sums are added up along the ranges, and
a sorted window within each range does the rest. A source is cut where its running sum meets its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmill.llm.common import ASCII_WORD, settle

#: Fixed values of the contract: weights by source in turn, the share of all words, and how often a word may be taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = 20_261


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ASCII_WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """For (source, source_size, n), one row per source: target and budget, its whole number.

    In order of most * size / weight the sources that reach their limit come first, so running sums find the level at
    which the rest share what is left. One row per source meets in a window here, never documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    limit = F.col("source_size") * most
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    out = out.withColumns({"limit": limit, "ratio": limit / F.col("weight"), "all": F.sum("source_size").over(Window.partitionBy()) * share})
    level = (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level).withColumn("full", F.col("ratio") < F.col("level"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.least(shared * F.col("weight"), F.col("limit").cast("double")))
    return out.withColumn("target", target).withColumn("budget", F.round("target").cast("bigint")).select("source", "source_size", "n", "target", "budget")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken, the words that the mix takes of each document, repeats counted.

    Whole epochs are taken of a source while its budget lasts, then documents in the order of their keys, the last one
    in part. Null texts and texts without words have size 0 and nothing taken. A null source is a source, the last one.
    Rows that repeat each other share a key and follow one another, so what they take together is defined, and which of
    them is cut is the same to any reader. Reruns agree. Long texts are counted whole. Empty tables stay empty. Columns named
    size, source_size, target and taken are replaced, others pass through whatever their names.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(c for c in dict.fromkeys(["doc_id", source, text]) if c in docs.columns)), 1)
    keyed = docs.withColumns({"size": size_of(F.col(text)), "__key": key})
    small = settle(keyed.select(F.col(source).alias("source"), "size", "__key"))
    per_source = targets(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    per_source = per_source.select(F.col("source").alias("__source"), "source_size", "target", F.ceil(F.sqrt("n")).alias("__n"), F.col("budget").alias("__budget"))
    in_range = F.floor(F.col("__key") / F.lit(float(2**63)) * F.col("__n"))
    ranged = small.join(per_source.select("__source", "__n"), F.col("source").eqNullSafe(F.col("__source"))).withColumn("range", in_range)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__s"), F.col("range").alias("__r"), F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("__before"))
    keyed = keyed.drop("source_size", "target", "taken").join(per_source, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__range", in_range)
    within = Window.partitionBy(source, "__range").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(sums, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("__budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("__budget") - epochs * F.col("source_size") - F.col("__before") - F.col("__within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.withColumn("taken", taken.cast("bigint")).drop("__key", "__range", "__within", "__before", "__s", "__r", "__source", "__n", "__budget")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents that the mix takes something of, with what it takes, and all columns of docs.

    As for mix_sources(): null and empty texts go, as nothing is taken of them; rows that repeat each other are judged one
    by one; columns of its own names are replaced, others pass through; an empty table stays empty.
    """
    return mix_sources(docs).where("taken > 0")


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
