"""Gathering: links and texts of wiki responses, quality filter, merging without duplicates, cleaning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillmill.functions.clean import clean_text, clean_wikitext, cleaned, long_enough
from quillmill.functions.text import url_path

#: Prefixes of pages that are no texts.
OTHER_PAGES = ("Kateqoriya:", "Şəkil:", "Author:")
LINKS = "struct<parse:struct<links:array<struct<ns:int,`*`:string>>>>"
TEXTS = "struct<parse:struct<wikitext:struct<`*`:string>>,error:struct<code:string,info:string>>"


def link_titles(responses: DataFrame, author: str = "author", body: str = "body") -> DataFrame:
    """(author, title): the pages that an author's page links to, from its JSON."""
    links = responses.select(F.col(author).alias("author"), F.explode(F.from_json(body, LINKS)["parse"]["links"]).alias("link"))
    title = F.col("link")["*"]
    named = links.where((F.col("link.ns") == 0)).select("author", title.alias("title"))
    for prefix in OTHER_PAGES:
        named = named.where(~F.col("title").startswith(prefix))
    return named


def page_texts(responses: DataFrame, body: str = "body", base: str = "https://example.org/wiki/") -> DataFrame:
    """responses (author, title, body) as (author, title, url, text, error): cleaned texts, or the error of the response."""
    parsed = responses.withColumn("__p", F.from_json(body, TEXTS))
    error = F.coalesce(F.concat_ws(": ", F.col("__p.error.code"), F.col("__p.error.info")), F.lit(""))
    failed = F.when(F.col("__p.error.code").isNotNull(), error).when(F.col("__p.parse.wikitext").isNull(), "no text")
    return parsed.select("author", "title", F.concat(F.lit(base), url_path("title")).alias("url"), F.when(failed.isNull(), clean_wikitext(F.col("__p.parse.wikitext")["*"])).alias("text"), failed.alias("error"))


def keep_long(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(long_enough(F.col(text)))


def new_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of new the first row of each key that existing lacks. Null keys are equal to each other.

    The first row of a key is found by a pre-aggregated minimum, so a key with very many rows meets in no task.
    """
    def same(a: str, b: str):
        return reduce(lambda p, q: p & q, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])

    first = new.groupBy(*keys).agg(F.min(order).alias("__first")).alias("f")
    fresh = first.join(existing.select(*keys).distinct().alias("e"), same("f", "e"), "left_anti").alias("f")
    return new.alias("n").join(fresh, same("n", "f") & F.col(f"n.{order}").eqNullSafe(F.col("f.__first"))).select("n.*")


def merge_new(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All of existing and the new rows."""
    return existing.unionByName(new_rows(existing, new, keys, order))


def clean_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text cleaned, and template_removed and toc_removed."""
    out = docs.withColumn("__c", clean_text(F.col(text)))
    return out.withColumns({text: F.col("__c.text"), "template_removed": F.col("__c.template_removed"), "toc_removed": F.col("__c.toc_removed")}).drop("__c")


def cleaning_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """How many rows cleaning changes, and how. Texts are cleaned in Python, where they stand: as an expression each lambda is worked out for each line."""
    names = ("changed_rows", "template_removed_rows", "toc_removed_rows", "empty_after_cleaning")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(0)]
            found = [(now != t, template, toc, not now.strip()) for t in texts for now, template, toc in [cleaned(t)]]
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), *(pa.array([sum(r[i] for r in found)], pa.int64()) for i in range(len(names)))], ["n_rows", *names])

    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(rows, ", ".join(f"{c} bigint" for c in ("n_rows", *names)))
    return counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", *names)))


def numbered(docs: DataFrame, order: str, name: str = "row") -> DataFrame:
    """docs with a number from 0 in the order of a column; for tables whose order has no key. One sorted window."""
    return docs.withColumn(name, F.row_number().over(Window.orderBy(order)) - 1)
