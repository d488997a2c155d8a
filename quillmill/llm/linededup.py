"""Line deduplication by overlapping windows of three lines.

A window is three consecutive lines that hold something besides white space. Windows are hashed, those that occur more
than once anywhere are found by a pre-aggregated count, and of each the first occurrence, by document and line, stays.
The positions that later occurrences cover, blank lines between included, are merged and cut out; where a later occurrence
overlaps the first one of the same window, the lines of the first stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.functions.text import let

#: Lines in a window.
WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """(place, line) of the lines that hold something, counted from 0."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def _windows(full: Column) -> Column:
    """Of filled lines: (first, last, k1, k2) of each window; k1 and k2 make a 128-bit hash.

    full must be a plain column: what a lambda refers to is computed again for every element.
    """
    at = lambda j, o, f: F.get(full, j + o)[f]

    def one(j: Column) -> Column:
        three = [at(j, o, "x") for o in range(WINDOW)]
        return F.struct(at(j, 0, "i").alias("first"), at(j, WINDOW - 1, "i").alias("last"), F.xxhash64(*three).alias("k1"), F.xxhash64(F.lit(WINDOW), *three[::-1]).alias("k2"))

    some = F.sequence(F.lit(0), F.size(full) - WINDOW)
    return F.when(F.size(full) >= WINDOW, F.transform(some, one)).otherwise(F.array().cast("array<struct<first:int,last:int,k1:bigint,k2:bigint>>"))


def _without(lines: Column, cuts: Column) -> Column:
    """lines without the positions that cuts cover, in time that grows with both and not with their product."""
    gone = F.flatten(F.transform(cuts, lambda c: F.sequence(c["first"], c["last"])))
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
    return let(lines, lambda x: F.transform(left(x), lambda i: F.get(x, i)))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the text cut, and n_lines and n_removed (long) added or replaced.

    Null texts stay null, with no lines; texts of fewer than three filled lines stay as they are; an empty text has one
    line. A document is known by its id and text: rows that repeat both are one document and are cut alike, and a null id
    comes before all others. Within a document a later window may overlap the first: the lines of the first
    stay, the others of the later one go. Long texts are handled whole, other columns pass through, empty tables stay empty.
    """
    keyed = docs.withColumn("__print", F.xxhash64(text))
    filled = keyed.select(F.col(doc_id).alias("__id"), "__print", _filled(lines_of(F.col(text))).alias("full"))
    windows = filled.select("__id", "__print", F.explode_outer(_windows(F.col("full"))).alias("w")).select("__id", "__print", "w.*").where("first IS NOT NULL")
    place = F.struct("__id", "__print", "first", "last")
    # Repeated rows have equal places: a window counts as repeated only if it has two of them.
    repeated = windows.groupBy("k1", "k2").agg(F.min(place).alias("kept"), F.max(place).alias("other")).where("kept <> other").drop("other")
    later = windows.join(repeated, ["k1", "k2"]).where(place != F.col("kept"))
    mine = F.col("__id").eqNullSafe(F.col("kept.__id")) & F.col("__print").eqNullSafe(F.col("kept.__print"))
    start = F.when(mine, F.greatest(F.col("first"), F.col("kept.last") + 1)).otherwise(F.col("first"))
    cuts = later.groupBy("__id", "__print").agg(F.collect_set(F.struct(start.alias("first"), "last")).alias("__cuts"))
    same = F.col(doc_id).eqNullSafe(F.col("c.__id")) & F.col("d.__print").eqNullSafe(F.col("c.__print"))
    out = keyed.alias("d").join(cuts.alias("c"), same, "left").drop(F.col("c.__id"), F.col("c.__print"))
    out = out.withColumn("__lines", F.when(F.col("__cuts").isNotNull(), lines_of(F.col(text))))
    out = out.withColumn("__left", F.when(F.col("__cuts").isNotNull(), _without(F.col("__lines"), F.col("__cuts"))))
    n = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    out = out.withColumns({"n_lines": n, "n_removed": F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("bigint")})
    out = out.withColumn(text, F.when(F.col("__left").isNull(), F.col(text)).otherwise(F.array_join("__left", "\n")))
    return out.drop("__print", "__cuts", "__lines", "__left")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated passages, as dedup_lines() cuts them; documents of which nothing is left go.

    Null and empty texts stay as they are; rows that repeat id and text are cut alike; ties and null ids are as there; an
    empty table stays empty. n_chars, if there, follows the text; other columns of docs stay, whatever their names.
    """
    kept = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns})
    out = dedup_lines(kept).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"__own_{c}").alias(c) if c in ("n_lines", "n_removed") else F.col(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
filled AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
wins AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT *, row_number() OVER p AS k, first_value(doc_id) OVER p AS kept_in, first_value(b) OVER p AS kept_to
  FROM wins WHERE b IS NOT NULL WINDOW p AS (PARTITION BY l1, l2, l3 ORDER BY doc_id, a)),
gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM lines l
  JOIN ranked r ON r.doc_id = l.doc_id AND r.k > 1 AND l.i BETWEEN (CASE WHEN kept_in = r.doc_id THEN greatest(r.a, kept_to + 1) ELSE r.a END) AND r.b),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
