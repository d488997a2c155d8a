"""Queries through files: what is written as tables, reports, CSV, lines and error logs comes back the same.

Each writes to a folder of its own in the shared one, over what an earlier run has left there, and reads that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.operators import corpus, segments
from quillmill.plans import corpus as corpus_plans, language
from quillmill.plans.common import read, strip_sql, values_sql
from quillmill.sources import files, wiki
from quillmill.sources.shared import remove, shared_dir
from quillmill.streaming import enrich


def _folder(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/query-{name}"
    remove(spark, path)
    return path


def _csv(spark, sf_dir) -> DataFrame:
    path = _folder(spark, "csv")
    points = corpus.vocabulary_growth(read(spark, sf_dir, "documents", "doc_id", "text"))
    files.write_csv(points, path, "tokens")
    return files.read_csv(spark, path, files.GROWTH_POINTS).select("tokens", "types", F.round("log_tokens", 6).alias("log_tokens"), F.round("log_types", 6).alias("log_types"))


def _report(spark, sf_dir) -> DataFrame:
    path = _folder(spark, "report")
    files.write_report(corpus.token_stats(read(spark, sf_dir, "documents", "text")), path)
    return files.read_json(spark, path, "n_rows bigint, total_tokens bigint, unique_types bigint, type_token_ratio double").withColumn("type_token_ratio", F.round("type_token_ratio", 6))


def _tests(spark, sf_dir) -> DataFrame:
    """Spelling tests, a bounded sample of words, as one JSON array; the correct ones without a type."""
    path = _folder(spark, "tests")
    rows = language._cases(spark, sf_dir).select(F.col("error_word").alias("input"), F.col("original").alias("expected"), F.when(F.col("error_type") != "correct", F.col("error_type")).alias("type"))
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return files.read_tests(spark, path)


def _table(spark, sf_dir) -> DataFrame:
    """A table that is written, replaced by a swap, and read; one that is not there is empty."""
    path = _folder(spark, "table")
    docs = read(spark, sf_dir, "documents", "doc_id", "source")
    files.write_table(docs.limit(1), f"{path}/now")
    files.write_table(docs, f"{path}/fresh")
    files.swap(spark, f"{path}/fresh", f"{path}/now")
    missing = files.read_table(spark, f"{path}/none", "doc_id bigint, source string")
    return files.read_table(spark, f"{path}/now", "doc_id bigint, source string").unionByName(missing)


def _errors(spark, sf_dir) -> DataFrame:
    """Rows that a model fails on, appended to a log in two lots."""
    def model(text: str) -> str:
        raise ValueError(f"{len(text)}")

    path = _folder(spark, "errors")
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    for odd in (0, 1):
        files.append_errors(enrich.enrich(docs.where(F.abs(F.col("doc_id")) % 2 == odd), model, "doc_id", "text", tries=1).select("doc_id", "error"), path)
    return spark.read.schema("doc_id bigint, error string").json(path)


def _part(spark, sf_dir) -> DataFrame:
    """Rows 50 to 89 in the order of the key."""
    return enrich.pending(read(spark, sf_dir, "documents", "doc_id", "source"), spark.createDataFrame([], "doc_id bigint, value string"), "doc_id", start=50, limit=40)


QUERIES = {
    "author_list": lambda s, d: wiki.authors(s),
    "csv_points": _csv,
    "report_file": _report,
    "tests_file": _tests,
    "swapped_table": _table,
    "error_log": _errors,
    "offset_and_limit": _part,
    "segmentation_nested": lambda s, d: segments.nested(segments.statistics(corpus_plans._measures(s, d))).select(*(F.col("report")["original"][m]["total_segments"].alias(m) for m in segments.SEGMENTERS), F.size("report").alias("text_types")),
    "segmentation_markdown": lambda s, d: segments.markdown(segments.statistics(corpus_plans._measures(s, d))),
}

_STATS = corpus_plans.ORACLE_SQL["segmentation_stats"]
ORACLE_SQL = {
    "author_list": f"SELECT place::INT AS place, author FROM {values_sql(list(enumerate(wiki.AUTHORS)), 'place', 'author')}",
    "csv_points": corpus_plans.ORACLE_SQL["vocab_growth"],
    "report_file": f"SELECT n_rows, total_tokens, unique_types, round(type_token_ratio, 6) AS type_token_ratio FROM ({corpus_plans.ORACLE_SQL['token_stats']})",
    "tests_file": f"WITH {language.FREQUENT}, {language.CASES} SELECT error_word AS input, original AS expected, CASE error_type WHEN 'correct' THEN 'unknown' ELSE error_type END AS type FROM cases",
    "swapped_table": "SELECT doc_id, source FROM documents",
    "error_log": f"SELECT doc_id, 'ValueError: ' || length(text) AS error FROM documents WHERE {strip_sql('text')} <> ''",
    "offset_and_limit": "SELECT doc_id, source FROM documents WHERE doc_id >= 50 ORDER BY doc_id LIMIT 40",
    "segmentation_nested": f"SELECT {', '.join(f'''max(total_segments) FILTER (text_type = 'original' AND method = '{m}') AS {m}''' for m in segments.SEGMENTERS)}, count(DISTINCT text_type)::INT AS text_types FROM ({_STATS})",
    "segmentation_markdown": f"""
        SELECT 0 AS line, '| text | method | texts | segments | characters |' AS value UNION ALL SELECT 1, '|---|---|---|---|---|'
        UNION ALL SELECT 1 + row_number() OVER (ORDER BY text_type, method), '| ' || text_type || ' | ' || method || ' | ' || total_texts || ' | ' || total_segments || ' | ' || total_chars || ' |' FROM ({_STATS})""",
}
