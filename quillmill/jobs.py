"""Jobs with parameters: python -m quillmill.jobs NAME --input TABLE --out-dir FOLDER [...].

Each reads one Parquet table and writes its results to the output folder: tables as Parquet, reports as JSON. Input and
output are paths that Spark reads; on a cluster they must be in storage that all machines share.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.functions.text import normalised_tokens
from quillmill.operators import bpe, corpus, ingest, segments, spell
from quillmill.sources.files import read_table, read_tests, require_columns, write_lines, write_report, write_table


def tokens(docs: DataFrame, given: argparse.Namespace) -> None:
    """token_frequencies and token_stats."""
    write_table(corpus.token_frequencies(docs, given.text_col), f"{given.out_dir}/token_frequencies")
    write_report(corpus.token_stats(docs, text=given.text_col), f"{given.out_dir}/token_stats")


def heaps(docs: DataFrame, given: argparse.Namespace) -> None:
    """heaps_points and heaps_fit."""
    path = f"{given.out_dir}/heaps_points"
    write_table(corpus.vocabulary_growth(docs, given.step, given.text_col, given.key), path)
    write_report(corpus.fit_heaps(docs.sparkSession.read.parquet(path)), f"{given.out_dir}/heaps_fit")


def pairs(docs: DataFrame, given: argparse.Namespace) -> None:
    """bpe_merges, the table with bpe_text, bpe_vocab and bpe_stats."""
    spark = docs.sparkSession
    merges = bpe.learn(bpe.word_vocabulary(docs, given.text_col, given.key), given.vocab_size, given.min_pair_freq)
    write_lines(bpe.merge_lines(bpe.merge_table(spark, merges)), f"{given.out_dir}/bpe_merges")
    write_table(bpe.apply_merges(docs, merges, given.text_col, given.key), f"{given.out_dir}/bpe_texts")
    coded = spark.read.parquet(f"{given.out_dir}/bpe_texts")
    write_table(bpe.vocabulary_ids(coded), f"{given.out_dir}/bpe_vocab")
    write_report(corpus.token_stats(coded, text="bpe_text").withColumn("num_merges", F.lit(len(merges))), f"{given.out_dir}/bpe_stats")


def clean(docs: DataFrame, given: argparse.Namespace) -> None:
    """cleaned texts and cleaning_report."""
    write_table(ingest.clean_column(docs, given.text_col).select(*docs.columns), f"{given.out_dir}/cleaned")
    write_report(ingest.cleaning_report(docs, given.text_col), f"{given.out_dir}/cleaning_report")


def cut(docs: DataFrame, given: argparse.Namespace) -> None:
    """segmentation_statistics."""
    write_report(segments.statistics(segments.measured(segments.segmented(docs, {given.text_col: given.text_col}, given.key), given.key)).agg(F.collect_list(F.struct("*")).alias("methods")), f"{given.out_dir}/segmentation_statistics")


def spelling(docs: DataFrame, given: argparse.Namespace) -> None:
    """spelling_results: the tests of a JSON file against the words of the table."""
    tests = read_tests(docs.sparkSession, given.tests)
    found = spell.correct(tests.select(F.col("input").alias("word")), corpus.vocabulary(docs, normalised_tokens, given.text_col), given.max_distance)
    write_table(tests.join(found.withColumnRenamed("word", "input"), "input", "left"), f"{given.out_dir}/spelling_results")


#: Name, job, and parameters of its own with their defaults.
JOBS: dict[str, tuple[Callable[[DataFrame, argparse.Namespace], None], dict]] = {
    "tokens": (tokens, {}),
    "heaps": (heaps, {"step": 1000, "key": "doc_id"}),
    "bpe": (pairs, {"vocab_size": 10_000, "min_pair_freq": 2, "key": "doc_id"}),
    "clean": (clean, {}),
    "segments": (cut, {"key": "doc_id"}),
    "spelling": (spelling, {"tests": "", "max_distance": 4}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillmill.jobs", description=__doc__.split("\n")[0])
    names = out.add_subparsers(dest="job", required=True)
    for name, (job, own) in JOBS.items():
        one = names.add_parser(name, help=job.__doc__)
        one.add_argument("--input", required=True)
        one.add_argument("--out-dir", required=True)
        one.add_argument("--text-col", default="text")
        for key, value in own.items():
            one.add_argument(f"--{key.replace('_', '-')}", type=type(value), default=value)
    return out


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs one job. Columns that it needs are asked for before any work."""
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"quillmill {given.job}").getOrCreate()
    needed = [given.text_col, *([given.key] if hasattr(given, "key") else [])]
    JOBS[given.job][0](require_columns(read_table(spark, given.input), needed, given.input), given)


if __name__ == "__main__":
    main()
