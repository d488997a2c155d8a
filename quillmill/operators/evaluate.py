"""Test cases for spelling correction, and what their results say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillmill.functions.distance import ALPHABET, VOWELS, substitutions, typo


def sample_words(vocabulary: DataFrame, n: int = 500, seed: int = 7) -> DataFrame:
    """Up to n words of a vocabulary, without replacement, chosen by a hash."""
    return vocabulary.orderBy(F.md5(F.concat("word", F.lit(f":{seed}"))), "word").limit(n)


def with_typos(words: DataFrame, rate: float = 0.5, seed: int = 7) -> DataFrame:
    """(original, error_word, error_type)."""
    return words.select(F.col("word").alias("original"), typo(F.col("word"), rate, seed).alias("t")).select("original", "t.*")


def judged(cases: DataFrame, predicted: str, expected: str) -> DataFrame:
    """cases with status PASS or FAIL; no prediction is no match, unless none is expected."""
    return cases.withColumn("status", F.when(F.col(predicted).eqNullSafe(F.col(expected)), "PASS").otherwise("FAIL"))


def accuracy(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, passed and accuracy in percent, of all or by group; null without cases."""
    passed = F.count_if(F.col("status") == "PASS")
    return results.groupBy(*(by or [])).agg(F.count("*").alias("total"), passed.alias("passed"), (100.0 * passed / F.nullif(F.count("*"), F.lit(0))).alias("accuracy"))


def error_accuracy(results: DataFrame) -> DataFrame:
    """total cases, errors among them, how many of these were corrected, and accuracy over errors in percent: 0 without errors. Correct words count for nothing."""
    wrong = F.coalesce(F.col("error_type") != "correct", F.lit(True))
    fixed = F.count_if(wrong & (F.col("status") == "PASS"))
    share = F.when(F.count_if(wrong) > 0, 100.0 * fixed / F.count_if(wrong)).otherwise(F.lit(0.0))
    return results.agg(F.count("*").alias("total"), F.count_if(wrong).alias("errors"), fixed.alias("corrected"), share.alias("accuracy"))


def distribution(cases: DataFrame, by: str) -> DataFrame:
    """(by, count, percent of all)."""
    return cases.groupBy(by).agg(F.count("*").alias("count")).withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def error_confusion(results: DataFrame) -> DataFrame:
    """(actual, predicted, count): error types against whether they were corrected."""
    return results.groupBy(F.col("error_type").alias("actual"), F.when(F.col("status") == "PASS", "correct").otherwise("incorrect").alias("predicted")).agg(F.count("*").alias("count"))


def char_confusion(cases: DataFrame) -> DataFrame:
    """(error_char, correct_char, count) over cases of substitution."""
    pairs = cases.where("error_type = 'substitution'").select(F.explode(substitutions(F.col("error_word"), F.col("original"))).alias("p")).select("p.*")
    return pairs.groupBy("error_char", "correct_char").agg(F.count("*").alias("count"))


def top_confusions(confusion: DataFrame, k: int) -> DataFrame:
    """The k most frequent pairs with rank and percent of all."""
    total = confusion.agg(F.sum("count").alias("total"))
    top = confusion.orderBy(F.desc("count"), "error_char", "correct_char").limit(k).crossJoin(F.broadcast(total))  # one row
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "error_char", "correct_char"))
    return top.select(rank.alias("rank"), "error_char", "correct_char", "count", (100.0 * F.col("count") / F.col("total")).alias("percent"))


def confusion_totals(confusion: DataFrame) -> DataFrame:
    """total_substitutions and unique_character_pairs, one row."""
    return confusion.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_substitutions"), F.count("*").alias("unique_character_pairs"))


def vowel_consonant(confusion: DataFrame) -> DataFrame:
    """Substitutions by kind of letter, and shares of errors in vowels and consonants."""
    kind = lambda c: F.when(F.contains(F.lit(VOWELS), F.col(c)), "vowel").otherwise("consonant")
    e, c = kind("error_char"), kind("correct_char")
    n = lambda a, b: F.coalesce(F.sum(F.when((e == a) & (c == b), F.col("count"))), F.lit(0)).cast("bigint")
    share = lambda a: 100.0 * F.coalesce(F.sum(F.when(e == a, F.col("count"))), F.lit(0)) / F.nullif(F.sum("count"), F.lit(0))
    return confusion.agg(
        n("vowel", "vowel").alias("vowel_to_vowel"), n("vowel", "consonant").alias("vowel_to_consonant"), n("consonant", "vowel").alias("consonant_to_vowel"), n("consonant", "consonant").alias("consonant_to_consonant"),
        share("vowel").alias("vowel_percent"), share("consonant").alias("consonant_percent"))


def char_marginals(confusion: DataFrame) -> DataFrame:
    """(role, letter, count): each letter as the error and as the correct one."""
    both = F.explode(F.array(F.struct(F.lit("error").alias("role"), F.col("error_char").alias("letter")), F.struct(F.lit("correct").alias("role"), F.col("correct_char").alias("letter"))))
    return confusion.select("count", both.alias("b")).groupBy("b.role", "b.letter").agg(F.sum("count").alias("count"))


def ordered_letters(confusion: DataFrame) -> DataFrame:
    """(position, letter): the letters that occur, those of the alphabet in its order, then others by code point."""
    letters = confusion.select(F.col("error_char").alias("letter")).union(confusion.select("correct_char")).distinct()
    known = F.instr(F.lit(ALPHABET), F.col("letter"))
    order = Window.orderBy(F.when(known > 0, known).otherwise(len(ALPHABET) + 1), "letter")
    return letters.select((F.row_number().over(order) - 1).alias("position"), "letter")


def dense(confusion: DataFrame, row: str, column: str) -> DataFrame:
    """A count for every pair of labels that occur as either, 0 where there is none: labels are letters or error types, few for any input. Rows come by row and column label."""
    labels = confusion.select(F.col(row).alias("label")).union(confusion.select(column)).distinct()
    every = labels.select(F.col("label").alias(row)).crossJoin(labels.select(F.col("label").alias(column)))
    return every.join(confusion, [row, column], "left").select(row, column, F.coalesce("count", F.lit(0)).cast("bigint").alias("count")).orderBy(row, column)


def precision(confusion: DataFrame) -> DataFrame:
    """Errors in all, fixed and not, and the share fixed in percent. Correct words that were changed count as not fixed."""
    fixed = F.coalesce(F.sum(F.when((F.col("predicted") == "correct") & (F.col("actual") != "correct"), F.col("count"))), F.lit(0)).cast("bigint")
    wrong = F.coalesce(F.sum(F.when(F.col("predicted") == "incorrect", F.col("count"))), F.lit(0)).cast("bigint")
    errors = F.coalesce(F.sum(F.when((F.col("actual") != "correct") | (F.col("predicted") != "correct"), F.col("count"))), F.lit(0)).cast("bigint")
    return confusion.agg(errors.alias("errors"), fixed.alias("fixed"), wrong.alias("not_fixed"), (100.0 * fixed / F.nullif(fixed + wrong, F.lit(0))).alias("precision"))
