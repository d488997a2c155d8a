"""Token statistics, vocabulary growth and the fit of Heaps' law."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, TimestampNTZType, TimestampType

from quillmill.functions.text import filled, strip, tokenize


#: Steps of the growth curve that are summed at once, and ranges of documents, a power of two.
BLOCK, RANGES = 4096, 1024


def occurrences(docs: DataFrame, text: str, order: str, tokens: Callable[[str], Column] = tokenize) -> DataFrame:
    """(order, pos, token): every token, placed in its document from 0."""
    return docs.select(F.col(order).alias("doc"), F.posexplode(tokens(text)).alias("pos", "token"))


def first_place(docs: DataFrame, order: str) -> tuple[Column, Callable[[Column], Column]]:
    """The smallest (doc, pos) of occurrences as an aggregate, and what makes the struct of it.

    Ids of 32 bits, none null, and places go into one number: Spark then counts in a hash map, while a struct makes it sort all
    tokens. Other keys keep the struct.
    """
    kind = docs.schema[order].dataType
    if isinstance(kind, IntegralType):
        least, most, n, known = docs.agg(F.min(order), F.max(order), F.count("*"), F.count(order)).first()
        if n == known and (not n or (-(1 << 31) <= least and most < 1 << 31)):
            whole = lambda c: F.struct(F.shiftright(c, 32).cast(kind).alias("doc"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
            return F.min(F.shiftleft(F.col("doc").cast("bigint"), 32) + F.col("pos")), whole
    return F.min(F.struct("doc", "pos")), lambda c: c


def token_frequencies(docs: DataFrame, text: str = "text", tokens: Callable[[str], Column] = tokenize) -> DataFrame:
    """(token, frequency)."""
    return docs.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))


def ranked_tokens(docs: DataFrame, k: int, text: str = "text", order: str = "doc_id", last: bool = False) -> DataFrame:
    """The k most or, with last, least frequent tokens with their place among those; ties by first occurrence.

    The limit is met by a top-k in each partition, so no task sorts the vocabulary.
    """
    first, _ = first_place(docs, order)
    counted = occurrences(docs, text, order).groupBy("token").agg(F.count("*").alias("frequency"), first.alias("first"))
    keys = [F.asc("frequency"), F.desc("first")] if last else [F.desc("frequency"), F.asc("first")]
    top = counted.orderBy(*keys).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*keys)).alias("rank"), "token", "frequency")


def token_stats(docs: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """n_rows, total_tokens, unique_types and type_token_ratio, of all or by group. Tokens are counted before they meet; a null stands for each row, so texts are read once."""
    by = by or []
    tokens = docs.select(*by, F.explode(F.concat(F.array(F.lit(None).cast("string")), tokenize(text))).alias("token"))
    counted = tokens.groupBy(*by, "token").agg(F.count("*").alias("n"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    out = counted.groupBy(*by).agg(some(F.col("token").isNull()).alias("n_rows"), some(F.col("token").isNotNull()).alias("total_tokens"), F.count("token").alias("unique_types"))
    return out.withColumn("type_token_ratio", F.when(F.col("total_tokens") > 0, F.col("unique_types") / F.col("total_tokens")))


def corpus_profile(docs: DataFrame, text: str = "text", group: str = "source") -> DataFrame:
    """Rows, groups, characters and how many rows have a text."""
    return docs.agg(
        F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("n_chars"),
        F.count_if(strip(filled(text)) != "").alias("n_filled"), F.max(F.length(text)).cast("bigint").alias("longest"))


def vocabulary_growth(docs: DataFrame, step: int = 1000, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(tokens, types, log_tokens, log_types) after each step tokens of the corpus in order, and at its end.

    A token's place is its place in the document plus the tokens before that. Those are summed in two turns, within and
    over ranges of about as many documents each, so that no window holds the corpus, however ids are spread; of each token only the first place matters, counted by
    steps, and steps are summed in two turns again. What meets in one window in the end is a row for each BLOCK of steps.
    """
    counted = docs.select(F.col(order).alias("doc"), tokenize(text).alias("tokens"))
    per_doc = counted.groupBy("doc").agg(F.sum(F.size("tokens")).alias("n"))
    if not isinstance(docs.schema[order].dataType, NumericType | DateType | TimestampType | TimestampNTZType):
        raise TypeError(f"{order} must be a number, a date or a time")
    bounds = per_doc.agg(F.percentile_approx("doc", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("bounds"))
    step_of = lambda at, s: F.when(F.get("bounds", at + s - 1) < F.col("doc"), at + s).otherwise(at)
    part = F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(RANGES.bit_length() - 1)))), F.lit(0), step_of)
    placed = per_doc.crossJoin(F.broadcast(bounds)).withColumn("part", part).drop("bounds")  # bounds is one row
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select("doc", (F.col("base") + F.col("inner")).alias("offset"))
    least, whole = first_place(docs, order)
    first = counted.select("doc", F.posexplode("tokens").alias("pos", "token")).groupBy("token").agg(least.alias("first")).select(whole(F.col("first")).alias("first"))
    steps = first.select(F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos")).join(offsets, "doc").groupBy(F.ceil((F.col("offset") + F.col("pos") + 1) / step).alias("bucket")).agg(F.count("*").alias("fresh"))
    total = parts.select("total").distinct().withColumn("steps", F.ceil(F.col("total") / step))
    blocks = total.select("*", F.explode(F.when(F.col("total") > 0, F.sequence(F.lit(0), F.floor((F.col("steps") - 1) / BLOCK)))).alias("block"))
    bucket = F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least((F.col("block") + 1) * BLOCK, F.col("steps"))))
    every = blocks.repartition("block").select("total", "block", bucket.alias("bucket")).join(steps, "bucket", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.groupBy("block").agg(F.sum("fresh").alias("m")).select("block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = every.withColumn("own", F.sum("fresh").over(upto)).join(sums, "block").select(F.least(F.col("bucket") * step, F.col("total")).alias("tokens"), (F.col("before") + F.col("own")).alias("types"))
    return out.withColumns({"log_tokens": F.ln("tokens"), "log_types": F.ln("types")})


def fit_line(points: DataFrame, x: str, y: str) -> DataFrame:
    """(intercept, slope, r2, n) of least squares; r2 is null where y does not vary."""
    return points.agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).alias("r2"), F.count("*").alias("n"))


def fit_heaps(points: DataFrame) -> DataFrame:
    """(k, beta, r2, num_points) of types = k * tokens ** beta, from growth points."""
    valid = points.where("tokens > 0 AND types > 0")
    return fit_line(valid, "log_tokens", "log_types").select(F.exp("intercept").alias("k"), F.col("slope").alias("beta"), "r2", F.col("n").alias("num_points"))


def predict_heaps(points: DataFrame, fit: DataFrame) -> DataFrame:
    """points with the types that the fit, one row, predicts."""
    return points.crossJoin(F.broadcast(fit.select("k", "beta"))).select("tokens", "types", (F.col("k") * F.pow("tokens", F.col("beta"))).alias("predicted"))


def vocabulary(docs: DataFrame, tokens: Callable[[str], Column], text: str = "text", least_count: int = 1, least_length: int = 1) -> DataFrame:
    """(word, freq) of normalised words, bounded from below by count and length."""
    counted = token_frequencies(docs, text, tokens).select(F.col("token").alias("word"), F.col("frequency").alias("freq"))
    return counted.where((F.col("freq") >= least_count) & (F.length("word") >= least_length))
