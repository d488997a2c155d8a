"""Spelling correction against a vocabulary, in tiers: exact, look-alike letters, edit distance.

Each tier sees only the words that the tiers before it left. Distances are searched by pieces of words: of two words
within k edits one has, cut to k + 1 pieces, a piece that stands unchanged in the other, near its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmill.functions.distance import folded, variants, weighted_distance
from quillmill.functions.text import az_lower, normalised_tokens, preserve_case, strip
from quillmill.sources.shared import settle


#: The type of the alternatives in an answer.
ANSWERS = "array<struct<word:string,distance:double,frequency:bigint>>"
#: Edits within which a word is sought first, and how many alternatives are listed.
NEAR, LISTED = 2, 5


def exact(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """queries (word, low) that the vocabulary has: (word, low, correction, distance, freq)."""
    return queries.join(vocabulary.select(F.col("word").alias("low"), "freq"), "low").select("word", "low", F.col("low").alias("correction"), F.lit(0.0).alias("distance"), "freq")


def by_variant(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The most frequent word that is the query with one look-alike letter exchanged; ties by word. The query's forms are probed: the exchange is its own inverse."""
    forms = queries.select("word", "low", F.explode(variants(F.col("low"))).alias("form"))
    hits = forms.join(vocabulary.select(F.col("word").alias("form"), "freq"), "form")
    best = hits.groupBy("word", "low").agg(F.min(F.struct((-F.col("freq")).alias("less"), "form")).alias("b"))
    return best.select("word", "low", F.col("b.form").alias("correction"), F.lit(0.5).alias("distance"), (-F.col("b.less")).alias("freq"))


def _parts(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _piece(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Place, from 0, and length of the i-th of the k + 1 pieces of a word; the later ones are the longer ones where they differ."""
    size = F.floor(length / (k + 1)).cast("int")
    shorter = k + 1 - length % (k + 1)
    return size * i + F.greatest(F.lit(0), i - shorter), size + F.when(F.lit(i) >= shorter, 1).otherwise(0)


def _letters(word: Column) -> Column:
    return F.transform(F.array_distinct(F.filter(F.split(word, "", -1), lambda x: x != "")), lambda x: F.struct(F.lit(-1).alias("i"), x.alias("piece")))


def _listed(word: Column, k: int) -> Column:
    """(i, piece) under which a word is found: its k + 1 pieces; of a word too short for them its letters, and one for any."""
    pieces = [F.struct(F.lit(i).alias("i"), F.substring(word, at + 1, n).alias("piece")) for i in range(k + 1) for at, n in [_piece(F.length(word), i, k)]]
    return F.when(F.length(word) > k, F.array(*pieces)).otherwise(F.concat(_letters(word), F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("piece")))))


def _probes(word: Column, length: Column, k: int) -> Column:
    """(i, piece) by which all words of a length within k edits are found.

    If the i-th piece is the first that stands unchanged, i edits at most are before it and k - i after: that bounds how far
    it may have moved. A word too short for pieces shares a letter with any that is longer than k; with others it may share nothing.
    """
    own, some = F.length(word), []
    for i in range(k + 1):
        at, n = _piece(length, i, k)
        for d in range(-i, i + 1):
            fits = (F.abs(own - length - d) <= k - i) & (at + d >= 0) & (at + d + n <= own)
            some.append(F.when(fits, F.struct(F.lit(i).alias("i"), F.substring(word, at + d + 1, n).alias("piece"))))
    short = F.when(own > k, _letters(word)).otherwise(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("piece"))))
    return F.when(length > k, F.array_distinct(F.array_compact(F.array(*some)))).otherwise(short)


def candidates(queries: DataFrame, vocabulary: DataFrame, radius: float, measure=None, fold=None, once: bool = True) -> DataFrame:
    """(word, low, candidate, freq, distance) of all vocabulary words within radius, found by their pieces; once unless told otherwise.

    measure gives the distance of low and candidate, Levenshtein's by default. Levenshtein's distance of folded words must
    bound it from below.
    """
    k, fold = int(radius), fold or (lambda c: c)
    lengths = F.sequence(F.greatest(F.lit(1), F.length("a") - k), F.length("a") + k)
    asked = queries.select("word", "low", fold(F.col("low")).alias("a")).withColumn("len", F.explode(F.when(F.length("a") + k >= 1, lengths)))
    wanted = asked.select("word", "low", "a", "len", F.explode(_probes(F.col("a"), F.col("len"), k)).alias("p")).select("word", "low", "a", "len", "p.*")
    # Each word may be held against many: the vocabulary is dealt out evenly first, as its bytes would not make Spark do so.
    dealt = vocabulary.select(F.col("word").alias("candidate"), "freq", fold(F.col("word")).alias("b")).repartition(_parts(vocabulary), "candidate")
    listed = dealt.select("candidate", "freq", "b", F.length("b").alias("len"), F.explode(_listed(F.col("b"), k)).alias("p")).select("candidate", "freq", "b", "len", "p.*")
    pairs = wanted.join(listed, ["len", "i", "piece"]).withColumn("distance", F.levenshtein("a", "b", k)).where("distance >= 0")
    pairs = pairs.select("word", "low", "candidate", "freq", F.col("distance").cast("double").alias("distance"))
    pairs = pairs.distinct() if once or measure else pairs
    if measure is None:
        return pairs
    # Behind a generator the measure stays out of the join's condition, which then keeps its generated code.
    found = pairs.select("word", "low", "candidate", "freq", F.explode(F.array(measure(F.col("low"), F.col("candidate")))).alias("distance"))
    return found.where(F.col("distance") <= radius)


def nearest(found: DataFrame) -> DataFrame:
    """Of candidates the one of least distance, then of most occurrences, then the first word."""
    best = found.groupBy("word", "low").agg(F.min(F.struct("distance", (-F.col("freq")).alias("less"), "candidate")).alias("b"))
    return best.select("word", "low", F.col("b.candidate").alias("correction"), F.col("b.distance").alias("distance"), (-F.col("b.less")).alias("freq"))


def _asked(words: DataFrame) -> DataFrame:
    return words.select("word").distinct().select("word", az_lower("word").alias("low"))


def _then(asked: DataFrame, found: DataFrame, tier: str, name: str) -> DataFrame:
    """asked with what a tier found for words that have no tier yet."""
    new = found.select("word", *(F.col(c).alias(f"__{c}") for c in ("correction", "distance", "freq")))
    out = asked.join(new, "word", "left")
    hit = F.col("__correction").isNotNull()
    columns = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in ("correction", "distance", "freq")}
    return out.withColumns({name: F.when(hit, F.lit(tier)).otherwise(F.col(name))} | columns).select("word", "low", "correction", "distance", "freq", name)


def _untold(asked: DataFrame, name: str) -> DataFrame:
    return asked.select("word", "low", F.lit(None).cast("string").alias("correction"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("bigint").alias("freq"), F.lit(None).cast("string").alias(name))


def correct(words: DataFrame, vocabulary: DataFrame, radius: int = 4) -> DataFrame:
    """(word, correction, distance, freq, tier) of each distinct word; correction and distance are null where nothing is near.

    Most words have a near one: those within NEAR are sought first, by long pieces, and only for the rest the whole radius.
    The case of the first letter is restored in all tiers.
    """
    asked = settle(_untold(_asked(words), "tier"))  # and after each tier: each reads it twice, so plans would double
    rest = lambda: asked.where("tier IS NULL").select("word", "low")
    asked = settle(_then(asked, exact(rest(), vocabulary), "exact", "tier"))
    asked = settle(_then(asked, by_variant(rest(), vocabulary), "variant", "tier"))
    for k in [NEAR, radius] if radius > NEAR else [radius]:
        asked = settle(_then(asked, nearest(candidates(rest(), vocabulary, k, once=False)), "distance", "tier"))
    return asked.select("word", preserve_case(F.col("correction"), F.col("word")).alias("correction"), "distance", "freq", F.coalesce("tier", F.lit("none")).alias("tier"))


def alternatives(words: DataFrame, vocabulary: DataFrame, radius: int = 3, k: int = 5) -> DataFrame:
    """(word, rank, candidate, distance, freq): the k nearest words within radius + 1, by distance, count, word."""
    found = candidates(_asked(words), vocabulary, radius + 1)
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("word", "rank", "candidate", "distance", "freq")


def check(words: DataFrame, vocabulary: DataFrame, radius: int = 3) -> DataFrame:
    """The answer for single words: exists_in_vocab, word_frequency, correction, distance, and alternatives where there is no correction."""
    asked = words.select(strip(F.col("word")).alias("word")).where("word <> ''").distinct()
    found = correct(asked, vocabulary, radius)
    failed = found.where("correction IS NULL").select("word")
    others = alternatives(failed, vocabulary, radius).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "distance", "freq"))).alias("alternatives"))
    own = found.withColumn("exists_in_vocab", F.col("tier") == "exact").withColumn("word_frequency", F.when(F.col("tier") == "exact", F.col("freq")).otherwise(F.lit(0)))
    return own.join(others, "word", "left").select("word", "exists_in_vocab", "word_frequency", "correction", "distance", "alternatives")


def answer(requests: DataFrame, vocabulary: DataFrame, default: int = 3, key: str = "id", body: str = "body") -> DataFrame:
    """(key, code, answer) of each request, a JSON body {word, max_distance}: what check() says, as JSON, or an error.

    Code 400 and No word provided where there is no word, 400 and Invalid request for bodies that are no JSON object or ask
    for a negative distance. Without max_distance the default holds. The largest distance asked for bounds the search;
    each answer keeps to its own.
    """
    parsed = F.from_json(F.col(body), "word string, max_distance int, bad string", {"columnNameOfCorruptRecord": "bad"})
    asked = requests.select(key, parsed.alias("r")).select(key, strip(F.coalesce("r.word", F.lit(""))).alias("word"), F.coalesce("r.max_distance", F.lit(default)).alias("most"), (F.col("r").isNull() | F.col("r.bad").isNotNull() | (F.coalesce("r.max_distance", F.lit(0)) < 0)).alias("invalid"))
    good = asked.where("NOT invalid AND word <> ''")
    radius = good.agg(F.max("most")).first()[0] or 0
    words = good.select("word").distinct()
    found = correct(words, vocabulary, radius)
    # Only words that some request leaves without a correction have alternatives.
    failed = good.join(found, "word").where("correction IS NULL OR tier = 'distance' AND distance > most").select("word").distinct()
    near = nearest_words(failed, vocabulary, radius + 1)
    both = good.join(found, "word").join(near, "word", "left")
    held = F.col("tier").isin("exact", "variant") | (F.col("distance") <= F.col("most"))
    own = lambda c: F.when(held, F.col(c))
    others = F.slice(F.filter("near", lambda n: n["distance"] <= F.col("most") + 1), 1, LISTED)
    exists = F.col("tier") == "exact"
    said = F.struct(
        F.col("word").alias("input_word"), exists.alias("exists_in_vocab"), F.when(exists, F.col("freq")).otherwise(F.lit(0)).alias("word_frequency"), own("correction").alias("correction"),
        F.when(F.col("correction").isNotNull(), own("distance")).alias("distance"), F.when(F.coalesce(held & F.col("correction").isNotNull(), F.lit(False)), F.array().cast(ANSWERS)).otherwise(F.coalesce(others, F.array().cast(ANSWERS))).alias("alternatives"), F.col("most").alias("max_distance_used"))
    fine = both.select(key, F.lit(200).alias("code"), F.to_json(said, {"ignoreNullFields": "false"}).alias("answer"))
    wrong = asked.where("invalid OR word = ''").select(key, F.lit(400).alias("code"), F.to_json(F.struct(F.when(F.col("invalid"), "Invalid request").otherwise("No word provided").alias("error"))).alias("answer"))
    return fine.unionByName(wrong)


def nearest_words(words: DataFrame, vocabulary: DataFrame, radius: int) -> DataFrame:
    """(word, near): the LISTED nearest words of the vocabulary within radius, by distance, count, word."""
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "candidate")
    found = candidates(_asked(words), vocabulary, radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)
    sorted_near = F.array_sort(F.collect_list(F.struct("distance", (-F.col("freq")).alias("less"), "candidate")))
    return found.groupBy("word").agg(sorted_near.alias("n")).select("word", F.transform("n", lambda x: F.struct(x["candidate"].alias("word"), x["distance"].alias("distance"), (-x["less"]).alias("frequency"))).alias("near"))


def status(exists: Column, correction: Column) -> Column:
    return F.when(exists, "Correct").when(correction.isNotNull(), "Corrected").otherwise("Not Found")


def check_texts(texts: DataFrame, vocabulary: DataFrame, radius: int = 3, text: str = "text") -> DataFrame:
    """(word, status, correction, distance, n): every word of some texts, looked up once, with its count."""
    words = texts.select(F.explode(normalised_tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = correct(words, vocabulary, radius).withColumn("status", status(F.col("tier") == "exact", F.col("correction")))
    return found.join(words, "word").select("word", "status", "correction", "distance", "n")


def tally(checked: DataFrame) -> DataFrame:
    """How many words there are, and of each status."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).cast("bigint")
    return checked.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_words"), of("Correct").alias("correct"), of("Corrected").alias("corrected"), of("Not Found").alias("not_found"))


def correct_weighted(words: DataFrame, vocabulary: DataFrame, radius: float = 2.5) -> DataFrame:
    """(word, correction, distance, freq, prediction_type) by the weighted distance, which folded words bound from below."""
    asked = _untold(_asked(words), "prediction_type")
    asked = _then(asked, exact(asked.select("word", "low"), vocabulary), "exact_match", "prediction_type")
    near = nearest(candidates(asked.where("prediction_type IS NULL").select("word", "low"), vocabulary, radius, weighted_distance, folded))
    asked = _then(asked, near, "corrected", "prediction_type")
    return asked.select("word", "correction", "distance", "freq", F.coalesce("prediction_type", F.lit("no_match")).alias("prediction_type"))
