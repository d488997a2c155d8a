"""Queries on spelling, its evaluation, byte-pair encoding and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.distance import ALPHABET, SIMILAR, TYPO_ALPHABET, VARIANT_FROM, VARIANT_TO, variants, weighted_distance
from quillmill.functions.text import normalised_tokens, prompt, unpaired
from quillmill.operators import bpe, corpus, evaluate, spell
from quillmill.plans.common import ascii_sql, inline, lower_sql, normal_sql, read, strip_sql, tokens_sql, values_sql
from quillmill.sources.files import missing_columns
from quillmill.sources.shared import settle
from quillmill.streaming import enrich

#: Small inputs.
WORDS = [("gözəl",), ("Asiq",), ("ə",), ("",), ("şüş",), ("abc",)]
PAIRS = [("şakar", "salar"), ("çırqa", "çərxə"), ("kitab", "kitab"), ("", "abc"), ("abc", ""), ("İst", "ıst"), ("göl", "gol"), ("dəniz", "daniz"), ("a", "b"), ("uzun", "üzüm")]
RESULTS = [
    ("Asiq", "Aşiq", "Aşiq", "anglicization"), ("gozel", "gözəl", None, "anglicization"), ("kitb", "kitab", "kitab", "deletion"), ("ktiab", "kitab", "kitab", "transposition"),
    ("suu", "su", "su", "insertion"), ("evv", "ev", "av", "insertion"), ("yol", "yol", "yol", "correct"), ("xx", None, None, "phonetic"), ("daş", "daş", "dağ", "correct"), ("gul", "gül", "gül", "substitution"),
]
TYPOS = [("gül", "gul", "substitution"), ("kitab", "kitob", "substitution"), ("dəniz", "deniz", "substitution"), ("su", "suu", "insertion"), ("bağ", "bag", "substitution"), ("daş", "daş", "substitution"), ("ǝl", "xl", "substitution"), ("yol", "ylo", "transposition"), ("gözəl", "gozal", "substitution")]
KEYS = [("insertion->correct",), ("a->b->c",), ("->x",), ("ə->e",), ("no arrow",), ("",), (None,)]
NEEDED = [("doc_id",), ("text",), ("modern_text",), ("TEXT",)]
REQUESTS = [(1, '{"word": " kitab "}'), (2, '{"word": ""}'), (3, "{}"), (4, "no json"), (5, None), (6, '{"word": "the", "max_distance": 1}'), (7, '{"word": "thee", "max_distance": -1}'), (8, '{"word": "qqqqqqqqqqqq", "max_distance": 1}')]
PROMPT = "Write the poem in modern words.\n\n{text}\n"
SEED, N_WORDS, N_MERGES, VOCABULARY = 7, 500, 12, 10_000


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents", *columns)


def _vocab(spark, sf_dir):
    return settle(corpus.vocabulary(_docs(spark, sf_dir, "text"), normalised_tokens))  # each tier reads it


def _frequent(spark, sf_dir):
    return settle(corpus.vocabulary(_docs(spark, sf_dir, "text"), lambda c: normalised_tokens(c, False), least_count=3, least_length=2))


def _cases(spark, sf_dir):
    return evaluate.with_typos(evaluate.sample_words(_frequent(spark, sf_dir), N_WORDS, SEED), 0.5, SEED)


def _asked(spark, sf_dir):
    """Misspelt words, and some that hold capitals or nothing known."""
    return _cases(spark, sf_dir).select(F.col("error_word").alias("word")).union(inline(spark, [("The",), ("Ünd",), ("qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq",)], "word string"))


def _single(checked):
    return checked.select("word", "exists_in_vocab", "word_frequency", "correction", "distance", F.coalesce(F.array_join(F.transform("alternatives", lambda a: a["candidate"]), ","), F.lit("")).alias("alternatives"))


def _results(spark):
    return evaluate.judged(inline(spark, RESULTS, "input string, expected string, predicted string, error_type string"), "predicted", "expected")


def _confusion(spark):
    return evaluate.char_confusion(inline(spark, TYPOS, "original string, error_word string, error_type string"))


def _weighted(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    found = spell.correct_weighted(cases.select(F.col("error_word").alias("word")), _frequent(spark, sf_dir))
    return evaluate.judged(cases.join(found, cases.error_word == found.word), "correction", "original")


def _low(spark, sf_dir):
    from quillmill.functions.text import az_lower

    return _asked(spark, sf_dir).distinct().select("word", az_lower("word").alias("low"))


def _merges(spark, sf_dir):
    merges = bpe.train(bpe.word_vocabulary(_docs(spark, sf_dir, "doc_id", "text")), N_MERGES)
    return bpe.merge_table(spark, merges)


def _encoded(spark, sf_dir, full=False):
    """The texts in pieces: by N_MERGES merges, or by as many as make VOCABULARY symbols."""
    docs = _docs(spark, sf_dir, "doc_id", "text")
    words = bpe.word_vocabulary(docs)
    return bpe.apply_merges(docs, bpe.learn(words, VOCABULARY) if full else bpe.train(words, N_MERGES))


def _encoded_stats(encoded):
    return corpus.token_stats(encoded.select("bpe_text"), text="bpe_text").select("n_rows", F.col("total_tokens").alias("total_bpe_tokens"), F.col("unique_types").alias("unique_bpe_types"))


def _done(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return labels.select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("  ").alias("value"))


QUERIES = {
    "quick_variants": lambda s, d: inline(s, WORDS, "word string").select("word", F.explode(variants(F.col("word"))).alias("variant")),
    "exact_lookup": lambda s, d: spell.exact(_low(s, d), _vocab(s, d)),
    "variant_lookup": lambda s, d: spell.by_variant(_low(s, d), _vocab(s, d)),
    "fuzzy_lookup": lambda s, d: spell.nearest(spell.candidates(_low(s, d), _frequent(s, d), 2)),
    "spell_cascade": lambda s, d: spell.correct(_asked(s, d), _vocab(s, d), 4),
    "alternatives": lambda s, d: spell.alternatives(_asked(s, d), _frequent(s, d), 1),
    "single_check": lambda s, d: _single(spell.check(_asked(s, d), _frequent(s, d), 1)),
    # The same over all words at the operators' own radius: without SQL.
    "fuzzy_lookup_full": lambda s, d: spell.nearest(spell.candidates(_low(s, d), _vocab(s, d), 4)),
    "alternatives_full": lambda s, d: spell.alternatives(_asked(s, d), _vocab(s, d)),
    "single_check_full": lambda s, d: _single(spell.check(_asked(s, d), _vocab(s, d))),
    "batch_check": lambda s, d: spell.check_texts(read(s, d, "benchmark", "text"), _vocab(s, d), 3),
    "batch_check_tally": lambda s, d: spell.tally(spell.check_texts(read(s, d, "benchmark", "text"), _vocab(s, d), 3)),
    "spell_accuracy": lambda s, d: evaluate.accuracy(_results(s)),
    "error_accuracy": lambda s, d: evaluate.error_accuracy(_results(s)).withColumn("accuracy", F.round("accuracy", 6)),
    "weighted_error_accuracy": lambda s, d: evaluate.error_accuracy(_weighted(s, d)).withColumn("accuracy", F.round("accuracy", 6)),
    "confusion_totals": lambda s, d: evaluate.confusion_totals(evaluate.char_confusion(_cases(s, d))),
    "decoded_labels": lambda s, d: inline(s, KEYS, "key string").select("key", unpaired(F.col("key")).alias("p")).select("key", "p.actual", "p.predicted"),
    "required_columns": lambda s, d: inline(s, NEEDED, "name string").select("name", (~F.col("name").isin(missing_columns(read(s, d, "documents"), [n for (n,) in NEEDED]))).alias("present")),
    "check_requests": lambda s, d: spell.answer(inline(s, REQUESTS, "id int, body string"), _frequent(s, d)).select("id", "code", F.get_json_object("answer", "$.error").alias("error"), F.get_json_object("answer", "$.exists_in_vocab").alias("exists_in_vocab")),
    "enrich_aligned": lambda s, d: enrich.align(_docs(s, d, "doc_id", "text"), enrich.enrich(_docs(s, d, "doc_id", "text"), lambda t: t[::-1], "doc_id", "text"), "doc_id").select("doc_id", F.length("text").alias("n_text"), F.length("value").alias("n_value")),
    "row_at": lambda s, d: enrich.row_at(_docs(s, d, "doc_id", "source"), "doc_id", 42),
    "accuracy_by_type": lambda s, d: evaluate.accuracy(_results(s), ["error_type"]).withColumn("accuracy", F.round("accuracy", 6)),
    "weighted_distance": lambda s, d: inline(s, PAIRS, "a string, b string").select("a", "b", weighted_distance(F.col("a"), F.col("b")).alias("distance")),
    "weighted_cascade": lambda s, d: _weighted(s, d).select("original", "error_word", "error_type", "correction", "distance", "prediction_type", "status"),
    "typo_generator": lambda s, d: _cases(s, d),
    "error_distribution": lambda s, d: evaluate.distribution(_cases(s, d), "error_type").withColumn("percent", F.round("percent", 6)),
    "error_confusion": lambda s, d: evaluate.error_confusion(_weighted(s, d)),
    "correction_precision": lambda s, d: evaluate.precision(evaluate.error_confusion(_results(s))).withColumn("precision", F.round("precision", 6)),
    "char_confusion": lambda s, d: _confusion(s),
    "char_confusion_typos": lambda s, d: evaluate.char_confusion(_cases(s, d)),
    "char_confusion_top": lambda s, d: evaluate.top_confusions(_confusion(s), 5).withColumn("percent", F.round("percent", 6)),
    "vowel_consonant": lambda s, d: evaluate.vowel_consonant(_confusion(s)).withColumns({c: F.round(c, 6) for c in ("vowel_percent", "consonant_percent")}),
    "char_marginals": lambda s, d: evaluate.char_marginals(_confusion(s)),
    "confusion_dense": lambda s, d: evaluate.dense(_confusion(s), "error_char", "correct_char"),
    "alphabet_order": lambda s, d: evaluate.ordered_letters(_confusion(s)),
    "bpe_pair_counts": lambda s, d: bpe.pair_counts(bpe.word_vocabulary(_docs(s, d, "doc_id", "text"))).select("left", "right", "freq"),
    "bpe_merges_small": _merges,
    "bpe_merge_lines": lambda s, d: bpe.merge_lines(_merges(s, d)),
    "bpe_stats": lambda s, d: _encoded_stats(_encoded(s, d)),
    "bpe_apply": lambda s, d: _encoded(s, d).select("doc_id", "bpe_text"),
    # The same at full size, thousands of merges: without SQL.
    "bpe_stats_full": lambda s, d: _encoded_stats(_encoded(s, d, True)),
    "bpe_apply_full": lambda s, d: _encoded(s, d, True).select("doc_id", "bpe_text"),
    "bpe_vocab_ids": lambda s, d: bpe.vocabulary_ids(_docs(s, d, "text"), "text"),
    "enrich_alignment": lambda s, d: _docs(s, d, "doc_id").join(_done(s, d).where("value = 'done'"), "doc_id", "full").agg(F.count("*").alias("keys"), F.count("value").alias("done")),
    "enrich_pending": lambda s, d: enrich.pending(_docs(s, d, "doc_id"), _done(s, d), "doc_id"),
    "enrich_stub": lambda s, d: enrich.enrich(_docs(s, d, "doc_id", "text"), lambda t: t.upper()[::-1], "doc_id", "text").select("doc_id", F.length("value").alias("n"), "error"),
    "prompts": lambda s, d: _docs(s, d, "doc_id", "text").select("doc_id", prompt(PROMPT, F.col("text")).alias("prompt")),
}

VOCAB = f"vocab AS (SELECT word, count(*) AS freq FROM (SELECT unnest({normal_sql('text')}) AS word FROM documents) GROUP BY word)"
FREQUENT = f"frequent AS (SELECT word, count(*) AS freq FROM (SELECT unnest({normal_sql('text', '')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 3 AND length(word) >= 2)"


def _draw(turn: int) -> str:
    return f"('0x' || substr(md5(word || ':{turn}:{SEED}'), 1, 7))::INT"


CASES = f"""
sampled AS (SELECT word, {lower_sql("word")} AS low, length(word) AS n FROM frequent ORDER BY md5(word || ':{SEED}'), word LIMIT {N_WORDS}),
drawn AS (SELECT *, {_draw(1)} % 4 AS kind, {_draw(2)} AS r, substr('{TYPO_ALPHABET}', {_draw(3)} % {len(TYPO_ALPHABET)} + 1, 1) AS letter, n >= 2 AND {_draw(0)} % 1000 < 500 AS made FROM sampled),
cases AS (
  SELECT word AS original, CASE WHEN NOT made THEN word
         WHEN kind = 0 THEN substr(low, 1, r % n) || letter || substr(low, r % n + 2)
         WHEN kind = 1 THEN substr(low, 1, r % (n + 1)) || letter || substr(low, r % (n + 1) + 1)
         WHEN kind = 2 THEN substr(low, 1, r % n) || substr(low, r % n + 2)
         ELSE substr(low, 1, r % (n - 1)) || substr(low, r % (n - 1) + 2, 1) || substr(low, r % (n - 1) + 1, 1) || substr(low, r % (n - 1) + 3) END AS error_word,
         CASE WHEN NOT made THEN 'correct' ELSE ['substitution', 'insertion', 'deletion', 'transposition'][kind + 1] END AS error_type
  FROM drawn)
"""
ASKED = f"""
asked AS (SELECT DISTINCT word, {lower_sql("word")} AS low FROM (SELECT error_word AS word FROM cases UNION ALL VALUES ('The'), ('Ünd'), ('{"q" * 53}')))
"""


def _variants_sql(word: str) -> str:
    return f"list_distinct(list_concat([{word}], list_transform(range(1, length({word}) + 1), lambda i: substr({word}, 1, i - 1) || translate(substr({word}, i, 1), '{VARIANT_FROM}', '{VARIANT_TO}') || substr({word}, i + 1))))"


def _near_sql(asked: str, vocab: str, radius: int) -> str:
    """Candidates within radius. Letters beyond ASCII are exchanged once per word, as the distance counts bytes."""
    return f"""
    SELECT a.word, a.low, v.word AS candidate, v.freq, levenshtein(a.k, v.k) AS distance
    FROM (SELECT *, {ascii_sql("low")} AS k FROM {asked}) a JOIN (SELECT *, {ascii_sql("word")} AS k FROM {vocab}) v ON length(v.k) BETWEEN greatest(1, length(a.k) - {radius}) AND length(a.k) + {radius}
    WHERE levenshtein(a.k, v.k) <= {radius}"""


def _nearest_sql(near: str) -> str:
    return f"SELECT word, low, candidate AS correction, distance::DOUBLE AS distance, freq FROM ({near}) QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, candidate) = 1"


EXACT = "SELECT a.word, low, low AS correction, 0.0::DOUBLE AS distance, freq FROM asked a JOIN {vocab} v ON v.word = a.low"
VARIANT = f"""
SELECT word, low, form AS correction, 0.5::DOUBLE AS distance, freq
FROM (SELECT a.*, v.freq FROM (SELECT word, low, unnest({_variants_sql("low")}) AS form FROM {{asked}}) a JOIN {{vocab}} v ON v.word = a.form)
QUALIFY row_number() OVER (PARTITION BY word ORDER BY freq DESC, form) = 1
"""
RESTORE = "CASE WHEN regexp_matches(word, '^\\p{Lu}') AND regexp_matches(correction, '^\\p{Ll}') THEN (CASE substr(correction, 1, 1) WHEN 'ı' THEN 'I' WHEN 'i' THEN 'İ' ELSE upper(substr(correction, 1, 1)) END) || substr(correction, 2) ELSE correction END"


def _cascade_sql(vocab: str, radius: int) -> str:
    return f"""
    one AS ({EXACT.format(vocab=vocab)}),
    rest1 AS (SELECT * FROM asked WHERE word NOT IN (SELECT word FROM one)),
    two AS ({VARIANT.format(asked="rest1", vocab=vocab)}),
    rest2 AS (SELECT * FROM rest1 WHERE word NOT IN (SELECT word FROM two)),
    three AS ({_nearest_sql(_near_sql("rest2", vocab, radius))}),
    every AS (
      SELECT *, 'exact' AS tier FROM one UNION ALL SELECT *, 'variant' FROM two UNION ALL SELECT *, 'distance' FROM three
      UNION ALL SELECT word, low, NULL, NULL, NULL, 'none' FROM rest2 WHERE word NOT IN (SELECT word FROM three)),
    corrected AS (SELECT word, {RESTORE} AS correction, distance, freq, tier FROM every)"""


LETTERS = f"position(letter IN '{ALPHABET}')"
CONFUSION = f"""
typos AS (SELECT * FROM {values_sql(TYPOS, "original", "error_word", "error_type")} WHERE error_type = 'substitution'),
"""
PAIRED = """
places AS (SELECT error_word, original, unnest(range(1, least(length(error_word), length(original)) + 1)) AS i FROM typos),
confusion AS (SELECT substr(error_word, i, 1) AS error_char, substr(original, i, 1) AS correct_char, count(*) AS count FROM places WHERE substr(error_word, i, 1) <> substr(original, i, 1) GROUP BY 1, 2)
"""
JUDGED = f"results AS (SELECT *, CASE WHEN predicted IS NOT DISTINCT FROM expected THEN 'PASS' ELSE 'FAIL' END AS status FROM {values_sql(RESULTS, 'input', 'expected', 'predicted', 'error_type')})"
ERROR_ACCURACY = "count(*) AS total, count_if(error_type <> 'correct') AS errors, count_if(error_type <> 'correct' AND status = 'PASS') AS corrected, round(coalesce(100.0 * count_if(error_type <> 'correct' AND status = 'PASS') / nullif(count_if(error_type <> 'correct'), 0), 0), 6)::DOUBLE AS accuracy"
ACCURACY = "count(*) AS total, count_if(status = 'PASS') AS passed, round(100.0 * count_if(status = 'PASS') / count(*), 6) AS accuracy"

#: A distance table in SQL, row by row by recursion: for a set of pairs (a, b).
TABLES = f"""
chars AS (SELECT DISTINCT a, b, {lower_sql("a")} AS x, {lower_sql("b")} AS y FROM pairs),
grid AS (
  SELECT a, b, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: j::DOUBLE) AS r FROM chars
  UNION ALL
  SELECT a, b, x, y, i + 1, list_reduce(list_transform(range(1, length(y) + 1), lambda j: [
           r[j] + (CASE WHEN substr(x, i + 1, 1) = substr(y, j::BIGINT, 1) THEN 0.0
                        WHEN translate(substr(x, i + 1, 1), '{"".join(p[1] for p in SIMILAR)}', '{"".join(p[0] for p in SIMILAR)}') = translate(substr(y, j::BIGINT, 1), '{"".join(p[1] for p in SIMILAR)}', '{"".join(p[0] for p in SIMILAR)}') THEN 0.5 ELSE 1.0 END),
           r[j + 1] + 1.0]), lambda done, c: list_append(done, least(c[1], c[2], done[len(done)] + 1.0)), [r[1] + 1.0])
  FROM grid WHERE i < length(x)),
distances AS (SELECT a, b, r[length(y) + 1] AS distance FROM grid WHERE i = length(x))
"""


def _fold_sql(word: str) -> str:
    return ascii_sql(f"translate({word}, '{''.join(p[1] for p in SIMILAR)}', '{''.join(p[0] for p in SIMILAR)}')")


WEIGHTED = f"""
WITH RECURSIVE {FREQUENT}, {CASES}, asked AS (SELECT DISTINCT error_word AS word, {lower_sql("error_word")} AS low FROM cases),
one AS ({EXACT.format(vocab="frequent")}),
rest AS (SELECT *, {_fold_sql("low")} AS k FROM asked WHERE word NOT IN (SELECT word FROM one)),
folded AS (SELECT *, {_fold_sql("word")} AS k FROM frequent),
pairs AS (SELECT r.low AS a, f.word AS b FROM rest r JOIN folded f ON length(f.k) BETWEEN length(r.k) - 2 AND length(r.k) + 2 WHERE levenshtein(r.k, f.k) <= 2),
{TABLES},
near AS (SELECT r.word, r.low, d.b AS correction, d.distance, f.freq FROM rest r JOIN distances d ON d.a = r.low JOIN frequent f ON f.word = d.b WHERE d.distance <= 2.5 QUALIFY row_number() OVER (PARTITION BY r.word ORDER BY d.distance, f.freq DESC, d.b) = 1),
every AS (SELECT word, correction, distance, 'exact_match' AS prediction_type FROM one UNION ALL SELECT word, correction, distance, 'corrected' FROM near UNION ALL SELECT word, NULL, NULL, 'no_match' FROM rest WHERE word NOT IN (SELECT word FROM near)),
judged AS (SELECT original, error_word, error_type, correction, distance, prediction_type, CASE WHEN correction IS NOT DISTINCT FROM original THEN 'PASS' ELSE 'FAIL' END AS status FROM cases JOIN every ON every.word = cases.error_word)
"""

OPEN, CLOSE = "", ""
BPE_WORDS = f"""
occ AS (SELECT doc_id, unnest({tokens_sql("text")}) AS word, generate_subscripts({tokens_sql("text")}, 1) AS pos FROM documents),
v0 AS (SELECT word, count(*) AS freq, min((doc_id, pos)) AS first, regexp_replace(word, '(?s)(.)', '{OPEN}\\1{CLOSE}', 'g') || '{OPEN}</w>{CLOSE}' AS marked FROM occ GROUP BY word)
"""


def _pairs_sql(k: int) -> str:
    return f"""
s{k} AS (SELECT freq, first, string_split(substr(marked, 2, length(marked) - 2), '{CLOSE}{OPEN}') AS s FROM v{k}),
i{k} AS (SELECT freq, first, s, unnest(range(1, len(s))) AS i FROM s{k}),
p{k} AS (SELECT s[i] AS l, s[i + 1] AS r, sum(freq)::BIGINT AS freq, min((first, i)) AS first FROM i{k} GROUP BY 1, 2)"""


def _merges_sql(last: bool = False) -> str:
    """v0, b0 ...: the words after each merge, and each merge; with last also the words after the last one."""
    parts = [BPE_WORDS]
    for k in range(N_MERGES):
        parts.append(_pairs_sql(k) + f",\nb{k} AS MATERIALIZED (SELECT l, r FROM p{k} WHERE freq >= 2 ORDER BY freq DESC, first LIMIT 1)")
        if last or k + 1 < N_MERGES:
            parts.append(f"v{k + 1} AS MATERIALIZED (SELECT word, freq, first, replace(marked, '{OPEN}' || l || '{CLOSE}{OPEN}' || r || '{CLOSE}', '{OPEN}' || l || r || '{CLOSE}') AS marked FROM v{k}, b{k})")
    parts.append("merges AS (" + " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right" FROM b{k}' for k in range(N_MERGES)) + ")")
    return ",\n".join(parts)


CODED = f"""
coded AS (SELECT word, array_to_string(list_filter(list_transform(string_split(substr(marked, 2, length(marked) - 2), '{CLOSE}{OPEN}'), lambda x: regexp_replace(x, '</w>$', '')), lambda x: x <> ''), ' ') AS pieces FROM v{N_MERGES}),
encoded AS (SELECT d.doc_id, coalesce(t.bpe_text, '') AS bpe_text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(pieces, ' ' ORDER BY pos) AS bpe_text FROM occ JOIN coded USING (word) GROUP BY doc_id) t USING (doc_id))
"""

ORACLE_SQL = {
    "quick_variants": f"SELECT word, unnest({_variants_sql('word')}) AS variant FROM {values_sql(WORDS, 'word')}",
    "exact_lookup": f"WITH {VOCAB}, {FREQUENT}, {CASES}, {ASKED} {EXACT.format(vocab='vocab')}",
    "variant_lookup": f"WITH {VOCAB}, {FREQUENT}, {CASES}, {ASKED} {VARIANT.format(asked='asked', vocab='vocab')}",
    "fuzzy_lookup": f"WITH {FREQUENT}, {CASES}, {ASKED} {_nearest_sql(_near_sql('asked', 'frequent', 2))}",
    "spell_cascade": f"WITH {VOCAB}, {FREQUENT}, {CASES}, {ASKED}, {_cascade_sql('vocab', 4)} SELECT * FROM corrected",
    "alternatives": f"""
        WITH {FREQUENT}, {CASES}, {ASKED} SELECT word, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, candidate) AS rank, candidate, distance::DOUBLE AS distance, freq
        FROM ({_near_sql("asked", "frequent", 2)}) QUALIFY rank <= 5""",
    "single_check": f"""
        WITH {FREQUENT}, {CASES}, {ASKED}, {_cascade_sql("frequent", 1)},
        others AS (SELECT word, candidate, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, candidate) AS rank FROM ({_near_sql("(SELECT * FROM asked WHERE word IN (SELECT word FROM corrected WHERE correction IS NULL))", "frequent", 2)}) QUALIFY rank <= 5)
        SELECT word, tier = 'exact' AS exists_in_vocab, CASE WHEN tier = 'exact' THEN freq ELSE 0 END AS word_frequency, correction, distance, coalesce((SELECT string_agg(candidate, ',' ORDER BY rank) FROM others o WHERE o.word = c.word), '') AS alternatives FROM corrected c""",
    "batch_check": f"""
        WITH {VOCAB}, words AS (SELECT word, count(*) AS n FROM (SELECT unnest({normal_sql("text")}) AS word FROM benchmark) GROUP BY word), asked AS (SELECT word, {lower_sql("word")} AS low FROM words), {_cascade_sql("vocab", 3)}
        SELECT word, CASE tier WHEN 'exact' THEN 'Correct' WHEN 'none' THEN 'Not Found' ELSE 'Corrected' END AS status, correction, distance, n FROM corrected JOIN words USING (word)""",
    "batch_check_tally": f"""
        WITH {VOCAB}, words AS (SELECT word, count(*) AS n FROM (SELECT unnest({normal_sql("text")}) AS word FROM benchmark) GROUP BY word), asked AS (SELECT word, {lower_sql("word")} AS low FROM words), {_cascade_sql("vocab", 3)}
        SELECT coalesce(sum(n), 0)::BIGINT AS total_words, coalesce(sum(n) FILTER (tier = 'exact'), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (tier IN ('variant', 'distance')), 0)::BIGINT AS corrected, coalesce(sum(n) FILTER (tier = 'none'), 0)::BIGINT AS not_found
        FROM corrected JOIN words USING (word)""",
    "spell_accuracy": f"WITH {JUDGED} SELECT {ACCURACY} FROM results",
    "error_accuracy": f"WITH {JUDGED} SELECT {ERROR_ACCURACY} FROM results",
    "weighted_error_accuracy": f"{WEIGHTED} SELECT {ERROR_ACCURACY} FROM judged",
    "confusion_totals": f"WITH {FREQUENT}, {CASES}, typos AS (SELECT * FROM cases WHERE error_type = 'substitution'), {PAIRED} SELECT coalesce(sum(count), 0)::BIGINT AS total_substitutions, count(*) AS unique_character_pairs FROM confusion",
    "decoded_labels": f"SELECT key, CASE WHEN contains(key, '->') THEN split_part(key, '->', 1) END AS actual, CASE WHEN contains(key, '->') THEN substr(key, position('->' IN key) + 2) END AS predicted FROM {values_sql(KEYS, 'key')}",
    "required_columns": f"SELECT name, lower(name) IN (SELECT lower(column_name) FROM (DESCRIBE documents)) AS present FROM {values_sql(NEEDED, 'name')}",
    "check_requests": f"""
        WITH {FREQUENT}, asked AS (SELECT *, body IS NULL OR NOT json_valid(body) AS odd FROM {values_sql(REQUESTS, "id", "body")}),
        cut AS (SELECT id, odd, CASE WHEN NOT odd THEN trim(coalesce(body ->> '$.word', '')) END AS word, CASE WHEN NOT odd THEN coalesce((body ->> '$.max_distance')::INT, 3) END AS most FROM asked)
        SELECT id, CASE WHEN odd OR most < 0 OR word = '' THEN 400 ELSE 200 END AS code, CASE WHEN odd OR most < 0 THEN 'Invalid request' WHEN word = '' THEN 'No word provided' END AS error,
               CASE WHEN NOT odd AND most >= 0 AND word <> '' THEN ({lower_sql("cut.word")} IN (SELECT word FROM frequent))::VARCHAR END AS exists_in_vocab FROM cut""",
    "enrich_aligned": f"SELECT doc_id, length(text) AS n_text, CASE WHEN {strip_sql('text')} = '' THEN 0 ELSE length(text) END AS n_value FROM documents",
    "row_at": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1 OFFSET 42",
    "accuracy_by_type": f"WITH {JUDGED} SELECT error_type, {ACCURACY} FROM results GROUP BY error_type",
    "weighted_distance": f"WITH RECURSIVE pairs AS {values_sql(PAIRS, 'a', 'b')}, {TABLES} SELECT a, b, distance FROM distances",
    "weighted_cascade": f"{WEIGHTED} SELECT * FROM judged",
    "typo_generator": f"WITH {FREQUENT}, {CASES} SELECT * FROM cases",
    "error_distribution": f"WITH {FREQUENT}, {CASES} SELECT error_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cases GROUP BY error_type",
    "error_confusion": f"{WEIGHTED} SELECT error_type AS actual, CASE WHEN status = 'PASS' THEN 'correct' ELSE 'incorrect' END AS predicted, count(*) AS count FROM judged GROUP BY 1, 2",
    "correction_precision": f"""
        WITH {JUDGED} SELECT count_if(error_type <> 'correct' OR status = 'FAIL') AS errors, count_if(error_type <> 'correct' AND status = 'PASS') AS fixed, count_if(status = 'FAIL') AS not_fixed,
               round(100.0 * count_if(error_type <> 'correct' AND status = 'PASS') / (count_if(error_type <> 'correct' AND status = 'PASS') + count_if(status = 'FAIL')), 6) AS precision FROM results""",
    "char_confusion": f"WITH {CONFUSION} {PAIRED} SELECT * FROM confusion",
    "char_confusion_typos": f"WITH {FREQUENT}, {CASES}, typos AS (SELECT * FROM cases WHERE error_type = 'substitution'), {PAIRED} SELECT * FROM confusion",
    "char_confusion_top": f"WITH {CONFUSION} {PAIRED} SELECT row_number() OVER (ORDER BY count DESC, error_char, correct_char) AS rank, error_char, correct_char, count, round(100.0 * count / sum(count) OVER (), 6) AS percent FROM confusion QUALIFY rank <= 5",
    "vowel_consonant": f"""
        WITH {CONFUSION} {PAIRED}, k AS (SELECT contains('aeəiıoöuü', error_char) AS e, contains('aeəiıoöuü', correct_char) AS c, count FROM confusion)
        SELECT coalesce(sum(count) FILTER (e AND c), 0)::BIGINT AS vowel_to_vowel, coalesce(sum(count) FILTER (e AND NOT c), 0)::BIGINT AS vowel_to_consonant, coalesce(sum(count) FILTER (NOT e AND c), 0)::BIGINT AS consonant_to_vowel,
               coalesce(sum(count) FILTER (NOT e AND NOT c), 0)::BIGINT AS consonant_to_consonant, round(100.0 * coalesce(sum(count) FILTER (e), 0) / sum(count), 6) AS vowel_percent, round(100.0 * coalesce(sum(count) FILTER (NOT e), 0) / sum(count), 6) AS consonant_percent FROM k""",
    "char_marginals": f"WITH {CONFUSION} {PAIRED} SELECT 'error' AS role, error_char AS letter, sum(count)::BIGINT AS count FROM confusion GROUP BY 2 UNION ALL SELECT 'correct', correct_char, sum(count)::BIGINT FROM confusion GROUP BY 2",
    "confusion_dense": f"""
        WITH {CONFUSION} {PAIRED}, labels AS (SELECT error_char AS l FROM confusion UNION SELECT correct_char FROM confusion)
        SELECT a.l AS error_char, b.l AS correct_char, coalesce(count, 0) AS count FROM labels a CROSS JOIN labels b LEFT JOIN confusion c ON c.error_char = a.l AND c.correct_char = b.l""",
    "alphabet_order": f"""
        WITH {CONFUSION} {PAIRED}, labels AS (SELECT error_char AS letter FROM confusion UNION SELECT correct_char FROM confusion)
        SELECT row_number() OVER (ORDER BY CASE WHEN {LETTERS} > 0 THEN {LETTERS} ELSE 99 END, letter) - 1 AS position, letter FROM labels""",
    "bpe_pair_counts": f'WITH {BPE_WORDS}, {_pairs_sql(0)} SELECT l AS "left", r AS "right", freq FROM p0',
    "bpe_merges_small": f"WITH {_merges_sql()} SELECT * FROM merges",
    "bpe_merge_lines": f"""WITH {_merges_sql()} SELECT 0 AS line, '#version: 0.2' AS value UNION ALL SELECT rank + 1, "left" || ' ' || "right" FROM merges""",
    "bpe_apply": f"WITH {_merges_sql(True)}, {CODED} SELECT * FROM encoded",
    "bpe_stats": f"WITH {_merges_sql(True)}, {CODED}, tokens AS (SELECT unnest({tokens_sql('bpe_text')}) AS token FROM encoded) SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS total_bpe_tokens, count(DISTINCT token) AS unique_bpe_types FROM tokens",
    "bpe_vocab_ids": f"SELECT token, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token",
    "enrich_alignment": "SELECT count(*) AS keys, count(l.doc_id) AS done FROM documents d FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id",
    "enrich_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "enrich_stub": f"SELECT doc_id, CASE WHEN {strip_sql('text')} = '' THEN 0 ELSE length(upper(text)) + 1 * (length(text) - length(replace(text, 'ß', ''))) END AS n, NULL::VARCHAR AS error FROM documents",
    "prompts": f"SELECT doc_id, {values_sql([(PROMPT.split('{text}')[0],)], 'p')}::VARCHAR || coalesce(text, '') || chr(10) AS prompt FROM documents",
}
