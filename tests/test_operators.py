import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmill.functions.text import normalised_tokens
from quillmill.operators import bpe, corpus, evaluate, ingest, segments, spell
from quillmill.plans import language


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def tokens(docs):
    return [r.text.split() for r in docs.orderBy("doc_id").collect()]


def test_frequencies_sum_to_all_tokens(docs, tokens):
    got = {r.token: r.frequency for r in corpus.token_frequencies(docs).collect()}
    assert got == Counter(t for ts in tokens for t in ts)


def test_growth_is_that_of_a_sequential_scan(docs, tokens):
    seen, n, want = set(), 0, []
    for t in (t for ts in tokens for t in ts):
        seen.add(t)
        n += 1
        if n % 300 == 0:
            want.append((n, len(seen)))
    if n % 300:
        want.append((n, len(seen)))
    got = [(r.tokens, r.types) for r in corpus.vocabulary_growth(docs, 300).orderBy("tokens").collect()]
    assert got == want
    assert len(got) == math.ceil(n / 300)


def test_growth_of_nothing(spark):
    assert corpus.vocabulary_growth(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fit_finds_the_law_and_has_no_r2_without_variation(spark):
    points = spark.range(1, 50).select((F.col("id") * 100).alias("tokens")).withColumn("types", 3 * F.pow("tokens", F.lit(0.7))).withColumns({"log_tokens": F.ln("tokens"), "log_types": F.ln("types")})
    fit = corpus.fit_heaps(points).first()
    assert (round(fit.k, 9), round(fit.beta, 9), round(fit.r2, 9), fit.num_points) == (3.0, 0.7, 1.0, 49)
    flat = corpus.fit_line(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double"), "x", "y").first()
    assert flat.r2 is None and flat.slope == 0


def test_merge_keeps_existing_rows_and_the_first_of_each_new_key(spark):
    old = spark.createDataFrame([("a", "t", 1), ("a", "t", 2), (None, "u", 3)], "author string, title string, n int")
    new = spark.createDataFrame([("a", "t", 9), ("b", "t", 8), ("b", "t", 7), (None, "u", 6), (None, "v", 5), ("a|t", "x", 4), ("a", "t|x", 4)], "author string, title string, n int")
    got = sorted((r.n for r in ingest.merge_new(old, new, ["author", "title"], "n").collect()))
    assert got == [1, 2, 3, 4, 4, 5, 7]


def test_page_texts_have_text_or_error(spark):
    rows = spark.createDataFrame([("A", "Bir söz", '{"parse":{"wikitext":{"*":"[[a|b]]\\n\\nc"}}}'), ("A", "X", '{"error":{"code":"missing","info":"no page"}}'), ("A", "Y", None)], "author string, title string, body string")
    got = {r.title: (r.url, r.text, r.error) for r in ingest.page_texts(rows).collect()}
    assert got["Bir söz"] == ("https://example.org/wiki/Bir%20s%C3%B6z", "b\nc", None)
    assert got["X"][1:] == (None, "missing: no page")
    assert got["Y"][1:] == (None, "no text")


def test_cascade_tiers(spark):
    vocab = spark.createDataFrame([("aşiq", 5), ("səs", 9), ("ses", 1), ("kitab", 4), ("kital", 7)], "word string, freq long")
    words = spark.createDataFrame([(w,) for w in ("Səs", "Asiq", "kitaz", "zzzzzzzzzz", "seş", "")], "word string")
    got = {r.word: (r.correction, r.distance, r.tier) for r in spell.correct(words, vocab, 2).collect()}
    assert got == {"Səs": ("Səs", 0.0, "exact"), "Asiq": ("Aşiq", 0.5, "variant"), "kitaz": ("kital", 1.0, "distance"), "zzzzzzzzzz": (None, None, "none"), "seş": ("ses", 0.5, "variant"), "": (None, None, "none")}


def test_single_check_gives_alternatives_only_on_failure(spark):
    vocab = spark.createDataFrame([("kitab", 4), ("kital", 7)], "word string, freq long")
    got = {r.word: r for r in spell.check(spark.createDataFrame([("kitab",), ("xital",), ("xxtal",), ("  ",)], "word string"), vocab, 1).collect()}
    assert set(got) == {"kitab", "xital", "xxtal"}
    assert got["kitab"].exists_in_vocab and got["kitab"].word_frequency == 4 and got["kitab"].alternatives is None
    assert got["xital"].correction == "kital" and got["xital"].alternatives is None
    assert [a.candidate for a in got["xxtal"].alternatives] == ["kital"]


def test_tally_counts_every_occurrence(spark):
    vocab = spark.createDataFrame([("kitab", 4)], "word string, freq long")
    texts = spark.createDataFrame([("kitab kitab, kitob zzzzzzzzz",), (None,)], "text string")
    assert tuple(spell.tally(spell.check_texts(texts, vocab, 1)).first()) == (4, 2, 1, 1)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_search_by_pieces_finds_words_of_all_lengths(spark, radius):
    r = random.Random(radius)
    word = lambda: "".join(r.choice("abə") for _ in range(r.randint(1, 13)))
    vocab = spark.createDataFrame([(w, 1) for w in sorted({word() for _ in range(150)} | {"x", "yz", "xyz"})], "word string, freq long")
    asked = spark.createDataFrame([(w,) for w in {word() for _ in range(60)} | {"", "q", "qqqq", "qqqqqq", "zyx"}], "word string").select("word", F.col("word").alias("low"))
    got = [(x.low, x.candidate, x.distance) for x in spell.candidates(asked, vocab, radius).collect()]
    pairs = asked.crossJoin(vocab.select(F.col("word").alias("candidate"))).withColumn("d", F.levenshtein("low", "candidate").cast("double")).where(F.col("d") <= radius)
    assert sorted(got) == sorted((x.low, x.candidate, x.d) for x in pairs.collect()) and (got or not radius)


def test_search_by_pieces_is_a_search_of_all(spark, docs):
    vocab = corpus.vocabulary(docs, normalised_tokens, least_count=2).orderBy("word").limit(400).cache()
    cases = evaluate.with_typos(evaluate.sample_words(vocab, 40), 1.0).select(F.col("error_word").alias("word"))
    got = {(r.low, r.candidate): r.distance for r in spell.candidates(spell._asked(cases), vocab, 2).collect()}
    words = spell._asked(cases)
    want = {(r.low, r.candidate): r.d for r in words.crossJoin(vocab.select(F.col("word").alias("candidate"))).withColumn("d", F.levenshtein("low", "candidate")).where("d <= 2").collect()}
    assert got == want


def test_growth_does_not_mind_how_ids_are_spread(spark, docs):
    far = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, -(10**17)).otherwise(F.col("doc_id") * F.col("doc_id")))
    assert corpus.vocabulary_growth(far).orderBy("tokens").collect() == corpus.vocabulary_growth(docs).orderBy("tokens").collect()
    with pytest.raises(TypeError, match="number"):
        corpus.vocabulary_growth(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_keys_of_pairs_are_cut_at_the_first_arrow(spark):
    from quillmill.functions.text import pair_key, unpaired

    df = spark.createDataFrame([("a", "b"), ("ə", "->"), ("", "x")], "a string, b string").select("a", "b", unpaired(pair_key(F.col("a"), F.col("b"))).alias("p"))
    assert all((r.a, r.b) == tuple(r.p) for r in df.collect())


def test_no_prediction_is_a_failure(spark):
    rows = spark.createDataFrame([("a", None), ("a", "a"), (None, None)], "expected string, predicted string")
    got = evaluate.accuracy(evaluate.judged(rows, "predicted", "expected")).first()
    assert (got.total, got.passed) == (3, 2)
    assert evaluate.accuracy(evaluate.judged(rows.limit(0), "predicted", "expected")).first().accuracy is None


def test_confusions_of_published_counts(spark):
    counts = [("insertion", "incorrect", 58), ("substitution", "correct", 12), ("correct", "correct", 235), ("deletion", "incorrect", 74), ("insertion", "correct", 9), ("transposition", "incorrect", 59), ("substitution", "incorrect", 40), ("deletion", "correct", 4), ("transposition", "correct", 9)]
    got = evaluate.precision(spark.createDataFrame(counts, "actual string, predicted string, count long")).first()
    assert (got.fixed, got.not_fixed, round(got.precision, 2)) == (34, 231, 12.83)


def test_letters_by_alphabet_then_code_point(spark):
    c = spark.createDataFrame([("ş", "v", 1), ("x", "ı", 1), ("ǝ", "a", 1), ("е", "b", 1)], "error_char string, correct_char string, count long")
    assert [r.letter for r in evaluate.ordered_letters(c).orderBy("position").collect()] == ["a", "b", "x", "ı", "ş", "v", "ǝ", "е"]
    d = evaluate.dense(c, "error_char", "correct_char")
    assert d.count() == 64 and d.agg(F.sum("count")).first()[0] == 4


def plain_merges(vocabulary, n, least=2):
    """Merges found one by one, all pairs counted anew each time."""
    rows = sorted(vocabulary.select("word", "freq", "first").collect(), key=lambda r: r["first"])
    words, out = [([*r.word, bpe.END], r.freq) for r in rows], []
    while len(out) < n:
        counts = {}
        for w, freq in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + freq
        if not counts or max(counts.values()) < least:
            break
        out.append(max(counts, key=counts.get))  # the first of equals
        for w, _ in words:
            j = 0
            while j + 1 < len(w):
                if (w[j], w[j + 1]) == out[-1]:
                    w[j : j + 2] = [w[j] + w[j + 1]]
                j += 1
    return out


def test_overlapping_pairs_count_and_merge_from_the_left(spark):
    docs = spark.createDataFrame([(1, "aaa")], "doc_id int, text string")
    words = bpe.word_vocabulary(docs)
    counts = {(r.left, r.right): r.freq for r in bpe.pair_counts(words).collect()}
    assert counts == {("a", "a"): 2, ("a", "</w>"): 1}
    assert words.select(bpe.symbol_list(bpe.merged(F.col("marked"), "a", "a")).alias("s")).first().s == ["aa", "a", "</w>"]


def test_both_trainers_agree_and_pieces_make_the_word(spark, docs):
    words = bpe.word_vocabulary(docs.orderBy("doc_id").limit(30)).cache()
    merges = bpe.train(words, 80)
    assert merges == bpe.train_local(words, 80) == plain_merges(words, 80) and len(merges) == 80
    assert bpe.train(words, 30, most=1) == merges[:30]
    size = bpe.base_symbols(words) + 25
    assert bpe.learn(words, size) == merges[:25] == bpe.learn(words, size, most_words=3)
    ranks = {p: i for i, p in enumerate(bpe.train_local(words, 200))}
    for r in words.limit(300).collect():
        assert "".join(bpe.pieces(r.word, ranks)) == r.word
    with pytest.raises(ValueError, match="words"):
        bpe.train_local(words, 5, most_words=3)


def test_training_ends_where_pairs_are_rare(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id int, text string")
    assert bpe.train(bpe.word_vocabulary(docs), 5) == [] == bpe.train_local(bpe.word_vocabulary(docs), 5)


def test_merges_apply_in_order_of_rank_until_none_is_left():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2, ("bc", "</w>"): 3}
    assert bpe.pieces("abc", ranks) == ["abc"]
    assert bpe.pieces("xbc", ranks) == ["x", "bc"]
    assert bpe.pieces("", ranks) == [] and bpe.pieces("x", ranks) == ["x"]


def test_encoded_texts(spark):
    docs = spark.createDataFrame([(1, "ab  ab c"), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.bpe_text for r in bpe.apply_merges(docs, [("a", "b")]).collect()}
    assert got == {1: "ab ab c", 2: "", 3: ""}
    ids = [(r.token, r.frequency) for r in bpe.vocabulary_ids(bpe.apply_merges(docs, [("a", "b")])).orderBy("id").collect()]
    assert ids == [("ab", 2), ("c", 1)]


def test_segments_in_long_form(spark):
    docs = spark.createDataFrame([(1, "a. b", "c\n\n!"), (2, None, "")], "doc_id int, text string, modern_text string")
    got = segments.segmented(docs, {"original": "text", "modern": "modern_text"})
    assert got.count() == 12
    stats = {(r.text_type, r.method): r for r in segments.statistics(segments.measured(got)).collect()}
    assert (stats["original", "basic"].total_segments, stats["original", "basic"].avg_segments) == (2, 1.0)
    assert stats["modern", "poetry_aware"].total_segments == 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_full_lookups_are_those_of_a_scan_of_all_words(spark, data):
    vocab = {r.word: r.freq for r in language._vocab(spark, data).collect()}
    low = {r.word: r.low for r in language._low(spark, data).collect()}
    some = [*sorted(w for w in low if low[w] not in vocab)[::17][:14], "The", "q" * 53]
    near = {w: sorted((d, -vocab[c], c) for c in vocab if (d := edits(low[w], c) if abs(len(c) - len(low[w])) <= 4 else 9) <= 4) for w in some}
    got = defaultdict(list)
    for r in language.QUERIES["alternatives_full"](spark, data).orderBy("word", "rank").collect():
        got[r.word].append((r.distance, -r.freq, r.candidate))
    assert {w: got[w] for w in some} == {w: n[:5] for w, n in near.items()}
    assert any(d > 2 for n in near.values() for d, _, _ in n[:5])
    nearest = {r.word: (r.distance, -r.freq, r.correction) for r in language.QUERIES["fuzzy_lookup_full"](spark, data).where(F.col("word").isin(some)).collect()}
    assert nearest == {w: n[0] for w, n in near.items() if n}
    checked = {r.word: r for r in language.QUERIES["single_check_full"](spark, data).where(F.col("word").isin(some)).collect()}
    assert set(checked) == set(some)
    for w, r in checked.items():
        if r.distance is None:
            assert r.alternatives == ",".join(c for _, _, c in near[w][:5]) and all(d > 3 for d, _, _ in near[w])
        elif r.distance >= 1:
            assert (r.distance, r.correction.lower()) == (near[w][0][0], near[w][0][2].lower()) and r.distance <= 3


def test_training_in_memory_is_bounded_by_the_symbols(spark):
    """Under 60 bytes a symbol, words and counts included."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(20_000)})
    table = spark.createDataFrame([(w, 1 + i % 7, (i, 0)) for i, w in enumerate(words)], "word string, freq bigint, first struct<doc:bigint,pos:int>").cache()
    table.count()
    tracemalloc.start()
    merges = bpe.train_local(table, 30)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 30 and most < 60 * 15 * len(words)


def test_pairs_and_pieces_move_no_row_for_each_symbol_or_word(spark):
    """Also where documents share an id, or have none."""
    docs = spark.createDataFrame([(1, "aab ab"), (1, "ba aab"), (None, "ab"), (2, "ab b")], "doc_id int, text string")
    words = bpe.word_vocabulary(docs)
    plan = bpe.pair_counts(words.checkpoint())._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    firsts = {(r.left, r.right): (r.freq, r.first.first.doc, r.first.first.pos, r.first.i) for r in bpe.pair_counts(words).collect()}
    assert firsts == {("a", "a"): (2, 1, 0, 0), ("a", "b"): (5, None, 0, 0), ("b", "</w>"): (6, None, 0, 1), ("b", "a"): (1, 1, 0, 0), ("a", "</w>"): (1, 1, 0, 1)}
    merges = [("a", "b")]
    assert sorted((r.doc_id or 0, r.bpe_text) for r in bpe.apply_merges(docs, merges).collect()) == [(0, ""), (1, "a ab b a a ab ab"), (1, "a ab b a a ab ab"), (2, "ab b")]
    once = bpe.apply_merges(docs.where("doc_id = 2"), merges)
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_first_places_are_found_without_sorting_all_tokens(spark):
    docs = spark.createDataFrame([(-5, "x y"), (3, "y x z")], "doc_id long, text string")
    plan = corpus.ranked_tokens(docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert [r.token for r in corpus.ranked_tokens(docs, 3).orderBy("rank").collect()] == ["x", "y", "z"]
    wide = docs.withColumn("doc_id", F.col("doc_id") * 10**15)
    assert [r.token for r in corpus.ranked_tokens(wide, 3).orderBy("rank").collect()] == ["x", "y", "z"]
    assert [(r.word, r.first.doc, r.first.pos) for r in bpe.word_vocabulary(docs).orderBy("first").collect()] == [("x", -5, 0), ("y", -5, 1), ("z", 3, 2)]


def test_tiers_of_the_cascade_start_from_what_is_kept(spark):
    """Each tier reads the words twice and the vocabulary once: neither is worked out anew."""
    words = spark.createDataFrame([("kitb",), ("su",), ("zzzzzzz",)], "word string")
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda w: runs.add(1) or w).asNondeterministic()
    vocabulary = spark.createDataFrame([("kitab", 3), ("su", 2)], "word string, freq bigint")
    found = spell.correct(words.select(seen("word").alias("word")), vocabulary)
    assert {r.word: (r.correction, r.tier) for r in found.collect()} == {"kitb": ("kitab", "distance"), "su": ("su", "exact"), "zzzzzzz": (None, "none")}
    assert runs.value == 3 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
