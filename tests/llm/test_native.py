"""License scan, line dedup, decontamination, mixing."""

import random
import re
from collections import defaultdict

import pytest
from helpers import dedup, leaks, made_texts, plain_words, words
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, licenses, linededup, mixing

TEXTS = [
    "Released under the MIT License.\nUnder the mit  license again", "Licensed under the Apache License, Version 2.0.", "cc-by-nc 4.0 and cc by nc sa", None, "", "   ", "under the mit licenses", "apache license version 20",
    "été UNDER THE MIT LICENSE été", "cc by nc cc by nc", "GNU General Public License version 3 or later. All rights reserved.", "x" * 100_000 + " under the mit license", "under\x00the-mit_license",
]


def base(text):
    w = plain_words(text)
    at = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_base_places_and_labels(spark):
    df = spark.createDataFrame([(i, t, "own", 1.5) for i, t in enumerate(TEXTS)], "doc_id int, text string, other string, score double")
    got = licenses.scan_licenses(df)
    assert got.columns.count("score") == 1 and "other" in got.columns
    for r in got.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(TEXTS[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_there_are_hundreds_of_rules_and_each_finds_its_family(spark):
    assert len({r[4] for r in licenses.TEXTS}) + len({f[2] for f in licenses.FAMILIES}) > 250 and len(licenses.rules()) > 400
    assert all(p in range(1, licenses.PRIORITIES + 1) and 0 < c <= 1 for _, _, p, c, _ in licenses.rules())
    texts = ["Distributed under the terms of the Mozilla Public License, v. 2.0", "the ISC license", "BSD 3-Clause License", "a bsd", "licensed under CC BY-SA 4.0", "nothing at all"]
    got = [r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == ["mpl-2", "isc", "bsd-3-clause", "", "cc-by-sa", ""]


def scanned(text):
    """labels, n_found and score: every rule tried on the whole text, each detection held against all others."""
    line = f" {' '.join(plain_words(text))} " if plain_words(text) else " "
    found = [(m.start(), m.end(), priority, -k, label, confidence) for k, (label, _, priority, confidence, pattern) in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line)]
    inside = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[1] - e[0], e[2], e[3]) > (d[1] - d[0], d[2], d[3])
    kept = [d for d in found if not any(inside(d, e) for e in found)]
    n_base, _, _, base_labels = base(text)[1:]
    labels = {d[4] for d in kept} | set(filter(None, base_labels.split(",")))
    return ",".join(sorted(labels)), len(kept), 1.0 if n_base else max((d[5] for d in kept), default=0.0)


def license_texts():
    """A text for each string that a rule's pattern matches at its least and its most, and mixtures of them."""
    out = []
    for _, _, _, _, pattern in licenses.rules():
        every = strings(pattern)
        out += {min(every, key=len), max(every, key=len)}
    r = random.Random(3)
    some = [x for x in out if x]
    out += [r.choice(["", "the ", "zz, "]) + r.choice([" ", ". ", " or "]).join(r.choice(some) for _ in range(r.randint(2, 5))) for _ in range(300)]
    return [x.title() if k % 3 == 0 else x for k, x in enumerate(out)]


def test_labels_scores_and_suppression_are_those_of_a_plain_scan(spark):
    texts = [*license_texts(), *TEXTS]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)).select("doc_id", "labels", "n_found", "score").collect()
    wrong = [(texts[r.doc_id], tuple(r)[1:], scanned(texts[r.doc_id])) for r in got if tuple(r)[1:] != scanned(texts[r.doc_id])]
    assert wrong == [] and len(got) == len(texts) > 900


def test_every_rule_finds_a_text_of_its_own():
    for label, _, _, _, pattern in licenses.rules():
        text = min(strings(pattern), key=len)
        assert re.search(f"(?<= )(?:{pattern})(?= )", f" {text} "), (label, text)


def test_a_branching_pattern_matches_just_its_words():
    words = ["a", "ab", "abc", "b", "bcd", "bce", "x1"]
    assert [w for w in [*words, "", "ac", "bc", "x", "bcda"] if re.fullmatch(licenses.any_of(words), w)] == words


def strings(pattern):
    """Every string that a pattern matches: what looks ahead is left out, a free word is x, longer repeats come at their least."""

    def of(tokens):
        found = [""]
        for op, arg in tokens:
            op = str(op)
            if op == "LITERAL":
                some = [chr(arg)]
            elif op == "IN":
                some = ["x"] if str(arg[0][0]) == "NEGATE" else [chr(c) for kind, v in arg for c in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))]
            elif op == "NOT_LITERAL":
                some = ["x"]
            elif op == "BRANCH":
                some = [x for branch in arg[1] for x in of(branch)]
            elif op == "SUBPATTERN":
                some = of(arg[3])
            elif op == "MAX_REPEAT":
                some = of(arg[2]) if arg[0] else ["", *of(arg[2])] if arg[1] == 1 else [""]
            else:
                assert op == "ASSERT_NOT", op
                continue
            found = [a + b for a in found for b in some]
        return found

    return of(re._parser.parse(pattern))


def test_whatever_a_rule_matches_has_a_keyword_of_the_rule():
    rules = [*((r[1], r[4]) for r in licenses.TEXTS), *((keywords, name.lstrip("*")) for _, keywords, name in licenses.FAMILIES)]
    assert {r[1] for r in licenses.rules()} == {k for k, _ in rules}
    named = [(keywords, x) for keywords, pattern in rules for x in strings(pattern)]
    assert len(named) > 900
    assert [(k, x) for k, x in named if not set(k.split("|")) & set(x.split())] == []


def test_names_with_the_version_in_the_word_are_found(spark):
    texts = {
        "licensed under the GPLv3": ("gpl-3", 0.95), "GPLv2": ("gpl-2", 0.5), "the GPL3 license": ("gpl-3", 0.8), "released under GPLv1": ("gpl-1", 0.95), "licensed under the LGPLv3": ("lgpl", 0.95), "LGPL2.1": ("lgpl", 0.5),
        "AGPLv3": ("agpl", 0.5), "under the 0BSD license": ("0bsd", 0.8), "Beerware": ("beerware", 0.5), "licensed under Apache2": ("apache-2", 0.95), "Open Database1.0": ("odbl-1", 0.5), "gplv9 xgplv3 gplv3x": ("", 0.0),
    }
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in got] == list(texts.values())


def test_contained_detections_go(spark):
    def kept(*found):
        rows = [dict(zip(("start", "till", "rule", "label", "priority", "confidence"), f)) for f in found]
        df = spark.createDataFrame([(rows,)], "d array<struct<start:int,till:int,rule:int,label:string,priority:int,confidence:double>>")
        return sorted(df.select(licenses._kept(F.col("d")).alias("k")).first().k.labels)

    assert kept((0, 9, 1, "a", 2, 0.5), (2, 8, 2, "b", 1, 0.5)) == ["a"]
    assert kept((0, 9, 1, "a", 1, 0.5), (2, 8, 2, "b", 2, 0.5)) == ["a", "b"]
    assert kept((0, 9, 2, "a", 1, 0.5), (0, 9, 1, "b", 1, 0.5)) == ["b"]
    assert kept((0, 5, 1, "a", 1, 0.5), (4, 9, 2, "b", 1, 0.5)) == ["a", "b"]
    assert kept((0, 9, 1, "a", 1, 0.5), (0, 5, 2, "b", 1, 0.5), (0, 5, 3, "c", 3, 0.5)) == ["a", "c"]


def random_lines(n, seed):
    r = random.Random(seed)
    pool = [f"line {i}" for i in range(12)]
    return [(i, "\n".join(r.choice([*pool, "", "  "]) for _ in range(r.randint(0, 14)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_that_of_a_scan(spark, seed):
    docs = [*random_lines(60, seed), (900, None), (901, ""), (902, "a\nb"), (903, "x\nx\nx\nx\nx"), (904, "\n".join(f"l{i % 5000}" for i in range(9000)))]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_lines int")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(df).collect()}
    assert got == dedup(docs)


def test_a_first_window_stays_whole_where_later_ones_overlap_it(spark):
    texts = {"A\nA\nA\nA\nB": "A\nA\nA\nB", "x\nx\nx\nx\nx": "x\nx\nx", "a\nb\na\nb\na\nb": "a\nb\na", "p\nq\nr\np\nq\nr": "p\nq\nr"}
    for text, want in texts.items():
        assert linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == want


def test_line_dedup_of_texts_with_many_cuts_takes_linear_time(spark):
    text = "\n".join(["a b", "c d", "e f"] * 20_000)
    got = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == {1: ("a b\nc d\ne f", 59_997), 2: ("", 60_000)}


def test_line_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "q\n" + text)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = [x for x in got if "a" in x[2]]
    assert len(got) == 5 and len(kept) == 1 and not kept[0][0]
    assert got[-3:] == [(True, 1, ""), (True, 1, ""), (True, 2, "")]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_stage_drops_what_is_empty_and_keeps_columns(spark):
    rows = [(1, "a\nb\nc", 5, "en"), (2, "a\nb\nc", 5, "en"), (3, "a\nb\nc\nd", 7, None), (4, None, None, "de"), (5, "", 0, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_lines string")
    assert linededup.stage(spark, docs.limit(0), "").count() == 0 and linededup.stage(spark, docs, "").columns == docs.columns
    got = {r.doc_id: tuple(r)[1:] for r in linededup.stage(spark, docs, "").collect()}
    assert got == {1: ("a\nb\nc", 5, "en"), 3: ("d", 1, None), 4: (None, None, "de"), 5: ("", 0, "de")}


def leak_docs():
    r = random.Random(5)
    some = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(some) for _ in range(n)]
    items = {i: text(r.randint(8, 50)) for i in range(12)}
    docs, want = {}, set()
    for d in range(60):
        body = text(r.randint(0, 300))
        if d % 3 == 0:
            i = r.randrange(12)
            passage = list(items[i])
            for at in range(r.randint(4, 6), len(passage), 9):  # a word replaced here and there
                passage[at] = "zzz"
            at = r.randint(0, len(body))
            body[at:at] = passage
            want.add((d, i))
        docs[d] = ", ".join(body).title() if d % 2 else " ".join(body)
    return docs, {i: " ".join(x) for i, x in items.items()}, want


@pytest.mark.parametrize("block", [decontaminate.BLOCK_SEEDS, 300])
def test_leaks_are_found_with_words_replaced_and_no_others(spark, block):
    docs, items, want = leak_docs()
    d = spark.createDataFrame([*docs.items(), (500, None), (501, ""), (502, "w1 w2"), (0, docs[0])], "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("n_match", F.lit("x"))
    i = spark.createDataFrame([*items.items(), (50, None), (51, "w1 w2"), (52, ""), (0, items[0])], "item_id long, text string")
    got = decontaminate.find_leaks(d, i, block_seeds=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        here = plain_words(docs[r.doc_id])[r.first_word : r.first_word + r.n_aligned]
        assert r.n_match <= r.n_aligned <= r.n_item == len(items[r.item_id].split())
        assert len(set(here) & set(items[r.item_id].split())) >= r.n_match * 0.9


def test_overlaps_are_those_of_a_plain_aligner(spark, monkeypatch):
    docs, items, _ = leak_docs()
    r = random.Random(9)
    long = [f"l{r.randrange(900)}" for _ in range(260)]
    items |= {100: " ".join(long), 101: " ".join(["same"] * 90), 102: "a b a b a b a b a b a b a b c"}
    docs |= {100: " ".join(long), 101: " ".join(long[40:95]) + " x " + " ".join(long[:30]), 102: "same " * 150, 103: "b a b a b a b a b a b a b a b a b c", 104: " ".join(w if k % 9 else "zzz" for k, w in enumerate(long))}
    for piece, margin in ((256, 64), (40, 25)):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        monkeypatch.setattr(decontaminate, "MARGIN", margin)
        got = decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
        found = {(x.doc_id, x.item_id): (x.first_word, x.n_aligned, x.n_match, x.n_item) for x in got.collect()}
        assert found == leaks(docs.items(), items.items(), decontaminate.MASKS, piece=piece, margin=margin)
        assert {d for d, i in found if i == 100} == {100, 101, 104}


def test_items_of_any_length_are_laid_on_in_pieces(spark):
    r = random.Random(2)
    item = " ".join(f"w{r.randrange(5000)}" for _ in range(20_000))
    docs = [(1, item), (2, " ".join(item.split()[250:270])), (3, "x " * 20_000), (4, " ".join(item.split()[-15:]))]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (1, item)], "item_id long, text string"))
    found = {x.doc_id: (x.first_word, x.n_aligned, x.n_match, x.n_item) for x in got.collect()}
    assert found == {1: (192, 384, 384, 20_000), 2: (0, 20, 20, 20_000), 4: (0, 15, 15, 20_000)}


def test_decontamination_stage_of_odd_rows(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, leak, "a", 9), (1, leak, "b", 9), (None, leak, "c", 9), (None, leak, "d", 9), (2, None, "e", 9), (3, "", "f", 9), (4, "fine", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, n_match int")
    path = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/leaks"
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    assert sorted(r.doc_id for r in decontaminate.stage(spark, docs, path).collect()) == [2, 3, 4]
    assert decontaminate.stage(spark, docs, path).columns == docs.columns
    assert decontaminate.stage(spark, docs.limit(0), path).count() == 0
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    assert decontaminate.stage(spark, docs, path).count() == len(rows)


def test_short_and_unlike_items_leak_nothing(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven"), (None, "a b c d e f g h i j")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one two three four five six seven"), (None, "a b c d e f g h i j"), (2, "a x c x e x g x i x")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.find_leaks(d, i).collect()] == [(None, None)]
    assert decontaminate.find_leaks(d.limit(0), i).count() == 0 == decontaminate.find_leaks(d, i.limit(0)).count()


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else target[s] for s in order}
        full |= over


def mix_rows(seed=3, n=300):
    r = random.Random(seed)
    rows = [(i, "src" if i % 3 == 0 else r.choice(["a", "b", "é", "Z", None]), " ".join(["w"] * r.randint(0, 40))) for i in range(n)]
    return [*rows, (None, "a", "x y"), (7000, "b", None), (7001, "only empty", ""), rows[0], rows[0], (8000, "a", "v " * 30_000)]


def test_mix_meets_its_targets_exactly(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, source string, text string, target string").repartition(3)
    got = mixing.mix_sources(df)
    assert got.columns.count("target") == 1
    out = got.collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = water(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert taken[s] == round(want[s]) and want[s] <= 2 * sizes[s]
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix_sources(df.repartition(5, "size" if False else "text")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert [(r.doc_id, r.taken) for r in sorted(out, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    partial = defaultdict(int)
    for r in out:
        partial[r.source] += r.size > 0 and r.taken % r.size > 0
    assert max(partial.values()) <= 1


def test_mix_of_little_and_nothing(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, "a", None), (2, None, "")], schema)).agg(F.sum("taken")).first()[0] == 0
    one = mixing.mix_sources(spark.createDataFrame([(1, "a", "x y z w")], schema)).first()
    assert (one.target, one.taken) == (6.0, 6)


def test_mix_takes_tables_with_any_columns(spark):
    names = ["n", "budget", "limit", "target", "ratio", "weight", "level", "full", "range", "sum", "source_size", "s", "all", "N_", "taken"]
    rows = [(i, "ab"[i % 2], "x y z " * (i % 5)) for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, source string, text string")
    wide = plain.withColumns({c: F.lit(f"own {c}") for c in names})
    got = mixing.mix_sources(wide)
    assert set(got.columns) == {*wide.columns, "size", "source_size", "target", "taken"} and len(got.columns) == len(set(got.columns))
    assert {(r.doc_id, r.target, r.taken) for r in got.collect()} == {(r.doc_id, r.target, r.taken) for r in mixing.mix_sources(plain).collect()}
    assert {(r.n, r.budget, r.limit) for r in got.collect()} == {("own n", "own budget", "own limit")}
    assert mixing.stage(spark, wide, "").where("text = '' OR taken = 0").count() == 0 == mixing.stage(spark, wide.limit(0), "").count()


def test_mix_over_many_ranges_is_one_running_sum(spark):
    rows = [(i, "s", t) for i, t in enumerate(made_texts(400, seed=9))]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.3).collect()
    assert sum(r.taken for r in out) == round(0.3 * sum(r.size for r in out))
    assert sum(0 < r.taken < r.size for r in out) <= 1
