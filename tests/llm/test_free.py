"""HTML text, archives, n-gram join, quality, chats, URLs."""

import base64
import gzip
import hashlib
import html.parser
import io
import json
import random
import time
import zipfile
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from helpers import base_quality, groups, made_texts
from pyspark.sql import functions as F

from quillmill.llm import chat, common, graph, htmltext, ngramjoin, quality, urlfilter, warc

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>'
    '<div class="ad">Buy</div><article><h1>Head</h1><p><b>One &amp; two&nbsp;&lt;x&gt;<br>three<p>Ti.<p>l<i>ong</i>er <a href="#">link</a></p><aside>More</aside><form>Name <button>Go</button></form>'
    '<div id="comments"><p>A reader wrote a lot of words here that nobody wants to have in the text at all</p></div></article><footer>&copy; x</footer><div class="cookie-notice">Cookies</div></body></html>'
)


def test_main_text_of_an_article():
    assert htmltext.main_text(PAGE) == "Head\nOne & two <x> three\nTi.\nlonger link"


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("<article>" + "x" * 200_000, "x" * 200_000), ("<article>a<br><br>b", "a\nb"), ("<article>a<!-- b -->c<![CDATA[d]]></article>", "acd"), ("<main><p>in</p></main><p>" + "out " * 60, "in"),
    ("<article>&#65;&#x42;&eacute;&amp;amp;</article>", "ABé&amp;"), ("<article>a < b > c</article>", "a < b > c"), ("<article><p title='>'>q</p", "q"), ("<ARTICLE><P>Q</ARTICLE>", "Q"), ("</div></article><article>z", "z"),
])
def test_main_text_of_odd_pages(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("wrapper", [
    "div class='layout with-sidebar'", "div class=no-sidebar", "div id='page' class='has-sidebar'", "div class=fixed-header", "div class='layout sidebar'", "div class='modal'", "form id=aspnetForm", "div hidden", "section class='side-effects'",
])
@pytest.mark.parametrize("part", ["article", "main"])
def test_an_article_is_wanted_whatever_it_stands_in(wrapper, part):
    tag = wrapper.split()[0]
    page = f"<{wrapper}><nav>Menu</nav><{part}><h1>Head</h1><p>Text</p><aside>More</aside><p>End</p></{part}><p>Beside</p></{tag}><footer>Foot</footer>"
    assert htmltext.main_text(page) == "Head\nText\nEnd"


@pytest.mark.parametrize("name", ["discussion", "related-work", "side-effects", "search-algorithms", "with-sidebar", "no-ads", "ad-hoc-networks", "navier-stokes", "has-comments", "chocolate-cookies", "fixed-header"])
@pytest.mark.parametrize("attribute", ["id", "class"])
def test_sections_of_an_article_are_kept(name, attribute):
    assert htmltext.main_text(f"<article><p>One</p><div {attribute}='{name}'><p>Two</p></div><p>Three</p></article>") == "One\nTwo\nThree"


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "ad_300x250", "sidebar", "left-sidebar", "related", "related-posts", "share-buttons", "cookie-notice", "newsletter-signup", "site-header", "post-comments", "x comments", "navigation", "search-form", "advertisement"])
def test_unwanted_sections_of_an_article_go(name):
    assert htmltext.main_text(f"<article><p>One</p><div class='{name}'><p>Two</p></div><p>Three</p></article>") == "One\nThree"


def test_marks_within_an_article_hold_for_articles_in_it():
    page = "<article><p>One</p><div id=comments><article>Two</article></div><div id=related><div><article>Three</article></div></div><p>Four</p></article><div class=sidebar>Five</div>"
    assert htmltext.main_text(page) == "One\nFour"


@pytest.mark.parametrize("wrapper", ["div id=comments", "aside", "footer", "div class=related-posts", "div role=complementary"])
def test_teasers_and_comments_beside_an_article_go(wrapper):
    assert htmltext.main_text(f"<article>One</article><{wrapper}><article>Two</article></{wrapper.split()[0]}><div class=widget><p>Three</p></div>") == "One"


def test_formulas_and_what_stands_in_for_scripts_and_objects_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><noscript><p>No script</p></noscript><object data=a>An object</object></article>"
    assert htmltext.main_text(page) == "Let x=1 be.\nNo script\nAn object"


def test_pages_without_a_marked_part_go_by_words_and_links():
    page = "<div><a href=a>x</a> <a href=b>y</a></div><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p><div><a href=c>Contact us</a></div>"
    assert htmltext.main_text(page) == " ".join(["word"] * 40) + "\n" + " ".join(["more"] * 30)


def test_words_links_and_neighbours_decide_on_pages_without_marks():
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    right = 0
    for _ in range(60):
        menu = [f"<a href=/{k}>{text(r.randint(1, 2))}</a>" for k in range(r.randint(2, 6))]
        body = [text(r.randint(6, 12))] + [text(n) for _ in range(r.randint(2, 6)) for n in (r.randint(30, 120), r.choice([1, 2, 40, 70]))] + [text(40)]
        blocks = [*menu, text(r.randint(5, 11)), *body, f"{text(r.randint(5, 12))}"]
        page = "".join(f"<div class=c{r.randrange(99)}>{b}</div>" for b in blocks)
        right += htmltext.main_text(page) == "\n".join(body)
    assert right >= 54


def test_the_tree_alone_gives_what_marks_give_on_most_pages(data):
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{data}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    tree = htmltext.default_tree()
    assert sum(htmltext.main_text(p, tree, marks=False) == htmltext.main_text(p, tree) for p in pages) >= 0.95 * len(pages) > 10


def test_extracted_pages_are_the_articles_that_a_plain_parser_cuts_out(data):
    class Plain(html.parser.HTMLParser):
        """Text of the article in blocks; the pages are plain enough for that."""

        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.blocks += [""] * (tag in ("p", "h1", "article"))
            self.blocks[-1] += " " * (tag == "br")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.blocks += [""] * (tag in ("p", "h1", "article"))

        def handle_data(self, text):
            self.blocks[-1] += text * (self.inside > 0)

    for (page,) in duckdb.sql(f"SELECT html FROM '{data}/pages.parquet'").fetchall():
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        assert htmltext.main_text(page) == "\n".join(filter(None, (" ".join(b.split()) for b in plain.blocks)))


def test_headlines_in_the_header_of_an_article_stay():
    page = "<header><h1>Site</h1></header><article><header><p>By X</p><h1>Head</h1><p>Today</p></header><p>Text</p><section><header><h2>Part</h2>Note</header><p>More</p></section></article>"
    assert htmltext.main_text(page) == "Head\nText\nPart\nMore"


def test_the_tree_learns_its_table_and_goes_by_marks_where_there_are_some():
    rows, labels = htmltext._rows(htmltext.LABELLED)
    tree = htmltext.default_tree()
    assert [htmltext.classify(tree, r) for r in rows] == labels
    r = random.Random(1)
    for _ in range(3000):
        row = [r.choice([0, 1, 2, 9, 35, 36, 90, 400]), r.random(), r.choice([0, 1, 9, 90]), r.random(), r.choice([0, 1, 9, 90]), r.random()]
        assert htmltext.classify(tree, (*row, 1)) == 1 and htmltext.classify(tree, (*row, -1)) == 0


def test_unclosed_markup_is_read_in_linear_time():
    assert htmltext.main_text("<article>" + "<a b " * 20_000) == ""


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None), (None, "<article>é", "y")], "page_id long, html string, text string")
    got = htmltext.extract_text(df)
    assert got.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((r.n_chars, r.text) for r in got.collect())[:2] == [(0, ""), (1, "é")]
    assert htmltext.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files_read_by_range(zip64):
    rows = [(i, f"http://x/{i}", f"payload {i}".encode() * i, None, False) for i in range(20)]
    reads = []
    for a in warc.write_archives(rows, 400, zip64):
        z = zipfile.ZipFile(io.BytesIO(a))
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())

        def read(start, n, a=a):
            assert 0 <= start and start + n <= len(a)
            return a[start : start + n]

        reads += [(r["warc-record-id"], p) for r, _, p in warc.read_archive(read, len(a))]
    assert reads == [(f"<urn:page:{i}>", p) for i, _, p, _, _ in rows]


@pytest.mark.parametrize("wide", [False, True])
def test_directories_of_other_writers_are_read(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("a/é.bin"), "w", force_zip64=wide) as f:
            f.write(b"0123456789")
        z.writestr(zipfile.ZipInfo("packed"), b"z" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a note"
    data = out.getvalue()
    index = warc.ZipIndex(lambda s, n: data[s : s + n], len(data))
    assert list(index.members) == ["a/é.bin"] and index.slice("a/é.bin", 2, 3) == b"234"
    with pytest.raises(ValueError, match="range"):
        index.slice("a/é.bin", 8, 3)
    with pytest.raises(ValueError, match="ZIP"):
        warc.ZipIndex(lambda s, n: b"x" * n, 50)


def test_sizes_beyond_four_gigabytes_are_read_from_the_wide_records():
    a = warc.pack_zip([("m", b"data")], True).replace(warc.struct.pack("<QQQ", 4, 4, 0), warc.struct.pack("<QQQ", 5 << 32, 5 << 32, 0))
    assert warc.ZipIndex(lambda s, n: a[s : s + n], len(a)).members == {"m": (0, 5 << 32)}


def test_damaged_records_are_refused():
    record = warc.warc_record(1, "http://x", b"abc")
    assert warc.parse_record(record)[2] == b"abc"
    with pytest.raises(ValueError, match="cut short"):
        warc.parse_record(record[:-3])


def archived(spark, tmp_path, rows, least=0, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, last string")
    path = f"{tmp_path}/archives-{random.random()}"
    warc.archive_pages(df, path, least, **how)
    names = {r.name for r in spark.read.parquet(f"{path}/listed").collect()}
    assert names == {p.name for p in Path(f"{path}/files").glob("*.zip")}
    for p in Path(f"{path}/files").glob("*.zip"):
        assert zipfile.ZipFile(p).testzip() is None
    (Path(path) / "files" / "left.zip").write_bytes(b"left by a lost task")
    return sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=repr)


def test_pages_come_back_with_revisits(spark, tmp_path):
    html = {1: "same", 2: "same", 3: "same", 4: "é", 5: None, 6: "", 7: "x" * 50_000}
    rows = [(k, f"http://x/{k}\n y", v, "z") for k, v in html.items()] + [(8, None, "other", None), (None, "http://n", "same", None), (3, "http://x/3", "same", None), (8, "u", "not other", "q")]
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = defaultdict(lambda: -1)
    for k, _, v, _ in rows:
        last[v or ""] = max(last[v or ""], -1 if k is None else k)
    want = sorted(((k, len((v or "").encode()), digest(v), "response" if k == last[v or ""] else "revisit", None if k == last[v or ""] else last[v or ""]) for k, _, v, _ in rows), key=repr)
    assert archived(spark, tmp_path, rows) == want
    assert archived(spark, tmp_path, rows, archive_bytes=200, zip64=False) == want
    small = {r[0]: r[3] for r in archived(spark, tmp_path, rows, least=5)}
    assert small[1] == small[2] == "response"
    assert archived(spark, tmp_path, []) == []


def test_only_directories_indexes_and_records_are_read():
    rows = [(i, "u", bytes([i]) * 3000, None, False) for i in range(50)]
    (archive,) = warc.write_archives(rows, 1 << 30, True)
    reads = []

    def read(start, n):
        reads.append((start, n))
        return archive[start : start + n]

    z = warc.ZipIndex(read, len(archive))
    line = z.slice(warc.INDEX).decode().split("\n")[7]
    about = json.loads(line.split(" ", 2)[2])
    reads.clear()
    assert warc.parse_record(gzip.decompress(z.slice(about["filename"], int(about["offset"]), int(about["length"]))))[2] == bytes([7]) * 3000
    assert [n for _, n in reads] == [30, int(about["length"])]  # the member's header and the record


def test_the_query_leaves_no_archives(spark, data):
    before = {str(p) for p in Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")).glob("archives-*")}
    assert warc.query(spark, data).count() == spark.read.parquet(f"{data}/pages.parquet").count()
    assert {str(p) for p in Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")).glob("archives-*")} == before


def test_join_is_that_of_all_pairs(spark):
    docs = list(enumerate(made_texts(320, seed=4))) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, "é\xa0a b c d e f g"), (907, "v " * 30_000)]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component_id string")
    want = groups(docs)
    assert len({c for _, c in want.values()}) < len(want) - 40
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.similar_groups(df).collect()} == want


@pytest.mark.parametrize(("listed", "frequent", "parts"), [(2, 2, 3), (32, 1, 2), (2, 8, 100_000)])
def test_join_with_long_lists_in_blocks_and_in_parts(spark, monkeypatch, listed, frequent, parts):
    monkeypatch.setattr(ngramjoin, "LISTED", listed)
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "PART_ROWS", parts)
    monkeypatch.setattr(ngramjoin, "LED", min(4, listed))
    monkeypatch.setattr(ngramjoin, "PAIRS", 3)
    monkeypatch.setattr(ngramjoin, "SEARCHING", 4)
    monkeypatch.setattr(ngramjoin, "SEARCHED", 6)
    r = random.Random(8)
    seed = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):  # one large group of near copies, many of which are not near each other
        w = list(seed)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(9999)}"
        docs.append((i, " ".join(w)))
    docs += [(500 + i, t) for i, t in enumerate(made_texts(60, seed=6))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == groups(docs)


def _alive(spark):
    """Shuffles that Spark has not cleaned up yet."""
    return {int(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(",") if x}


def test_the_shuffle_of_the_postings_goes_before_the_lists_are_joined(spark, monkeypatch):
    """Each step of op7 finds the disk free of the shuffles of the step before."""
    made, left, keep = set(), [], ngramjoin.Scratch.keep

    def kept(self, df, name):
        until = time.time() + 10
        while made & _alive(spark) and time.time() < until:  # the cleaner works beside
            time.sleep(0.1)
        left.append((name, len(made & _alive(spark))))
        before, out = _alive(spark), keep(self, df, name)
        made.clear()
        made.update(_alive(spark) - before)
        return out

    monkeypatch.setattr(ngramjoin.Scratch, "keep", kept)
    docs = list(enumerate(made_texts(60, seed=6)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == groups(docs)
    assert [x for x in left if x[0] == "lists"] == [("lists", 0)] * 3


@pytest.mark.parametrize("listed", [1, 32])
def test_texts_are_moved_in_turns(spark, monkeypatch, listed):
    """Whether pairs or blocks: a turn takes about half of the candidates' texts, and the turns together give all links."""
    for name, value in {"MOVED": 2, "LISTED": listed, "LED": 1, "LEADER_ROUNDS": 1, "FREQUENT": 3, "SEARCHING": 4, "SEARCHED": 5, "PAIRS": 4}.items():
        monkeypatch.setattr(ngramjoin, name, value)
    turns, moved = [], ngramjoin._in_turns

    def counted(n, held, work):
        now = []
        out = moved(n, held, lambda chosen: now.append(1) or work(chosen))
        turns.append((n, held, len(now)))
        return out

    monkeypatch.setattr(ngramjoin, "_in_turns", counted)
    docs = list(enumerate(made_texts(90, seed=4)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == groups(docs)
    assert all(k == max(1, -(-n // max(2, held // 2))) for n, held, k in turns) and max(k for _, _, k in turns) > 1


def test_documents_that_share_much_but_not_enough_are_not_held_against_each_other(spark, monkeypatch):
    """85 of 100 shingles are common to all: no pair links, and no block is searched."""
    searched = []
    monkeypatch.setattr(ngramjoin, "_searched", lambda *args: searched.append(1) or 1 / 0)
    common = " ".join(f"c{i}" for i in range(89))
    docs = [(i, common + " " + " ".join(f"u{i}x{k}" for k in range(15))) for i in range(200)] + [(500, common + " " + " ".join(f"u7x{k}" for k in range(14)) + " z")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (100, 7 if i == 500 else i) for i, _ in docs} and not searched


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_of_texts_that_share_boilerplate_is_that_of_all_pairs(spark, monkeypatch, seed):
    r = random.Random(seed)
    for name, value in {"LISTED": r.choice([1, 2, 4]), "LED": r.choice([1, 3]), "LEADER_ROUNDS": r.choice([0, 1]), "FREQUENT": r.choice([1, 3]), "SEARCHING": 4, "SEARCHED": 5, "PART_ROWS": r.choice([2, 9, 100_000]), "PAIRS": 4}.items():
        monkeypatch.setattr(ngramjoin, name, value)
    base = [[f"b{k}x{i}" for i in range(r.randint(40, 120))] for k in range(3)]
    docs, last = [], []
    for i in range(130):
        b = r.choice(base)
        words = b[: max(5, int(len(b) * r.choice([0.5, 0.8, 0.9, 0.95, 1])))] + [f"u{i}x{k}" for k in range(int(len(b) * r.choice([0, 0.02, 0.1, 0.15, 0.25])))]
        if last and r.random() < 0.4:
            words = [w if r.random() > 0.02 else f"y{i}" for w in r.choice(last)]
        last.append(words)
        docs.append((i, " ".join(words)))
    want = groups(docs)
    assert 10 < len({c for _, c in want.values()}) < 125
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_a_set_owns_the_first_of_its_short_lists():
    r = np.random.default_rng(5)
    order = ngramjoin.Order([(int(x), int(c)) for x, c in zip(r.integers(-(2**62), 2**62, 50), r.integers(8, 99, 50))])
    for n in (1, 2, 3, 7, 39, 40, 200):
        s = np.unique(np.concatenate([r.choice(order.hashes, min(n, 20), False), r.integers(1, 2**63, max(0, n - 20)).astype(np.uint64)]))
        keys, at, own = order.place(s)[0], order.short(s), order.owned(len(s))
        least = sorted(keys.tolist())
        assert sorted(keys[at].tolist()) == least[: len(at)] and sorted(keys[at[:own]].tolist()) == least[:own] and own <= len(at)


def test_join_of_repeated_ids_null_ids_and_nothing(spark):
    a, b, c = ("one two three four five six seven", "ein zwei drei vier fünf sechs sieben", "uno dos tres cuatro cinco seis siete")
    long = " ".join(f"l{i}" for i in range(200))
    rows = [(5, a), (5, b), (2, a), (3, b), (7, c), (None, c), (None, a), (9, c), (9, c), (9, long), (11, long + " m")]
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in ngramjoin.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 0), (0, 0), (2, 2), (3, 2), (5, 2), (5, 2), (7, 7), (9, 7), (9, 7), (9, 7), (11, 7)]
    assert ngramjoin.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_takes_integer_ids_only(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError, match="ids are integers"):
        ngramjoin.similar_groups(docs)
    for kind in ("smallint", "decimal(10,0)"):
        ints = spark.createDataFrame([(1, "x y"), (2, "X  y")], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        assert {(r.doc_id, r.component_id) for r in ngramjoin.similar_groups(ints).collect()} == {(1, 1), (2, 1)}


def test_divide_skip_finds_what_a_scan_finds():
    r = np.random.default_rng(3)
    sets = []
    for i in range(80):
        s = r.choice(400, r.integers(1, 60), False) if i % 2 == 0 else np.concatenate([sets[-1][: -r.integers(1, 4)], r.choice(400, 3)])
        sets.append(np.unique(s).astype(np.uint64))
    lengths = np.array([len(s) for s in sets])
    owners, hashes = np.repeat(np.arange(80), lengths), np.concatenate(sets)
    by = np.argsort(hashes, kind="stable")
    for s in sets:
        want = [i for i, t in enumerate(sets) if ngramjoin.linked(s, t)]
        both = [len(np.intersect1d(s, t)) for t in sets]
        assert want == [i for i, t in enumerate(sets) if 100 * both[i] >= 80 * (len(s) + len(t) - both[i])]
        assert ngramjoin.divide_skip(hashes[by], owners[by], lengths, s).tolist() == want


def test_join_stage_keeps_one_of_each_group(spark):
    a, b = "one two three four five six seven", "uno dos tres"
    rows = [(5, a, "en"), (2, a, None), (2, a, None), (7, b, "es"), (8, None, "x"), (None, a, "n"), (None, b, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id or 0, r.lang or "") for r in ngramjoin.stage(spark, docs, "").collect()))
    assert got == [(0, "n"), (0, "n"), (2, ""), (7, "es"), (8, "x")]
    assert ngramjoin.stage(spark, docs.limit(0), "").count() == 0 and ngramjoin.stage(spark, docs, "").columns == docs.columns


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


GOOD = "The quick brown fox walks over the hill and sees a river. " * 1


def quality_texts():
    r = random.Random(3)
    good = lambda n: " ".join(r.choice(["tree", "river", "stone", "walks", "over", "under", "quiet", "house"]) + str(r.randrange(99)) for _ in range(n))
    return [None, "", " \n ", good(10), good(80), "\n".join(good(20) for _ in range(6)), good(60) + "\n" + good(60).replace(" ", " | "), " ".join(w + "***" for w in good(80).split()), "a b c " * 40, "A!! B!! " * 50, "x" * 90_000, good(30) + "\n" + good(30) + "\n" + good(5) + "\n" + good(5), "same line here\n" * 30, "é\xa0ü " * 60, "\x0b\x0c\r#"]


def test_base_counts_and_verdict(spark):
    texts = quality_texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, kept int")
    for r in quality.judge_quality(df).collect():
        want = base_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge_quality(df.limit(0)).count() == 0


def test_viterbi_finds_the_best_labels():
    r = np.random.default_rng(1)
    for _ in range(30):
        field = quality.LineField(r.normal(size=len(quality.FEATURES)), r.normal(size=(2, 2)))
        rows = r.normal(size=(r.integers(1, 8), len(quality.FEATURES)))
        gain = rows @ field.emission
        score = lambda y: sum(g for g, k in zip(gain, y) if k) + sum(field.transition[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max((tuple(int(b) for b in f"{i:0{len(rows)}b}") for i in range(2 ** len(rows))), key=score)
        assert score(field.decode(rows).tolist()) == pytest.approx(score(best))
    assert field.decode(np.zeros((0, len(quality.FEATURES)))).tolist() == []


def test_marginals_are_those_of_all_labelings():
    r = np.random.default_rng(2)
    texts = [r.normal(size=(n, 3)) for n in (5, 1, 4, 7)]
    c = quality.Chains.of(texts, 4)
    w, t = r.normal(size=3), r.normal(size=(2, 2))
    gain = c.x @ w
    single, pair = quality._marginals(np.stack([np.zeros_like(gain), gain], -1), t, c)
    assert len(c.x) == 17 and sorted(c.text.tolist()) == [0] * 5 + [1] + [2] * 4 + [3] * 7
    for k in range(c.chain.max() + 1):
        on = np.flatnonzero(c.chain == k)
        n = len(on)
        ways = [tuple(int(b) for b in f"{i:0{n}b}") for i in range(2**n)]
        score = np.exp([sum(g for g, y in zip(gain[on], ys) if y) + sum(t[a, b] for a, b in zip(ys, ys[1:])) for ys in ways])
        share = score / score.sum()
        for j in range(n):
            assert single[on[j], 1] == pytest.approx(sum(p for p, ys in zip(share, ways) if ys[j]))
            if j + 1 < n:
                assert pair[on[j], 0, 1] == pytest.approx(sum(p for p, ys in zip(share, ways) if ys[j : j + 2] == (0, 1)))


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of sf0.01 with their labels, and a field of two thirds of them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality.sample_field(docs.where("doc_id % 3 <> 0"), labels)
    return [(r.quality, *quality.describe(r.text), r.text) for r in docs.where("doc_id % 3 = 0").join(labels, "doc_id").select("quality", "text").collect()], field


def test_a_fitted_field_tells_held_out_documents_apart(labelled):
    rows, field = labelled
    rows = [(q, field.content_share(x, sizes) >= quality.CONTENT_SHARE) for q, counts, x, sizes, _ in rows if counts["n_words"] >= 50 and 2 * counts["n_repeat_words"] <= counts["n_words"]]
    assert len(rows) > 80 and sum(bool(q) == k for q, k in rows) / len(rows) > 0.97


def test_lines_of_one_document_get_both_labels(labelled):
    rows, field = labelled
    shares = [field.content_share(x, sizes) for q, _, x, sizes, _ in rows if q == 0 and len(sizes) > 2]
    assert sum(0 < s < 1 for s in shares) >= 0.4 * len(shares) > 2
    junk = "\n".join(["Menu*** home### about%%% terms$$$ login&&&"] * 3 + ["home | about | terms | login | help | more |"] * 3)
    good = [t for q, counts, _, _, t in rows if q == 1 and 3 < len(t.split("\n")) < 12 and counts["n_words"] > 80][:20]
    assert len(good) > 8
    right = total = 0
    for text in good:
        for made, n_before in ((junk + "\n" + text, 6), (text + "\n" + junk, 0)):
            counts, x, sizes = quality.describe(made)
            want = np.array([0] * n_before + [1] * (len(sizes) - 6) + [0] * (6 - n_before))
            right, total = right + (field.decode(x) == want).sum(), total + len(want)
            assert 0 < field.content_share(x, sizes) < 1
    assert right / total > 0.9


def test_the_sample_is_bounded_by_lines_and_takes_documents_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(["a line of words here"] * (i + 1)), 1) for i in range(40)], "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_field", lambda xs, ys: seen.append([len(x) for x in xs]))
    for lines in (100_000, 200):
        quality.sample_field(docs, labels, lines=lines)
    assert sorted(seen[0]) == list(range(1, 41)) and sum(seen[1]) <= 200 and seen[1] == seen[0][: len(seen[1])] and len(seen[1]) > 2


def test_quality_stage_keeps_columns_and_rows(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", 5), (1, good, "en", 5), (2, None, "en", 0), (3, "", "x", 0), (None, good, None, 1), (4, "short", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.kept, r.n_words) for r in got.collect()) == [(0, None, 1), (1, "en", 5), (1, "en", 5)]
    assert quality.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_without_labels_of_both_kinds_the_default_stays(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = "doc_id long, quality int, toxic int"
    assert quality.sample_field(docs, spark.createDataFrame([], labels)) is quality.DEFAULT
    assert quality.sample_field(docs, spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, 0, 0), (1, None, None)], labels)) is quality.DEFAULT


def test_snapshots_collapse_to_the_longest(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "bot", "other"), (4, 1, "bot", "other"),
        (5, 0, "user", "hi"), (5, 1, "bot", "yo"), (5, 2, "user", ""), (6, 0, "us", "erhi"), (7, 0, None, "hi"), (8, 0, "user", "hi"), (8, 1, "bot", "other"), (None, 0, "user", "alone"), (9, 1, "a", "x"), (9, 0, "b", "y"), (10, None, "q", "w" * 50_000),
    ]
    got = {r.conv_id: r for r in chat.collapse_snapshots(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")).collect()}
    assert set(got) == {3, 4, 5, 6, 7, None, 9, 10}
    assert got[4].n_copies == 2 and got[4].n_turns == 2
    assert got[9].text == "<|im_start|>b\ny<|im_end|>\n<|im_start|>a\nx<|im_end|>\n"
    assert got[7].text == "<|im_start|>unknown\nhi<|im_end|>\n"
    assert chat.collapse_snapshots(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_snapshots_against_all_pairs(spark):
    r = random.Random(4)
    convs = {}
    for c in range(150):
        old = r.choice(list(convs.values())) if convs and r.random() < 0.7 else []
        convs[c] = old[: r.randint(0, len(old))] + [(r.choice("ab"), r.choice("xyz")) for _ in range(r.randint(0 if old else 1, 3))] or [("a", "x")]
    whole = [tuple(t) for t in convs.values()]
    want = {min(c for c, t in convs.items() if tuple(t) == w) for w in set(whole) if not any(len(v) > len(w) and v[: len(w)] == w for v in whole)}
    rows = [(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts)]
    assert {x.conv_id for x in chat.collapse_snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()} == want


URLS = [
    "https://a.example.net/en/x", "https://a.example.net/EN/x", "http://example.net", "http://EXAMPLE.NET/?q", "http://example.com/de/", "http://x.example.com/de", "http://y.org/fr/1#z", "http://org/fr/", "http://borg/fr/", "ftp://u@h.org:80/p?q#f",
    "http://cheap-pills.example.com/a", "http://www.cheap-pills.example.com", "http://notcheap-pills.example.com/", "http://spam-farm.example.net/en/", "no url", "", None, "a://b://c/d", "http:///path", "http://h\nx/p\nq?r", "x" * 70_000 + "://h/" + "p" * 70_000, "http://É.net/",
]


def judged(url, blocked=()):
    _, sep, rest = (url or "").partition("://")
    host = ""
    while sep and rest and rest[0] not in "/?#":
        host, rest = host + rest[0], rest[1:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = "" if not sep else rest.split("?")[0].split("#")[0]
    fits = [(v, h + p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    verdict, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
    mine = any(host == b or host.endswith("." + b) or host + path == b for b in blocked)
    return host, path, rule, verdict or ("block" if mine and host else "allow")


@pytest.mark.parametrize("max_bytes", [urlfilter.MAX_SHIPPED_BYTES, 4000])
def test_urls_by_rules_and_list(spark, max_bytes):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, max_bytes=max_bytes, blocklist=urlfilter.default_blocklist()).collect()}
    assert got == {i: judged(u, urlfilter.default_blocklist()) for i, u in enumerate(URLS)}
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_a_list_may_be_a_table_and_may_be_empty(spark):
    df = spark.createDataFrame([(1, "http://bad.x/p"), (2, "http://ok.x/"), (3, "http://ok.x/p")], "page_id long, url string")
    names = spark.createDataFrame([("bad.x",), ("ok.x/p",), ("bad.x",), (None,)], "name string")
    for most in (urlfilter.MAX_SHIPPED_BYTES, 8):
        assert {r.page_id: r.verdict for r in urlfilter.judge_urls(df, blocklist=names, max_bytes=most).collect()} == {1: "block", 2: "allow", 3: "block"}
    assert {r.verdict for r in urlfilter.judge_urls(df, blocklist=names.limit(0)).collect()} == {"allow"}
    assert {r.verdict for r in urlfilter.judge_urls(df, blocklist=[]).collect()} == {"allow"}


def test_a_long_list_is_probed_in_shards(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PROBED", 50)
    r = random.Random(7)
    host = lambda: ".".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(1, 3)))
    urls = [f"http://{host()}/{r.choice(['', 'p', 'q/r'])}" for _ in range(600)]
    listed = [host() for _ in range(120)] + ["ab.c/p", "a/q/r"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, name string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge_urls(df, blocklist=spark.createDataFrame([(x,) for x in listed], "name string"), max_bytes=500).collect()}
    assert got == {i: judged(u, listed) for i, u in enumerate(urls)} and {v[3] for v in got.values()} == {"block", "allow"}


def test_the_example_list_goes_by_trades():
    names = urlfilter.default_blocklist()
    assert len(names) == len(set(names)) > 600
    assert {"casino-win.example.com", "free-bets.example.com", "ads-track.example.com", "adult-x.example.net", "spam-farm.example.org", "cheap-pills.example.com"} <= set(names)


def test_equal_keys_are_told_apart_by_the_strings(tmp_path):
    clash = lambda b: len(b) % 3
    names = ["a", "bb", "ccc", "dddd", "eeeee", ""]
    (tmp_path / "d").write_bytes(urlfilter.DigestArray.pack(names, clash))
    array = urlfilter.DigestArray.open(str(tmp_path / "d"))
    asked = [b"a", b"x", b"dddd", b"xxxx", b"", b"ccc", b"xxx"]
    assert array.contains(asked, clash).tolist() == [True, False, True, False, True, True, False]
    assert urlfilter.DigestArray(urlfilter.DigestArray.pack([])).contains([b"a"]).tolist() == [False]
    assert gzip.decompress(gzip.compress(b"x")) == b"x"


def test_postings_and_meetings_go_in_turns(spark, monkeypatch):
    """No turn shuffles all postings, nor all meetings on short lists, and the turns together give all links."""
    for name, value in {"POSTED": 100, "COUNTED": 20, "LED": 4, "LISTED": 32, "FREQUENT": 3}.items():
        monkeypatch.setattr(ngramjoin, name, value)
    posts, turned, post, by_turns = [], [], ngramjoin._post, ngramjoin._by_turns
    monkeypatch.setattr(ngramjoin, "_post", lambda *a: posts.append(a[3:]) or post(*a))
    monkeypatch.setattr(ngramjoin, "_by_turns", lambda turns, work: turned.append(turns) or by_turns(turns, work))
    docs = list(enumerate(made_texts(90, seed=4)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == groups(docs)
    assert len(posts) > 1 and posts == [(turn, len(posts)) for turn in range(len(posts))] and max(turned) > 1


def test_shuffles_of_a_round_of_components_go_before_the_next(spark, monkeypatch):
    released = []
    monkeypatch.setattr(graph, "MANY", 5)
    monkeypatch.setattr(graph, "release", lambda spark: released.append(1))
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    assert {r.component for r in graph.components(edges).collect()} == {0} and len(released) > 1


@pytest.mark.parametrize("many", [0, 100_000])
def test_few_links_take_no_rounds_and_rounds_give_the_same(spark, monkeypatch, many):
    stars, star = [], graph._stars
    monkeypatch.setattr(graph, "MANY", many)
    monkeypatch.setattr(graph, "_stars", lambda *a: stars.append(1) or star(*a))
    r = random.Random(7)
    edges = [(r.randrange(-60, 60) * 10**15, r.randrange(-60, 60) * 10**15) for _ in range(50)] + [(8, 8), (5, None), (9, 3), (3, 9)] + [(i, i + 1) for i in range(100, 130)]
    want = {x: {x} for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a in want and b in want and want[a] is not want[b]:
            want[a] |= want[b]
            want |= {x: want[a] for x in want[b]}
    found = graph.components(spark.createDataFrame(edges, "u long, v long"))
    got = [(x.node, x.component) for x in found.collect()]
    assert found.dtypes == [("node", "bigint"), ("component", "bigint")]
    assert sorted(got) == sorted((x, min(s)) for x, s in want.items()) and bool(stars) == (many == 0)
    assert graph.components(spark.createDataFrame([(4, 4)], "u long, v long")).collect() == []


def test_stages_move_only_the_texts_that_may_go(spark, tmp_path):
    """Stages 3 and 4 hold few documents against ids; all others stay without a join."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(300)] + [(300, " ".join(f"w7x{k}" for k in range(12))), (None, "a b"), (5, "a b"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rest, met = common.split_by_ids(docs, spark.createDataFrame([(300,), (5,), (None,)], "i long"), F.col("doc_id"))
    assert {r.doc_id for r in met.collect()} >= {300, 5, None} and met.count() < 20 and rest.count() + met.count() == len(rows)
    kept = [(r.doc_id, r.text) for r in ngramjoin.stage(spark, docs, None).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[0] not in (300, 5)] + [(5, None)], key=str)


def test_texts_are_hashed_once_for_all_turns_of_postings(spark, monkeypatch):
    """The turns of postings and of meetings are bounded, and texts are read for them once."""
    for name, value in {"POSTED": 100, "COUNTED": 2, "FREQUENT": 3}.items():
        monkeypatch.setattr(ngramjoin, name, value)
    names, turned, keep, by_turns = [], [], ngramjoin.Scratch.keep, ngramjoin._by_turns
    hashed = spark.sparkContext.accumulator(0)
    sets = ngramjoin.Shingler.sets
    monkeypatch.setattr(ngramjoin.Shingler, "sets", lambda self, texts: hashed.add(len(texts)) or sets(self, texts))
    monkeypatch.setattr(ngramjoin.Scratch, "keep", lambda self, df, name: names.append((name, hashed.value)) or keep(self, df, name))
    monkeypatch.setattr(ngramjoin, "_by_turns", lambda turns, work: turned.append(turns) or by_turns(turns, work))
    docs = list(enumerate(made_texts(90, seed=4)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == groups(docs)
    read = dict(reversed([(k, v) for k, v in names]))  # what was hashed before the first table of each name
    assert [k for k, _ in names][:2] == ["shorts", "lists0"] and read["lists0"] == read["lists"] == 2 * len(docs)
    assert max(turned) <= ngramjoin.COUNTING_TURNS
