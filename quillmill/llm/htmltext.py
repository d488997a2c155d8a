"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut to flat blocks at block-level tags. Blocks in containers that are named or tagged as menus, adverts and the
like go first. The others are described by their words, their share of words in links, the same of both neighbours, and
whether they stand in a part that is marked as the main one, if the page has any. A decision tree, grown here from a
small labelled table, says which of them are main text; these are joined in page order. On pages without marks the tree
has nothing but words, links and neighbours to go by.
"""

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.common import bound_batches

#: Tags by what they mean for blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
UNWANTED_TAGS = frozenset("aside dialog fieldset footer form header menu nav".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their content is no text of the page.
SILENT_TAGS = frozenset("audio button canvas datalist head select svg template video".split())
#: A class or id is unwanted if one of its tokens is such a name, alone or joined by hyphens only to other such names, furniture and numbers.
UNWANTED_NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side|"
    r"menus?|nav|nav(?:bar|box|menu|igation)|breadcrumbs?|header|masthead|topbar|footer|foot|comments?|commentlist|disqus|repl(?:y|ies)|respond|related|share|sharing|social|"
    r"widgets?|toolbar|copyright|login|search|search(?:bar|box|form)|paginat\w*|pager|skip|tags|form", re.I)  # fmt: skip
FURNITURE_NAMES = re.compile(
    r"[a-z]?\d+(?:x\d+)?|site|page|blog|article|post|entry|main|global|primary|secondary|top|bottom|left|right|upper|lower|bar|box|block|list|items?|links?|icons?|buttons?|btns?|"
    r"area|slot|unit|section|posts|articles|stories|news|thread|user|reader|us|to|here", re.I)  # fmt: skip
#: Unwanted containers in which articles are asides, teasers or readers' comments; in all others an article is wanted.
FIRM_TAGS = frozenset("aside dialog footer menu nav".split())
FIRM_NAMES = re.compile(r"comments?|commentlist|disqus|repl(?:y|ies)|respond|related", re.I)
FIRM_ROLES = frozenset("navigation contentinfo complementary dialog menu".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body)(?:$|[\s_-])", re.I)
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp|noframes)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=<))", re.S | re.I)  # fmt: skip
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden)(?=[\s=/]|\Z)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

FEATURES = ("words", "link_density", "prev_words", "prev_links", "next_words", "next_links", "in_main")
#: The labelled table, a page a line, its blocks in order. A block is its words, /its words in links if any, and + for
#: main text or - for other; * is before blocks in a part that is marked as the main one. What describes a block's neighbours follows.
LABELLED = """
1/1- 1/1- 1/1- 1/1- 7- 11+ 64+ 2+ 38+ 90+ 1+ 9-
1/1- 2/2- 1/1- 9+ 71+ 40+ 3+ 2+ 55+ 8-
2/2- 1/1- 1/1- 3/3- 12- 6+ 30+ 25/2+ 110+ 4+ 13-
4- 1/1- 1/1- 8+ 45+ 1+ 1+ 2+ 60/3+ 22+ 6/4-
1/1- 1/1- 5- 10+ 2+ 3+ 80+ 1+ 10-
1/1- 1/1- 12+ 140+ 150/6+ 35+ 7/7- 6/6- 9/9- 4/2-
3/3- 5+ 28+ 33/1+ 18+ 41+ 3/3- 2/2- 3/3- 11-
1/1- 1/1- 9- 9+ 16+ 5+ 7+ 1+ 2+ 12-
2/2- 6- 7+ 88+ 4/1+ 51+ 17+ 8-
12/12- 10+ 66+ 75+ 70+ 20/18- 14/14- 3-
1/1- 1/1- 10- 1+ 19+ 12+ 3+ 7-
1/1- 1/1- 8- 12+ 130+ 9-
1/1- 1/1- 1/1- 4+ 200+ 5-
1/1- 6- 10+ 14+ 9+ 11+ 2+ 8-
1/1- 1/1- 11- 3+ 3+ 6+ 50+ 42+ 10-
45+ 60+ 38+
30+ 1+ 44+
7+ 52+ 2+ 61+ 3/3-
1/1- 1/1- 2/2- 1/1- 1/1- 3-
2/2- 3/2- 4/3- 5- 2/2- 1/1-
6/5- 4/4- 24/22- 35/25- 12/8- 3-
3- 2/2- 1/1- 6- 2/2-
1/1- 1/1- 7- *10+ *60+ *1+ *40+ 9-
1/1- 8- *12+ *2/2+ *1/1+ *30/12+ *5/3+ *300+ 60- 20- 2/2- 1/1-
*4+ *1+ *2+ *1/1+ *1/1+
*1+ 2/2- 45- 9-
70- 30/3- *90+ *17/10+ *3/3+ 200- 15- 34/10-
1/1- *55+ *8+ *25/25+ 28- 120- 6-
*1/1+ 50- *2+ 4- *6+ *18+ 33-
*3+
1/1- *9+ *2+
*40+ *2/2+ *1+
2/2- 12- *11+ *70+ *5+
*22+ *7/7+
1/1- 30- *1+ *6+
*15+ *14+ *13+ *12+ 80-
1/1- 1/1- *33/30+ *2+ *1+ 44- 90-
*8/8+ *8/8+ *8/8+
60- 20- *4+ *3+ 100/2- 7/7-
"""


def _rows(table: str) -> tuple[list[tuple], list[int]]:
    """FEATURES and label of each block of a labelled table."""
    rows, labels = [], []
    for page in filter(None, table.strip().split("\n")):
        cut = [re.fullmatch(r"(\*?)(\d+)(?:/(\d+))?([+-])", x).groups() for x in page.split()]
        rows += features_of([("", int(n), int(k or 0), bool(main), False) for main, n, k, _ in cut])
        labels += [int(y == "+") for *_, y in cut]
    return rows, labels


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1):
    """A decision tree by Gini impurity: (feature, threshold, below, above) or a label. Ties go to the first feature and the lowest threshold."""
    if depth == 0 or labels.min() == labels.max() or len(labels) < 2 * least:
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < t
            parts = [labels[low], labels[~low]]
            if min(map(len, parts)) >= least:
                gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in parts)
                if best is None or gini < best[0] - 1e-12:
                    best = gini, f, float(t), low
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, t, low = best
    return f, t, fit_tree(rows[low], labels[low], depth - 1, least), fit_tree(rows[~low], labels[~low], depth - 1, least)


def default_tree():
    rows, labels = _rows(LABELLED)
    return fit_tree(np.array(rows, float), np.array(labels))


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, t, below, above = tree
        tree = below if row[f] < t else above
    return tree


def _unwanted_name(value: str) -> tuple[bool, bool]:
    """Whether a class or an id names an unwanted container, and a firm one: with-sidebar, side-effects and related-work do not."""
    found = []
    for token in value.split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        names = [x for x in parts if UNWANTED_NAMES.fullmatch(x)]
        if names and all(x in names or FURNITURE_NAMES.fullmatch(x) for x in parts):
            found += names
    return bool(found), any(map(FIRM_NAMES.fullmatch, found))


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether a container is (unwanted, firmly so, main)."""
    unwanted, firm, main = tag in UNWANTED_TAGS, tag in FIRM_TAGS, tag in MAIN_TAGS
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "role":
            unwanted, firm, main = unwanted or value.lower() in UNWANTED_ROLES, firm or value.lower() in FIRM_ROLES, main or value.lower() == "main"
        elif name == "hidden":
            unwanted = True
        elif tag not in MAIN_TAGS:
            u, f = _unwanted_name(value)
            unwanted, firm, main = unwanted or u, firm or f, main or bool(MAIN_NAMES.search(value))
    return unwanted, firm, main and not unwanted


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, in a main part, in an unwanted container) of each block that has text.

    Inline tags leave no trace, a single line break is white space, two of them end a block. Tags may be left open:
    a closing tag ends the containers that were opened within its own, and one that was never opened is ignored.
    A main element is not unwanted for what it stands in, an article only for what is firmly so, unless that is within another of them.
    Headlines in the header of either are part of it, the rest of that header is not.
    """
    out, text, links = [], [], []
    stack: list[tuple[str, int, int, int, int, int]] = []  # with main, unwanted, firm, within and own_header as they were outside
    in_link, silent, breaks, at = False, "", 0, 0
    main = unwanted = firm = within = 0
    own_header, heading = 0, False

    def flush() -> None:
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), len(words), min(len(words), len("".join(links).split())), main > 0, unwanted - own_header * heading > 0))
        text.clear()
        links.clear()

    def add(plain: str) -> None:
        text.append(plain)
        if in_link:
            links.append(plain)

    for m in TOKEN.finditer(page):
        if m.start() > at and not silent:
            raw = page[at : m.start()]
            breaks = breaks if raw.isspace() else 0
            add(html_entities.unescape(raw) if "&" in raw else raw)
        at = m.end()
        tag, closing = (m["tag"] or "").lower(), bool(m["close"])
        if m["cdata"] and not silent:
            add(m["cdata"])
        if not tag:
            continue
        if silent:
            if tag == silent and closing or silent == "head" and tag == "body":
                silent = ""
        elif tag in SILENT_TAGS:
            silent = "" if closing or m["attrs"].endswith("/") else tag
        elif tag == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
        elif tag == "a":
            in_link = not closing
            links.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            breaks, heading = 0, tag in HEADINGS and not closing
            if tag in CONTAINERS and not closing:
                u, f, k = _marks(tag, m["attrs"])
                stack.append((tag, main, unwanted, firm, within, own_header))
                own_header += bool(tag == "header" and within and u)
                if tag in MAIN_TAGS:
                    own_header = 0
                    if not within:
                        firm = firm if tag == "article" else 0
                        unwanted = firm
                    within += 1
                unwanted, firm, main = unwanted + u, firm + f, main + k
            elif tag in CONTAINERS and any(x[0] == tag for x in stack):
                in_link, x = False, ""
                while x != tag:
                    x, main, unwanted, firm, within, own_header = stack.pop()
    if not silent:
        add(html_entities.unescape(page[at:]))
    flush()
    return out


def features_of(blocks) -> list[tuple]:
    """FEATURES of each block: in_main is 1 in a main part, -1 beside one, 0 on pages without."""
    some = any(b[3] for b in blocks)
    own = [(0, 0.0), *((b[1], b[2] / b[1]) for b in blocks), (0, 0.0)]
    return [(*own[i + 1], *own[i], *own[i + 2], (1 if b[3] else -1) if some else 0) for i, b in enumerate(blocks)]


def main_text(page: str | None, tree=None, marks: bool = True) -> str:
    """The main text of one page, its blocks joined by line feeds; empty for null, empty and textless pages.

    Without marks neither tags nor names of containers count: the tree sees words and links of blocks only.
    """
    tree = default_tree() if tree is None else tree
    blocks = blocks_of(page or "")
    if not marks:
        blocks = [(*b[:3], False, False) for b in blocks]
    return "\n".join(b[0] for b, f in zip(blocks, features_of(blocks), strict=True) if not b[4] and classify(tree, f))


def extract_text(pages: DataFrame, html: str = "html", tree=None) -> DataFrame:
    """pages with text and n_chars, the code points of text, in place of columns of those names.

    Null and empty pages, and pages without main text, have the empty text. Pages of any length are read whole, row by
    row, so repeated rows give equal rows. Other columns pass through, empty tables stay empty.
    """
    tree = default_tree() if tree is None else tree
    bound_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, tree) for x in pages], dtype=object)

    return pages.withColumn("text", text_of(F.col(html))).withColumn("n_chars", F.length("text").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
