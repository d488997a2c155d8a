"""Clean-up of wiki markup and of metadata in front of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillmill.functions.text import filled, left_strip, let, strip

#: What is cut from wiki text, in this order, and what takes its place.
WIKI_STEPS = (
    (r"\{\{[\s\S]*?\}\}", ""),
    (r"\[\[(Şəkil|File|Image):[^\]]+\]\]", ""),
    (r"\[\[Kateqoriya:[^\]]+\]\]", ""),
    (r"\[\[[a-z\-_]+:[^\]]+\]\]", ""),
    (r"<ref[^>]*>[\s\S]*?<\/ref>|<references\/?>", ""),
    (r"(?d)==+.*?==+", ""),
    (r"<\/?poem>", ""),
    (r"<br\s*\/?>", "\n"),
    (r"\[\[(?:[^\|\]]*\|)?([^\]]+)\]\]", "$1"),
)
#: Line ends besides \n, and bounds of what counts as a table of contents.
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TOC_LINES, TOC_SHARE, TOC_HEADING, TOC_WORDS = 5, 0.6, 40, 6


def clean_wikitext(c: Column) -> Column:
    """Text of wiki markup: templates, links, references, headings and tags cut, blank lines dropped, lines trimmed."""
    out = filled(c)
    for pattern, by in WIKI_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.array_join(F.filter(F.transform(F.split(out, "\n", -1), strip), lambda x: x != ""), "\n")


def lines_of(c: Column) -> Column:
    """Lines of a text; one after the last line end is none."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, -1)


def without_template(c: Column) -> Column:
    """struct(text, removed): a leading block of {{, lines with a bar, and }} cut. Unchanged texts stay as they are."""
    def cut(lines: Column) -> Column:
        first = F.when(left_strip(F.get(lines, F.lit(0))).startswith("{{"), 1).otherwise(0)

        def from_first(start: Column) -> Column:
            rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
            bars = F.transform(rest, lambda x: left_strip(x).startswith("|"))
            n = F.array_position(bars, False)

            def found(metadata: Column) -> Column:
                closing = F.coalesce(strip(F.get(rest, metadata)).startswith("}}"), F.lit(False))
                removed = closing & ((metadata > 0) | (start > 0))
                return F.struct(F.when(removed, F.array_join(F.slice(rest, metadata + 2, F.size(rest)), "\n")).otherwise(c).alias("text"), removed.alias("removed"))

            return let(F.when(n > 0, n - 1).otherwise(F.size(rest)).cast("int"), found)

        return let(first, from_first)

    return F.when(c == "", F.struct(c.alias("text"), F.lit(False).alias("removed"))).otherwise(let(lines_of(c), cut))


def without_contents(c: Column) -> Column:
    """struct(text, removed): bullets cut from a text that is mostly bullets, and what short headings then remain."""
    def cut(lines: Column) -> Column:
        full = F.filter(lines, lambda x: strip(x) != "")
        bullets = F.size(F.filter(full, lambda x: left_strip(x).startswith("*")))
        other = F.filter(full, lambda x: ~left_strip(x).startswith("*"))
        is_toc = (F.size(full) >= TOC_LINES) & (bullets >= TOC_LINES) & (bullets / F.greatest(F.size(full), F.lit(1)) >= TOC_SHARE)
        words = F.aggregate(other, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", -1), lambda w: w != "")))
        headings = F.forall(other, lambda x: F.length(strip(x)) <= TOC_HEADING) & (words <= TOC_WORDS)
        rest = F.when(headings, "").otherwise(F.regexp_replace(F.array_join(other, "\n"), r"\A\n+|\n+\z", ""))
        return F.struct(F.when(is_toc, rest).otherwise(c).alias("text"), is_toc.alias("removed"))

    return let(lines_of(c), cut)


def clean_text(c: Column) -> Column:
    """struct(text, template_removed, toc_removed) of a text; null is empty."""
    start = left_strip(F.regexp_replace(filled(c), r"\r\n|\r", "\n"))
    return let(let(start, without_template), lambda a: let(let(F.regexp_replace(a["text"], r"\A\n+", ""), without_contents), lambda b: F.struct(
        b["text"].alias("text"), a["removed"].alias("template_removed"), b["removed"].alias("toc_removed"))))


#: The line ends for whole batches of texts in Python, whose white space is the same class.
_ENDS = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def _lines(text: str) -> list[str]:
    out = _ENDS.split(text)
    return out[:-1] if len(out) > 1 and not out[-1] else out


def cleaned(text: str) -> tuple[str, bool, bool]:
    """clean_text() of one text."""
    now, removed = text.replace("\r\n", "\n").replace("\r", "\n").lstrip(), False
    if now:
        lines = _lines(now)
        first = int(lines[0].lstrip().startswith("{{"))
        rest = lines[first:]
        n = next((i for i, x in enumerate(rest) if not x.lstrip().startswith("|")), len(rest))
        removed = n < len(rest) and rest[n].strip().startswith("}}") and n + first > 0
        if removed:
            now = "\n".join(rest[n + 1 :])
    now = now.lstrip("\n")
    full = [x for x in map(str.strip, _lines(now)) if x]
    bullets = sum(x.startswith("*") for x in full)
    is_toc = len(full) >= TOC_LINES and bullets >= TOC_LINES and bullets / len(full) >= TOC_SHARE
    if is_toc:
        other = [x for x in _lines(now) if (bare := x.strip()) and not bare.startswith("*")]
        headings = all(len(x.strip()) <= TOC_HEADING for x in other) and sum(len(x.split()) for x in other) <= TOC_WORDS
        now = "" if headings else "\n".join(other).strip("\n")
    return now, removed, is_toc


def long_enough(c: Column, least_bytes: int = 300, least_breaks: int = 10) -> Column:
    """Whether a text has enough UTF-8 bytes and line breaks."""
    breaks = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (F.octet_length(c) >= least_bytes) & (breaks >= least_breaks)
