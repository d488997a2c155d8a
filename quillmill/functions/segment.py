"""Sentence segments of prose and verse, and what describes them."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillmill.functions.text import WS, filled, let, strip

#: Ends of sentences and of clauses, and the length beyond which a segment is cut at clauses.
SENTENCE_END, CLAUSE_END, LONG = r"[.!?؟۔]", "[;،]", 200
METHODS = ("basic", "poetry_aware", "advanced")


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def basic(c: Column) -> Column:
    """Parts between sentence ends that white space or the end of the text follows."""
    return _trimmed(F.split(strip(filled(c)), rf"{SENTENCE_END}(?:{WS}+|\z)", -1))


def poetry_aware(c: Column) -> Column:
    """The same within each stanza; the lines of a stanza that has no sentence."""
    def of_stanza(s: Column) -> Column:
        return let(basic(s), lambda found: F.when(F.size(found) > 0, found).otherwise(_trimmed(F.split(s, "\n", -1))))

    return F.flatten(F.transform(F.split(strip(filled(c)), rf"\n{WS}*\n", -1), of_stanza))


def advanced(c: Column) -> Column:
    """The same, with long segments cut at clauses."""
    return F.flatten(F.transform(poetry_aware(c), lambda s: F.when(F.length(s) > LONG, let(F.split(s, f"{CLAUSE_END}{WS}+", -1), lambda p: F.when(F.size(p) > 1, _trimmed(p)).otherwise(F.array(s)))).otherwise(F.array(s))))


SEGMENTERS = dict(zip(METHODS, (basic, poetry_aware, advanced), strict=True))


def metrics(segments: Column) -> Column:
    """num_segments, avg_length, median_length, std_length (of all), min_length, max_length, empty_segments, total_chars of an array."""
    def of(sizes: Column) -> Column:
        n = F.size(sizes)
        total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
        mean = total / n
        middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
        spread = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean), lambda a: F.sqrt(a / n))
        some = lambda v, zero: F.when(n > 0, v).otherwise(F.lit(zero))
        return F.struct(
            F.size(segments).alias("num_segments"), some(mean, 0.0).alias("avg_length"), some(middle, 0.0).alias("median_length"), F.when(n > 1, spread).otherwise(F.lit(0.0)).alias("std_length"),
            some(F.get(sizes, F.lit(0)), 0).alias("min_length"), some(F.get(sizes, n - 1), 0).alias("max_length"), (F.size(segments) - n).alias("empty_segments"), total.alias("total_chars"))

    return let(F.array_sort(F.transform(F.filter(segments, lambda x: strip(x) != ""), lambda x: F.length(x))), of)


#: The same patterns for whole batches of texts in Python, whose white space is the same class.
_SENTENCE, _STANZA, _CLAUSE = re.compile(rf"{SENTENCE_END}(?:\s+|\Z)"), re.compile(r"\n\s*\n"), re.compile(rf"{CLAUSE_END}\s+")


def _trimmed_parts(parts: list[str]) -> list[str]:
    return [x for x in map(str.strip, parts) if x]


def basic_parts(text: str) -> list[str]:
    """basic() of one text."""
    return _trimmed_parts(_SENTENCE.split(text.strip()))


def poetry_parts(text: str) -> list[str]:
    """poetry_aware() of one text."""
    return [x for stanza in _STANZA.split(text.strip()) for x in basic_parts(stanza) or _trimmed_parts(stanza.split("\n"))]


def advanced_parts(text: str) -> list[str]:
    """advanced() of one text."""
    out = []
    for s in poetry_parts(text):
        parts = _CLAUSE.split(s) if len(s) > LONG else [s]
        out += _trimmed_parts(parts) if len(parts) > 1 else [s]
    return out


CUTTERS = dict(zip(METHODS, (basic_parts, poetry_parts, advanced_parts), strict=True))
MEASURES = "num_segments int, avg_length double, median_length double, std_length double, min_length int, max_length int, empty_segments int, total_chars int"


def measures(segments: list[str]) -> tuple:
    """metrics() of one list."""
    sizes = sorted(len(x) for x in segments if x.strip())
    n, total = len(sizes), sum(sizes)
    if not n:
        return len(segments), 0.0, 0.0, 0.0, 0, 0, len(segments), 0
    mean, spread = total / n, 0.0
    for x in sizes:
        spread += (x - mean) * (x - mean)
    return len(segments), mean, (sizes[(n - 1) // 2] + sizes[n // 2]) / 2, (spread / n) ** 0.5 if n > 1 else 0.0, sizes[0], sizes[-1], len(segments) - n, total
