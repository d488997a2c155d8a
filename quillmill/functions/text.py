"""Tokens, casing and word normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space and word characters, as they stand within a character class.
WS_CHARS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHARS = r"\p{L}\p{N}_"
WS = f"[{WS_CHARS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, within lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(c: Column | str) -> Column:
    """c, or the empty string for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def left_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+", "")


def tokenize(c: Column | str) -> Column:
    """Tokens between white space, case and punctuation kept."""
    return F.filter(F.split(filled(c), f"{WS}+", -1), lambda x: x != "")


def az_lower(c: Column | str) -> Column:
    """Lower case with dotless and dotted i told apart."""
    return F.lower(F.translate(filled(c), "Iİ", "ıi"))


def normalised_tokens(c: Column | str, keep_hyphen: bool = True) -> Column:
    """Lower-cased tokens without punctuation; a hyphen stays or joins its halves. Digits stay."""
    other = f"[^{WORD_CHARS}{WS_CHARS}{'-' if keep_hyphen else ''}]"
    return tokenize(F.regexp_replace(az_lower(c), other, ""))


def preserve_case(corrected: Column, original: Column) -> Column:
    """corrected, with a capital first letter if the original has one and it has not."""
    first = F.substring(corrected, 1, 1)
    capital = F.when(first == "ı", "I").when(first == "i", "İ").otherwise(F.upper(first))
    raised = original.rlike(r"^\p{Lu}") & corrected.rlike(r"^\p{Ll}")
    return F.when(raised, F.concat(capital, F.substr(corrected, F.lit(2)))).otherwise(corrected)


def url_query(c: Column) -> Column:
    """Form encoding: a space becomes a plus sign."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_path(c: Column) -> Column:
    """Encoding of one path segment: a space becomes %20, and marks that a path may hold stay."""
    out = F.replace(url_query(c), F.lit("+"), F.lit("%20"))
    for mark, code in (("$", "%24"), ("&", "%26"), ("+", "%2B"), ("=", "%3D"), (":", "%3A"), ("@", "%40")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def setting(line: Column) -> Column:
    """Of a line key=value: struct(key, value) without quotes; null for blanks, comments and lines without =."""
    bare = strip(line)
    at = F.instr(bare, "=")
    key, value = strip(F.substring(bare, 1, at - 1)), strip(F.substr(bare, at + 1))
    unquoted = F.regexp_replace(F.regexp_replace(value, r"\A[\"']+|[\"']+\z", ""), r"\A$", "")
    return F.when((bare != "") & ~bare.startswith("#") & (at > 0), F.struct(key.alias("key"), unquoted.alias("value")))


def prompt(template: str, text: Column) -> Column:
    """The template with {text} filled in."""
    before, _, after = template.partition("{text}")
    return F.concat(F.lit(before), filled(text), F.lit(after))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("->", a, b)


def unpaired(key: Column) -> Column:
    """Of a pair key: struct(actual, predicted), cut at its first arrow; null without one."""
    at = F.instr(key, "->")
    return F.when(at > 0, F.struct(F.substring(key, F.lit(1), at - 1).alias("actual"), F.substr(key, at + 2).alias("predicted")))


def titled(c: Column) -> Column:
    """For display: underscores to spaces, words capitalised."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
