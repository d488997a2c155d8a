"""Edit distances, spelling variants and generated typing errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillmill.functions.text import az_lower, let

#: Letters that are easily mistaken, for variants and for weighted distances; and the alphabet.
VARIANT_FROM, VARIANT_TO = "eəuüoöiısşcçgğ", "əeüuöoıişsçcğg"
SIMILAR = ("aə", "oö", "uü", "iı", "sş", "cç", "gğ")
SIMILAR_COST = 0.5
ALPHABET = "abcçdeəfgğhxıijkqlmnoöprsştuüvwyz"
TYPO_ALPHABET = "abcçdeəfgğhxıijklmnoöpqrsştuüvwyz"
VOWELS = "aeəiıoöuü"
ERROR_TYPES = ("substitution", "insertion", "deletion", "transposition")


def variants(word: Column) -> Column:
    """The word and every form with one letter exchanged for its look-alike."""
    def swap(i: Column) -> Column:
        own = F.substring(word, i, 1)
        return F.concat(F.substring(word, 1, i - 1), F.translate(own, VARIANT_FROM, VARIANT_TO), F.substr(word, i + 1))

    return F.when(word == "", F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), swap))))


def folded(word: Column) -> Column:
    """One letter for each set of similar ones: Levenshtein distances of folded words bound weighted ones from below."""
    return F.translate(word, "".join(p[1] for p in SIMILAR), "".join(p[0] for p in SIMILAR))


def weighted_distance(a: Column, b: Column) -> Column:
    """Edit distance of lower-cased words in which exchanging similar letters costs half: one row of the table at a time."""
    def table(x: Column, y: Column) -> Column:
        start = F.transform(F.sequence(F.lit(0), F.size(y)), lambda j: j.cast("double"))

        def row(above: Column, s: Column) -> Column:
            def cell(done: Column, j: Column) -> Column:
                t = F.get(y, j)
                alike = F.lit(False)
                for pair in SIMILAR:
                    alike = alike | ((s == pair[0]) & (t == pair[1])) | ((s == pair[1]) & (t == pair[0]))
                cost = F.when(s == t, 0.0).when(alike, SIMILAR_COST).otherwise(1.0)
                return F.concat(done, F.array(F.least(F.get(above, j) + cost, F.get(above, j + 1) + 1.0, F.get(done, j) + 1.0)))

            first = F.array(F.get(above, F.lit(0)) + 1.0)
            return F.when(F.size(y) == 0, first).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), first, cell))

        return F.element_at(F.aggregate(x, start, row), -1)

    chars = lambda c: F.filter(F.split(az_lower(c), "", -1), lambda z: z != "")
    return let(F.struct(chars(a).alias("x"), chars(b).alias("y")), lambda p: table(p["x"], p["y"]))


def substitutions(error: Column, correct: Column) -> Column:
    """Array of (error_char, correct_char) where two words differ, place by place up to the shorter one's end."""
    n = F.least(F.length(error), F.length(correct))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(error, i, 1).alias("error_char"), F.substring(correct, i, 1).alias("correct_char")))
    return F.when(n > 0, F.filter(pairs, lambda p: p["error_char"] != p["correct_char"])).otherwise(F.array().cast("array<struct<error_char:string,correct_char:string>>"))


def draw(word: Column, turn: int, seed: int) -> Column:
    """A number from 0 to 2**28 - 1 that follows from the word, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(word, F.lit(f":{turn}:{seed}"))), 1, 7), 16, 10).cast("bigint")


def typo(word: Column, rate: float = 0.3, seed: int = 7) -> Column:
    """struct(error_word, error_type): one generated error, or the word as it is and correct."""
    n, low = F.length(word), az_lower(word)
    kind, letter = draw(word, 1, seed) % 4, F.substring(F.lit(TYPO_ALPHABET), (draw(word, 3, seed) % len(TYPO_ALPHABET) + 1).cast("int"), 1)
    at = lambda places: (draw(word, 2, seed) % places).cast("int")
    def changed(p: Column, drop: int, put: Column) -> Column:
        return F.concat(F.substring(low, 1, p), put, F.substr(low, p + 1 + drop))

    swapped = let(at(n - 1), lambda p: changed(p, 2, F.concat(F.substring(low, p + 2, 1), F.substring(low, p + 1, 1))))
    out = F.when(kind == 0, changed(at(n), 0 + 1, letter)).when(kind == 1, changed(at(n + 1), 0, letter)).when(kind == 2, changed(at(n), 1, F.lit(""))).otherwise(swapped)
    kinds = F.element_at(F.array(*map(F.lit, ERROR_TYPES)), (kind + 1).cast("int"))
    made = (n >= 2) & (draw(word, 0, seed) % 1000 < round(1000 * rate))
    return F.struct(F.when(made, out).otherwise(word).alias("error_word"), F.when(made, kinds).otherwise("correct").alias("error_type"))
