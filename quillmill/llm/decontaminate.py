"""Benchmark decontamination by spaced seeds.

Texts are lower-cased to words. A mask lays a pattern over consecutive words and ignores some of them, so a hash of the
others still matches where an ignored word was replaced. Hashes of benchmark items and of documents are joined; around
each hit the item is laid on the document and the best stretch of equal words, single substitutions allowed, is counted.
Of hits that follow each other on one diagonal only the first is looked at, and long items are laid on in pieces, so
that work and broadcasts grow with the words of an item and not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.llm.common import lower_ascii

#: Fixed masks: 1 compares the word, 0 ignores it.
MASKS = ("111111", "11011011", "10111101", "110110011")
#: Shorter items are no evidence.
LEAST_WORDS = 8
#: Equal words that make a leak: so many, or this share of a shorter item.
ENOUGH_WORDS, ENOUGH_SHARE = 13, 0.7
#: What a replaced word costs against an equal one when the best stretch is sought.
PENALTY = 2
#: Longer items are laid on in pieces of so many words, each with so many of its neighbours' on either side.
PIECE, MARGIN = 256, 64
#: Seeds of benchmark items that are broadcast at once, some 50 bytes each with the pieces; a larger benchmark goes in blocks of pieces.
BLOCK_SEEDS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(h: str, at: str) -> Column:
    """Array of the seeds, one for each mask, of the words from a place on; null where the mask reaches too far."""
    def one(k: int, mask: str) -> Column:
        picked = [F.get(h, F.col(at) + o) for o, bit in enumerate(mask) if bit == "1"]
        return F.when(F.col(at) + len(mask) <= F.size(h), F.xxhash64(F.lit(k), *picked))

    return F.array(*(one(k, m) for k, m in enumerate(MASKS)))


def _placed(df: DataFrame, h: str, at: str) -> DataFrame:
    least = min(map(len, MASKS))
    places = F.when(F.size(h) >= least, F.sequence(F.lit(0), F.size(h) - least))
    return df.withColumn(at, F.explode_outer(places))  # an inner one would bring a filter that splits the texts once more


def _pieces(items: DataFrame) -> DataFrame:
    """(piece, item_id, n_item, base, own, words): the words of each piece and its margins; base is the place of the first, own that from which the piece is asked for."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("item_h") - 1), F.lit(PIECE)))
    cut = items.distinct().withColumn("own", starts).withColumn("base", F.greatest(F.lit(0), F.col("own") - MARGIN))
    words = F.slice("item_h", F.col("base") + 1, F.col("own") - F.col("base") + PIECE + MARGIN)
    return cut.select(F.xxhash64("item_id", "item_h", "own").alias("piece"), "item_id", F.size("item_h").alias("n_item"), "base", "own", words.alias("words"))


def _best(equal: Column) -> Column:
    """Of an array of booleans: (from, till, equal) of the stretch with the largest sum, equal +1, else -PENALTY."""
    zero = [F.lit(0).alias(x) for x in ("i", "sum", "from", "same", "most", "b_from", "b_till", "b_same")]

    def step(a: Column, e: Column) -> Column:
        fresh = a["sum"] <= 0
        total = F.when(fresh, 0).otherwise(a["sum"]) + F.when(e, 1).otherwise(-PENALTY)
        start = F.when(fresh, a["i"]).otherwise(a["from"])
        same = F.when(fresh, 0).otherwise(a["same"]) + e.cast("int")
        better = total > a["most"]
        return F.struct((a["i"] + 1).alias("i"), total.alias("sum"), start.alias("from"), same.alias("same"), F.greatest(total, a["most"]).alias("most"), F.when(better, start).otherwise(a["b_from"]).alias("b_from"), F.when(better, a["i"] + 1).otherwise(a["b_till"]).alias("b_till"), F.when(better, same).otherwise(a["b_same"]).alias("b_same"))

    return F.aggregate(equal, F.struct(*zero), step)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """doc_id, item_id, first_word (in the document), n_aligned, n_match, n_item (long): the best overlap of each leaking pair.

    The words of the items are counted first: seeds and pieces are broadcast if there are up to block_seeds seeds; more go
    in blocks of pieces, each broadcast in its turn against all documents. Overlaps are those within a piece and its
    margins: of an item of over PIECE words n_aligned may thus be less than what a whole copy shares, a leak all the same.
    Null and empty texts, and items under LEAST_WORDS words, have no overlaps. Rows that repeat an id give one row for each
    pair of ids; null ids are ids like any other. Ties between overlaps go to the first in the document. Long texts and
    items are searched whole; other columns, whatever their names, are not read; empty tables give no rows.
    """
    mine = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("item_h")).where(F.size("item_h") >= LEAST_WORDS)
    n = mine.agg(F.sum(F.size("item_h") * len(MASKS))).first()[0] or 0
    blocks = -(-n // block_seeds) or 1
    words = docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("h"))
    pieces, out = _pieces(mine), None
    for b in range(blocks):
        found = _against(words, pieces.where(F.pmod(F.xxhash64("piece"), F.lit(blocks)) == b) if blocks > 1 else pieces)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("first_word", "n_aligned", "n_match", "n_item"), F.struct("n_match", -F.col("first_word"), "n_item", -F.col("n_aligned")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _follows() -> Column:
    """Whether the place before a hit is surely a hit of the same mask and piece: what a mask laid one word earlier would compare beyond the hit's own words is equal."""
    bits = [{o for o, bit in enumerate(m) if bit == "1"} for m in MASKS]
    same = (F.col("at") > 0) & (F.col("base") + F.col("item_at") > F.col("own"))
    for o in sorted(set().union(*({x - 1 for x in b} - b for b in bits))):
        same = same & F.coalesce(F.get("h", F.col("at") + o) == F.get("words", F.col("item_at") + o), F.lit(False))
    return same


def _against(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """Overlaps of enough equal words. Up to the hits everything stays in one generated stage, where h is a pointer: only hits are copied."""
    at = F.col("base") + F.col("item_at")
    asked = _placed(pieces.select("piece", "base", "own", "words"), "words", "item_at").where((at >= F.col("own")) & (at < F.col("own") + PIECE))
    seeds = asked.select("piece", "item_at", F.explode(_seeds("words", "item_at")).alias("seed")).where("seed IS NOT NULL")
    sought = _placed(words, "h", "at").withColumn("seed", F.explode(_seeds("h", "at"))).where("seed IS NOT NULL")
    hits = sought.join(F.broadcast(seeds), "seed").join(F.broadcast(pieces), "piece").where(~_follows())
    shift = F.col("at") - F.col("item_at")
    start, skipped = F.greatest(F.lit(0), shift), F.greatest(F.lit(0), -shift)
    hits = hits.select("doc_id", "item_id", "n_item", start.alias("start"), F.slice("h", start + 1, F.size("words") - skipped).alias("mine"), F.slice("words", skipped + 1, F.size("words")).alias("theirs"))
    equal = F.zip_with("mine", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False)))
    found = hits.withColumn("b", F.explode(F.array(_best(equal))))  # else the filter moves into the join, which then runs without generated code
    enough = F.least(F.lit(ENOUGH_WORDS), F.ceil(F.col("n_item") * ENOUGH_SHARE))
    return found.where(F.col("b.b_same") >= enough).select(
        "doc_id", "item_id", (F.col("start") + F.col("b.b_from")).cast("bigint").alias("first_word"), (F.col("b.b_till") - F.col("b.b_from")).cast("bigint").alias("n_aligned"),
        F.col("b.b_same").cast("bigint").alias("n_match"), F.col("n_item").cast("bigint").alias("n_item"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go, as find_leaks() tells; all others stay as they are, with all their columns.

    Null and empty texts leak nothing and stay; rows that repeat an id go or stay together, null ids among them; an empty
    table gives an empty one, an empty benchmark takes nothing away.
    """
    from quillmill.llm.common import read, settle, split_by_ids

    leaks = settle(find_leaks(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__leak")).distinct())
    rest, met = split_by_ids(docs, leaks, F.col("doc_id"))  # else the join moves all texts
    return rest.unionByName(met.join(leaks, F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
