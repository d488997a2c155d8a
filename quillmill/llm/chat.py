"""Conversations logged as growing snapshots: keep the maximal ones and render them.

A logged conversation that is a proper prefix of a longer one says nothing new. Each turn gets a rolling hash of all
turns up to it; a conversation whose last hash is an inner hash of another goes, by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rolling_hashes(turns: Column) -> Column:
    """For turns, an array of structs with role and text: after each turn, the hash of all turns so far. Lengths are part of it."""
    part = lambda c: F.concat(F.when(c.isNull(), "-").otherwise(F.octet_length(c).cast("string")), F.lit(":"), F.coalesce(c, F.lit("")))
    step = lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.element_at(acc, -1), F.lit("")), part(t["role"]), part(t["text"])), 256)))
    return F.when(F.size(turns) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(turns, F.array().cast("array<string>"), lambda a, t: F.when(F.size(a) == 0, F.array(F.sha2(F.concat(part(t["role"]), part(t["text"])), 256))).otherwise(step(a, t))))


def assemble(df: DataFrame) -> DataFrame:
    """One row per conv_id: turns in order of turn; ties of turn by role and text; repeated rows once."""
    rows = df.select("conv_id", "turn", "role", "text")
    turns = F.array_sort(F.collect_set(F.struct("turn", F.struct(F.col("role").isNotNull().alias("r"), F.col("text").isNotNull().alias("t")).alias("given"), "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def maximal(convs: DataFrame) -> DataFrame:
    """The conversations that are no proper prefix of another, and of equal ones that of the smallest conv_id."""
    hashed = convs.withColumn("hashes", rolling_hashes(F.col("turns"))).withColumn("whole", F.element_at("hashes", -1))
    inner = hashed.select(F.explode(F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0)))).alias("whole")).distinct()
    first = hashed.groupBy("whole").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_copies"))
    kept = first.join(inner, "whole", "left_anti")
    return hashed.alias("h").join(kept.alias("k"), (F.col("h.whole") == F.col("k.whole")) & F.col("h.conv_id").eqNullSafe(F.col("k.first"))).select("h.*", "k.n_copies").drop("whole")


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE), F.lit("\n"))
    return F.array_join(F.transform(turns, one), "")


def collapse_snapshots(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations with just these turns) and the rendered text of each maximal conversation.

    Needs conv_id, turn, role, text; other columns are left out. A null conv_id is an id like any other. A null role is
    written as unknown, a null text as nothing, and either differs from an empty string in comparisons. Null turns come
    first. Rows repeated within a conversation count once. Of equal conversations the smallest conv_id stays. Empty tables give none.
    """
    kept = maximal(assemble(df))
    return kept.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "n_copies", render(F.col("turns")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    return collapse_snapshots(read(spark, sf_dir, "conversations"))


ORACLE = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
hashed AS (
  SELECT conv_id, turn, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER w AS upto
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
whole AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, upto AS text FROM hashed WHERE k = n GROUP BY n, upto)
SELECT conv_id, n_turns, n_copies, text FROM whole
WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.k < h.n AND h.upto = whole.text)
"""
