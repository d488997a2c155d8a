"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The white-space class and the token list of a text, for SQL.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters beyond ASCII that texts have, for engines whose edit distance counts bytes: each becomes an unused ASCII one.
ACCENTED, PLAIN = "ßàáâäæçèéêëíîïñóôöúûüāəğışœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{WS}+'), lambda x: x <> '')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def lower_sql(text: str) -> str:
    return f"lower(translate(coalesce({text}, ''), 'Iİ', 'ıi'))"


def normal_sql(text: str, hyphen: str = "-") -> str:
    return tokens_sql(f"regexp_replace({lower_sql(text)}, '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}{hyphen}]', '', 'g')")


def ascii_sql(word: str) -> str:
    return f"translate({word}, '{ACCENTED}', '{PLAIN}')"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer splits than there are: a small file of one row group would keep one core busy. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df.select(*columns)) if columns else df


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], *columns: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(columns)}))"
