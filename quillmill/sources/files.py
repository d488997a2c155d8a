"""Tables, reports and logs in files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.base import PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.functions.text import setting

#: Schemas of the tables.
TEXTS = "author string, title string, url string, text string"
SPELLING_TESTS = "input string, expected string, type string"
GROWTH_POINTS = "tokens bigint, types bigint, log_tokens double, log_types double"
#: What is added to the name of a table that is being replaced, and of one that cannot be read.
ASIDE, BACKUP = ".aside", ".bak"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema, an empty one if there is none at path."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if schema and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_or_set_aside(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; an empty one if there is none, or if it cannot be read: then what is at path moves to path + BACKUP, in place of an earlier one."""
    try:
        spark.read.parquet(path).limit(1).collect()  # a footer and a row
        return read_table(spark, path, schema)
    except (AnalysisException, Py4JJavaError, SparkException) as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            where = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
            fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(where(path + BACKUP), True)
            fs.rename(where(path), where(path + BACKUP))
        return spark.createDataFrame([], schema)


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of columns that df lacks, in their order; names count as Spark's do, whatever their case."""
    known = {c.lower() for c in df.columns}
    return [c for c in columns if c.lower() not in known]


def require_columns(df: DataFrame, columns: list[str], what: str = "the table") -> DataFrame:
    """df, if it has all of columns; else a ValueError that names what is missing."""
    if missing := missing_columns(df, columns):
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents that may span lines: an object, or an array of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """Spelling tests; a missing type is unknown."""
    return read_json(spark, path, SPELLING_TESTS).withColumn("type", F.coalesce("type", F.lit("unknown")))


def read_settings(spark: SparkSession, path: str, given: dict[str, str] | None = None) -> dict[str, str]:
    """key=value lines of a small settings file; what is given wins."""
    rows = spark.read.text(path).select(setting(F.col("value")).alias("s")).where("s IS NOT NULL").select("s.*").collect()  # a settings file
    return {r.key: r.value for r in rows} | (given or {})


def write_table(df: DataFrame, path: str) -> None:
    """Overwrites a Parquet table. Not the one that df reads: write beside it and use swap()."""
    df.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> bool:
    """Puts back the table that a swap() had set aside when it was cut short; whether there was one to put back."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ASIDE)
    fs = here.getFileSystem(conf)
    return bool(fs.exists(aside) and not fs.exists(here) and fs.rename(aside, here))


def swap(spark: SparkSession, fresh: str, path: str, backup: str | None = None) -> None:
    """Puts the table at fresh in the place of path, which moves to backup or goes.

    The old table is renamed, never deleted, before the new one has its place: whenever this is cut short, restore() or
    the next swap() finds one of the two whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(conf)
    if not fs.exists(at(fresh)):
        raise OSError(f"cannot move {fresh} to {path}: it is not there")
    restore(spark, path)
    aside = backup or path + ASIDE
    if fs.exists(at(path)):
        if fs.exists(at(aside)):
            fs.delete(at(aside), True)
        if not fs.rename(at(path), at(aside)):
            raise OSError(f"cannot move {path} to {aside}")
    if not fs.rename(at(fresh), at(path)):
        if fs.exists(at(aside)):
            fs.rename(at(aside), at(path))
        raise OSError(f"cannot move {fresh} to {path}")
    if not backup:
        fs.delete(at(aside), True)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object: df has one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, *order) -> None:
    """CSV with a header, in one sorted file: for reports, not for tables that grow."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_lines(df: DataFrame, path: str, order: str = "line") -> None:
    """The column value as lines of one file."""
    df.orderBy(order).coalesce(1).select("value").write.mode("overwrite").text(path)


def append_errors(df: DataFrame, path: str) -> None:
    """Rows that have an error, appended as JSON lines."""
    df.where("error IS NOT NULL").write.mode("append").json(path)


def report_line(df: DataFrame, template: str, *columns: str, keep: list[str] | None = None) -> DataFrame:
    """A line of text for each row, value: a printf template over columns; beside it the columns to keep."""
    return df.select(*(keep or []), F.format_string(template, *columns).alias("value"))
