"""CSV scans and sinks, and listings of folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import null_tokens

# Texts that stand for null. "NA" is none of them: a chain may have that name.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NULL", "NaN", "n/a", "nan", "null"]


def typed_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV table with a header. Without ``schema`` types are inferred, which
    reads the files twice."""
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def text_csv(spark: SparkSession, path: str, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """A CSV table with a header, every column text, ``tokens`` null."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return null_tokens(rows, rows.columns, tokens)


def split_csv(df: DataFrame, split: str, path: str) -> None:
    """CSV files of ``df``, a folder for each value of ``split``; narrow."""
    df.write.partitionBy(split).option("header", True).option("escape", '"').csv(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, size, modified) of all files below ``path`` whose name fits; the
    contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listed_files(spark: SparkSession, list_path: str, root: str, glob: str = "*") -> DataFrame:
    """(file, size, modified) of the files below ``root`` that a text file names,
    a path a line: blank lines and comments after ``#`` do not count, names that
    come twice count once, and absent files are left out. A line fits a file
    whose path ends with it, so paths may be relative to ``root``."""
    names = spark.read.text(list_path).select(F.trim(F.regexp_replace("value", r"(?:^|\s)#.*$", "")).alias("name")).filter("name <> ''")
    home = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("name", r"^file:(//)?", ""), r"^(\./)+", "")
    wanted = names.select(F.when(F.startswith(relative, F.lit("/")), relative).otherwise(F.concat(F.lit(re.sub(r"^file:(//)?", "", home) + "/"), relative)).alias("at")).distinct()
    found = listing(spark, root, glob)
    return found.withColumn("at", F.regexp_replace("file", r"^file:(//)?", "")).join(wanted, "at", "left_semi").drop("at")


def dates_by_id(rows: DataFrame, text: str = "value") -> DataFrame:
    """(id, released) of JSON objects from ids to dates, or to objects with a
    ``release_date``; ids in lower case, what is no date null, the latest of
    several."""
    each = rows.select(F.explode(F.from_json(text, "map<string,string>")).alias("id", "what"))
    date = F.coalesce(F.get_json_object("what", "$.release_date"), F.col("what")).try_cast("date")
    return each.groupBy(F.lower("id").alias("id")).agg(F.max(date).alias("released"))
