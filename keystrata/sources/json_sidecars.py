"""The JSON forms of an index ({key: [row, col]}) and of access metadata ([{input, access}], newest first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.text import blank_to_null


def index_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """(input, row, col) from texts of JSON objects."""
    entries = texts.select(F.explode(F.from_json(column, "map<string,array<int>>")).alias("input", "at"))
    return entries.select("input", F.get("at", F.lit(0)).alias("row"), F.get("at", F.lit(1)).alias("col"))


def index_json(input: Column, row: Column, col: Column) -> Column:
    """One key's entry as a JSON object; an index in this form is one object per line, so it is written and read in parallel."""
    return F.to_json(F.create_map(input, F.array(row, col)))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return index_rows(spark.read.text(path))


def write_index(index: DataFrame, path: str) -> None:
    index.select(index_json(F.col("input"), F.col("row"), F.col("col")).alias("value")).write.mode("overwrite").text(path)


def read_access(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(input, access, seq): `seq` falls from the newest entry on, as the file lists it first. With `lines` each line is an entry, and a file is read by several tasks."""
    rows = spark.read.schema("input string, access string").json(path, multiLine=not lines)
    return rows.select(blank_to_null(F.col("input")).alias("input"), "access", (-F.monotonically_increasing_id()).alias("seq"))
