"""CSV files of results and of wanted keys, read as their writers meant them.

SMILES hold backslashes, so the quote is the only escape; every value stays a string, an empty
cell an empty string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.sources.layout import Files

OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "inferSchema": False, "encoding": "UTF-8"}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; empty cells as empty strings."""
    df = spark.read.csv(path, **OPTIONS)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_wanted(spark: SparkSession, path: str) -> DataFrame:
    """(ord, and the columns): rows numbered in file order, which one file read as one partition keeps."""
    return read_results(spark, path).withColumn("ord", F.monotonically_increasing_id())


def write_results(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, outer spaces kept. `single` sends all rows through one task into one file named `path`, for results of a size a user reads as one file."""
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if not single:
        df.write.mode("overwrite").csv(path, **options)
        return
    folder, _, name = path.rstrip("/").rpartition("/")
    files, parts = Files(df.sparkSession, folder or "."), f"{name}.parts"
    df.coalesce(1).write.mode("overwrite").csv(files.full(parts), **options)
    files.delete(name)
    files.rename(f"{parts}/{next(p for p in files.names(parts) if p.endswith('.csv'))}", name)
    files.delete(parts)
