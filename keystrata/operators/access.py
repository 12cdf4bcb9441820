"""Access metadata and what it decides about copying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.text import blank_to_null
from keystrata.operators.keys import unseen


def cleaned(entries: DataFrame) -> DataFrame:
    """(input, access, seq): trimmed keys, lower-cased access; rows without a key are dropped."""
    return entries.select(blank_to_null(F.col("input")).alias("input"), F.lower("access").alias("access"), "seq").where(F.col("input").isNotNull())


def keys_with(entries: DataFrame, access: str) -> DataFrame:
    """(input): different keys listed with this access."""
    return entries.where(F.col("access") == access).select("input").distinct()


def split(store: DataFrame, entries: DataFrame, access: str) -> DataFrame:
    """Stored rows whose key is listed as public, or as private. A key listed as both goes to both."""
    return store.join(keys_with(entries, access), "input", "left_semi")


def unmatched(entries: DataFrame) -> DataFrame:
    """(input): different keys that are listed neither as public nor as private."""
    return entries.groupBy("input").agg(F.coalesce(F.bool_or(F.col("access").isin("public", "private")), F.lit(False)).alias("hit")).where(~F.col("hit")).select("input")


def latest(entries: DataFrame) -> DataFrame:
    """(input, access, seq): the newest entry of each key."""
    return entries.groupBy("input").agg(F.max_by("access", "seq").alias("access"), F.max("seq").alias("seq"))


def delta(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of `source` whose key `target` lacks: what a pull or a push moves."""
    return unseen(source, target, "input")
