"""Keys: normalising, first write wins, what is new and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.text import blank_to_null
from keystrata.plans.joins import sized_join


def key_of(df: DataFrame) -> Column:
    """The trimmed `input`, else the trimmed `smiles`, null where both are blank or absent."""
    own = {c.lower(): c for c in reversed(df.columns)}
    parts = [blank_to_null(F.col(own[k]).cast("string")) for k in ("input", "smiles") if k in own]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def with_key(df: DataFrame) -> DataFrame:
    """`df` with its normalised key as `input`; rows without a key and the columns it came from are dropped."""
    return df.withColumn("_key", key_of(df)).drop(*[c for c in df.columns if c.lower() in ("input", "smiles")]).withColumnRenamed("_key", "input").where(F.col("input").isNotNull())


def first_wins(df: DataFrame, key: str, order: str, at: str | None = None) -> DataFrame:
    """One row per key, the one of lowest `order`.

    Only keys and orders are combined and joined back, so wide rows aren't sorted, and a hot key
    sends one row per task. `at`, a column that tells all rows apart, settles equal orders; without
    it `order` must tell the rows of a key apart.
    """
    at = at or order
    firsts = df.groupBy(key).agg((F.min(order) if at == order else F.min_by(at, order)).alias(at))
    return df.join(firsts, [key, at], "left_semi")


def unseen(df: DataFrame, existing: DataFrame, key: str = "input") -> DataFrame:
    """Rows whose key `existing` lacks: the exact form of a membership filter.

    The keys of `df` that exist are found by a semi join that reads the key column of `existing`
    once and doesn't shuffle it where those of `df` can be broadcast.
    """
    return df.join(present(df, existing, key), key, "left_anti")


def present(df: DataFrame, existing: DataFrame, key: str = "input") -> DataFrame:
    """(key): the different keys of `df` that `existing` holds."""
    mine = df.select(key).distinct()
    return sized_join(existing.select(key), mine, key, "left_semi").distinct()


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly `columns`, in this order: absent ones null, others dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
