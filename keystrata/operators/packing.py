"""Wide feature columns and one array: the array reads and shuffles as one column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def homogeneous(df: DataFrame, features: list[str]) -> bool:
    return len({df.schema[c].dataType.simpleString() for c in features}) == 1


def pack(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """`df` with the feature columns, all of one type, as one array."""
    if not homogeneous(df, features):
        raise ValueError("features of different types can't be packed")
    return df.select(*[c for c in df.columns if c not in features], F.array(*features).alias(name))


def unpack(df: DataFrame, features: list[str], name: str = "features", wanted: list[str] | None = None) -> DataFrame:
    """`df` with all features, or only the `wanted` ones, as columns of their own."""
    at = {c: i for i, c in enumerate(features)}
    return df.select(*[c for c in df.columns if c != name], *[F.get(name, F.lit(at[c])).alias(c) for c in (wanted or features)])
