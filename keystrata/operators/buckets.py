"""Which keys stand in which bucket, and what a catalog counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(keys_by_bucket: list[tuple[str, DataFrame]], last: bool = False) -> DataFrame:
    """(input, bucket): each key once, with the first bucket that holds it, or the last."""
    parts = [df.select("input", F.lit(i).alias("at"), F.lit(b).alias("bucket")) for i, (b, df) in enumerate(keys_by_bucket)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    pick = F.max_by if last else F.min_by
    return all_.groupBy("input").agg(pick("bucket", "at").alias("bucket"))


def inspected(wanted: DataFrame, where: DataFrame) -> DataFrame:
    """(ord, input, available, bucket): every wanted row, with an empty bucket where its key is nowhere."""
    return wanted.select("ord", "input").join(where, "input", "left").select("ord", "input", F.col("bucket").isNotNull().alias("available"), F.coalesce("bucket", F.lit("")).alias("bucket"))


def entries(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., entries): different keys of each dataset."""
    return rows.where(F.col("input").isNotNull()).groupBy(*by).agg(F.countDistinct("input").alias("entries"))


def of_prefix(rows: DataFrame, prefix: str, column: str = "model_id") -> DataFrame:
    return rows.where(F.col(column).startswith(prefix))
