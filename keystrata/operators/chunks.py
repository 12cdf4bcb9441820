"""Ordinals and chunks of fixed size, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.plans.session import durable


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """`df` with a dense number from 1 in the order given.

    A range partitioning sorts in parallel; the only global step numbers the partitions, of which
    there are as many as tasks.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets.select("_part", "_before")), "_part")
    return joined.withColumn(name, F.col("_before") + within + 1).drop("_id", "_part", "_before")


def chunk_no(ordinal: Column, cap: int, open_rows: int = 0, first: int = 1) -> Column:
    """Chunk of the row with this ordinal: the open chunk `first` already holds `open_rows` rows."""
    return (F.lit(first) + F.floor((ordinal - 1 + open_rows) / cap)).cast("bigint")


def chunk_sizes(df: DataFrame, cap: int, *order: str) -> DataFrame:
    """(chunk, n): rows of each chunk when packed in order."""
    return with_ordinal(df, *order).groupBy(chunk_no(F.col("ordinal"), cap).alias("chunk")).agg(F.count("*").alias("n"))


def chunk_index(path: Column) -> Column:
    """Number in `.../chunk_<number>.parquet`, 1 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"chunk_(\d+)\.parquet$", 1), F.lit("")).try_cast("bigint"), F.lit(1))


def is_chunk(path: Column) -> Column:
    return path.contains("/chunk_") & path.endswith(".parquet")
