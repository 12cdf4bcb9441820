"""Ordered batch lookup: stored rows for wanted keys, in request order and multiplicity.

The wanted list is broadcast only where it measures below a bound; otherwise both sides are
shuffled by key, where AQE splits a key that is wanted very often. Stored data are pruned to
the wanted columns and, given coordinates, to their partitions before the join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.keys import present, unseen
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable

#: Longest list of literal keys that is pushed to the scan as such.
LITERALS = 200
#: Ordinals that may share an array.
ORDINALS = 1 << 16


class MissingInputs(LookupError):
    """Wanted keys that the store lacks."""

    def __init__(self, first: list[str], total: int):
        super().__init__(f"{total} wanted inputs are not stored, first: {', '.join(first)}")
        self.first, self.total = first, total


def lookup(store: DataFrame, wanted: DataFrame, key: str = "input", columns: Iterable[str] | None = None) -> DataFrame:
    """(ord, key, columns): unsorted inner lookup; repeated wanted and stored keys multiply.

    The wanted side holds each key once, with the array of its ordinals, in blocks: so a key wanted
    very often is a few rows, neither sent out nor shuffled row by row.
    """
    kept = [c for c in (columns or store.columns) if c not in (key, "ord")]
    block = F.floor(F.col("ord") / ORDINALS)
    once = wanted.groupBy(key, block.alias("_block")).agg(F.collect_list(F.struct("ord")).alias("_ords")).drop("_block")
    return sized_join(store.select(key, *kept), once, key).select(F.explode("_ords").alias("_o"), key, *kept).select("_o.ord", key, *kept)


def ordered(found: DataFrame, *ties: str) -> DataFrame:
    """`found` in request order."""
    return found.orderBy("ord", *ties)


def push_keys(store: DataFrame, keys: list, key: str = "input") -> DataFrame:
    """`store` filtered by literal keys. A short list reaches the scan as literals, a longer one is joined, with its bounds pushed to the scan."""
    if len(keys) <= LITERALS:
        return store.where(F.col(key).isin(keys))
    given = store.sparkSession.createDataFrame([(k,) for k in set(keys)], store.select(key).schema)
    return sized_join(store.where(F.col(key).between(min(keys), max(keys))), given, key, "left_semi")


def push_cells(store: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    """`store` filtered by at most nine (row, col) literals, which prune partitions."""
    if not cells:
        return store.where(F.lit(False))
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    exact = F.lit(False)
    for r, c in cells:
        exact = exact | ((F.col("row") == r) & (F.col("col") == c))
    return store.where(F.col("row").isin(rows) & F.col("col").isin(cols) & exact)


def missing(wanted: DataFrame, index: DataFrame, key: str = "input") -> DataFrame:
    """Wanted rows whose key the index lacks; repeats stay."""
    return unseen(wanted, index, key)


def missing_preview(wanted: DataFrame, index: DataFrame, key: str = "input", n: int = 5) -> DataFrame:
    """The first `n` missing rows in request order."""
    return missing(wanted, index, key).orderBy("ord").limit(n)


def strict_lookup(store: DataFrame, wanted: DataFrame, key: str = "input", columns: Iterable[str] | None = None) -> DataFrame:
    """`lookup` that fails with `MissingInputs` if a wanted key is not stored."""
    held = durable(present(wanted, store, key))
    gone = wanted.join(held, key, "left_anti")
    total = gone.count()
    if total:
        raise MissingInputs([r[0] for r in gone.orderBy("ord").limit(5).select(key).collect()], total)
    return lookup(store, wanted, key, columns)


def cell_keys(wanted: DataFrame, index: DataFrame, key: str = "input") -> DataFrame:
    """(row, col, n): number of different wanted keys in each cell of the grid."""
    return wanted.select(key).distinct().join(index.select(key, "row", "col"), key).groupBy("row", "col").agg(F.count("*").alias("n"))
