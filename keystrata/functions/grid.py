"""The 3 x 3 property grid: right-closed bins of molecular weight and logP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edges of the grid.
WEIGHT_EDGES = (200, 500)
LOGP_EDGES = (-1, 5)


def bin_right_closed(c: Column, edges: Sequence[float]) -> Column:
    """Number from 1 of the bin of `c`; an edge belongs to the bin below it, NaN to the last bin, null has none."""
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges, 1):
        out = out.when(c <= edge, F.lit(i))
    return out.otherwise(F.lit(len(edges) + 1))


def coordinates(mw: Column, logp: Column, weight_edges: Sequence[float] = WEIGHT_EDGES, logp_edges: Sequence[float] = LOGP_EDGES) -> Column:
    """struct(row, col): row from logP, col from weight."""
    return F.struct(bin_right_closed(logp, logp_edges).alias("row"), bin_right_closed(mw, weight_edges).alias("col"))


class SuppliedDescriptors:
    """Weight and logP that the rows bring in two columns of their own."""

    def __init__(self, mw: str = "mw", logp: str = "logp"):
        self.mw, self.logp = mw, logp

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("_mw", F.col(self.mw).try_cast("double")).withColumn("_logp", F.col(self.logp).try_cast("double"))


class ChemistryDescriptors:
    """Weight and logP computed from the key by RDKit, where that is installed; keys it can't parse get nulls."""

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        from rdkit import Chem  # noqa: F401  # fails here, on the driver, rather than in a task

        @F.pandas_udf("mw double, logp double")
        def compute(keys):
            import pandas as pd
            from rdkit import Chem
            from rdkit.Chem import Crippen, Descriptors

            mols = [Chem.MolFromSmiles(k) if k else None for k in keys]
            return pd.DataFrame([(None, None) if m is None else (Descriptors.MolWt(m), Crippen.MolLogP(m)) for m in mols], columns=["mw", "logp"])

        return df.withColumn("_d", compute(F.col(key))).withColumn("_mw", F.col("_d.mw")).withColumn("_logp", F.col("_d.logp")).drop("_d")


class OneCell:
    """All keys in the middle cell, for data without descriptors."""

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("_mw", F.lit(float(WEIGHT_EDGES[1]))).withColumn("_logp", F.lit(float(LOGP_EDGES[1])))


def place(df: DataFrame, provider, key: str = "input") -> DataFrame:
    """`df` with row and col; both are null where a descriptor is missing."""
    d = provider.apply(df, key)
    at = coordinates(F.col("_mw"), F.col("_logp"))
    both = F.col("_mw").isNotNull() & F.col("_logp").isNotNull()
    return d.withColumn("row", F.when(both, at["row"])).withColumn("col", F.when(both, at["col"])).drop("_mw", "_logp")
