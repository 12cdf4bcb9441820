"""Joins whose physical form depends on a measured size."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is sent to every executor.
BROADCAST_BYTES = 24 << 20


def _value_bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value as Spark keeps it in a row, rounded up to words, with those its variable part takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.StructType):
        return reduce(add, [_value_bytes(c[f.name], f.dataType) for f in kind.fields], F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(32).cast("long"), lambda n, x: n + _value_bytes(x, kind.elementType)), F.lit(8))
        return F.lit(32) + F.coalesce(F.size(c), F.lit(0)) * 9
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of `df`, an upper estimate from its types; one aggregation over `df`."""
    row = reduce(add, [_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(32))
    return df.select(F.sum(row)).first()[0] or 0


def sized_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts `small` if it measures at most `limit` bytes.

    Beyond that it is a plain shuffle join: `small` must hold each key once, so that AQE may
    split a hot key of `big` over several tasks without repeating more than one row.
    """
    return big.join(F.broadcast(small) if measured_bytes(small) <= limit else small, on, how)
