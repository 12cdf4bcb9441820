"""Registered queries of the core package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.schema_drift import SchemaHistory, SchemaRegistry
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable, shared_dir
from keystrata.sources.layout import Files
from keystrata.sources.messy_csv import CsvLoad
from keystrata.store_queries import ORACLES as STORE_ORACLES
from keystrata.store_queries import QUERIES as STORE_QUERIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load(spark: SparkSession, d: str) -> CsvLoad:
    return CsvLoad(table(spark, d, "csv_records"))


def _history(spark: SparkSession, d: str) -> SchemaHistory:
    return SchemaHistory(table(spark, d, "csv_files"), _load(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).changes().select("file_id", "field_name", "change_kind")


def p1_maintained(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p1_found, the files arriving in three deliveries at a registry that keeps what it learned."""
    path = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    files, records = table(spark, d, "csv_files"), table(spark, d, "csv_records")
    for k in range(3):
        part = files.where(F.pmod(F.xxhash64("file_id"), F.lit(3)) == k)
        SchemaRegistry(spark, path).add(part, sized_join(records, files.where(F.pmod(F.xxhash64("file_id"), F.lit(3)) <= k).select("file_id").distinct(), "file_id", "left_semi"))
    out = durable(SchemaRegistry(spark, path).changes().select("file_id", "field_name", "change_kind"))
    Files(spark, path).delete("")
    return out


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).unified()


def p1_migrations(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).migrations()


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).versions()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).failed().select("file_id", "rec_no", "reason")


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).failed()


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).valid()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **STORE_QUERIES,
    **{f.__name__: f for f in (p1_found, p1_maintained, p1_unified, p1_migrations, p1_versions, p5_found, p5_repairs, p5_valid)},
}
ORACLES: dict[str, str] = {**STORE_ORACLES}
