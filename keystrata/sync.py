"""Pulling wanted rows from a remote store and pushing a local store's buckets to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators import access as acc
from keystrata.operators.lookup import lookup
from keystrata.sources.layout import DatasetId, DatasetNotFound
from keystrata.store import Store, WriteStats


def pull(remote: Store, local: Store, ds: DatasetId, wanted: DataFrame, neighbours: bool = False) -> WriteStats:
    """Copies the wanted rows the local store lacks, with their newest access; with `neighbours` their keys enter the local neighbour index."""
    asked = local.wanted(wanted).groupBy("input").agg(F.min("ord").alias("ord"))
    if local.has(ds):
        asked = acc.delta(asked, local.results(ds))
    rows = lookup(remote.results(ds), asked)
    stats = local.write(ds, rows)
    listed = acc.latest(remote.access(ds)).join(asked.select("input"), "input", "left_semi").select("input", "access")
    if stats.new and listed.limit(1).count():
        local._append_access(ds, listed)
    if stats.new and neighbours:
        local.index_neighbours(ds)
    return stats


def push(local: Store, remote: Store, model: str, version: str) -> dict[str, int]:
    """Rows each default bucket of the remote store gained; a key in both buckets goes as public only."""
    buckets = [b for b in (local.public, local.private) if local.has(DatasetId(b, model, version))]
    if not buckets:
        raise DatasetNotFound(f"{model}/{version}")
    listed = local.list_available(model, version)
    done = {}
    for b in buckets:
        ds = DatasetId(b, model, version)
        mine = local.results(ds).join(listed.where(F.col("bucket") == b), "input", "left_semi")
        kind = "public" if b == local.public else "private"
        done[b] = remote.write(DatasetId(remote.public if kind == "public" else remote.private, model, version), mine, access=kind).new
    return done
