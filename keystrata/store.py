"""The store: keyed, versioned result tables by bucket, model and version.

Layout: <root>/<bucket>/<model>/<version>/results/row=R/col=C/*.parquet and .../access/*.parquet;
.../schema holds the columns as JSON, so that a read opens no footers to learn them. The index is
a projection of the results, so it can't disagree with them. Results are committed before access;
a move deletes its source only after every key of it arrived somewhere. One writer per dataset at
a time is assumed, as nothing here locks.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.grid import OneCell, place
from keystrata.operators import access as acc
from keystrata.operators import buckets, key_neighbour, lookup
from keystrata.operators.keys import first_wins, key_of, present, unseen, with_key
from keystrata.operators.nearest import CellIndex
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable
from keystrata.sources.layout import DatasetId, DatasetNotFound, Files


class SchemaMismatch(ValueError):
    pass


class UnmatchedAccess(ValueError):
    """A move would lose rows that have no target."""


@dataclass
class WriteStats:
    new: int
    duplicates: int
    blank: int
    rejected: int
    seconds: float = 0.0

    @property
    def rows_per_second(self) -> float:
        """Rows given per second, 0 where no time was measured."""
        return (self.new + self.duplicates + self.blank + self.rejected) / self.seconds if self.seconds > 0 else 0.0


class Store:
    def __init__(self, spark: SparkSession, root: str, public: str = "public", private: str = "private", max_rows: int = 100_000, provider=None):
        self.spark, self.files = spark, Files(spark, root)
        self.public, self.private, self.max_rows = public, private, max_rows
        self.provider = provider or OneCell()

    # -- reading -------------------------------------------------------------------------------

    def has(self, ds: DatasetId) -> bool:
        return self.files.exists(f"{ds.path}/results")

    def results(self, ds: DatasetId) -> DataFrame:
        if not self.has(ds):
            raise DatasetNotFound(ds.path)
        path, schema = self.files.full(f"{ds.path}/results"), self._schema(ds)
        if schema is None:  # written by other means: the footers tell
            return self.spark.read.option("mergeSchema", True).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _schema(self, ds: DatasetId) -> T.StructType | None:
        if not self.files.exists(f"{ds.path}/schema/_SUCCESS"):
            return None
        return T.StructType.fromJson(json.loads(self.spark.read.text(self.files.full(f"{ds.path}/schema")).first()[0]))

    def _keep_schema(self, ds: DatasetId, new: T.StructType) -> None:
        """Adds columns that the stored schema lacks; it is written before the rows, as columns without rows do no harm."""
        old = self.results(ds).schema if self.has(ds) else T.StructType()
        cells = [T.StructField(c, T.IntegerType()) for c in ("row", "col")]
        fields = [f for f in [*old.fields, *[f for f in new.fields if f.name not in old.names]] if f.name not in ("row", "col")]
        merged = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + cells)
        if merged != self._schema(ds):
            staged = f"{ds.path}/schema.staged"
            self.spark.createDataFrame([(merged.json(),)], "value string").coalesce(1).write.mode("overwrite").text(self.files.full(staged))
            self.files.replace(f"{ds.path}/schema", staged)

    def index(self, ds: DatasetId) -> DataFrame:
        """(input, row, col) of the stored keys; reads only these columns."""
        return self.results(ds).select("input", "row", "col")

    def access(self, ds: DatasetId) -> DataFrame:
        if not self.files.exists(f"{ds.path}/access"):
            return self.spark.createDataFrame([], "input string, access string, seq long")
        return self.spark.read.parquet(self.files.full(f"{ds.path}/access"))

    def wanted(self, rows: DataFrame) -> DataFrame:
        """(ord, input): normalised wanted keys; rows without `ord` need a source that keeps its order."""
        if "ord" not in rows.columns:
            rows = rows.withColumn("ord", F.monotonically_increasing_id())
        return with_key(rows).select("ord", "input")

    def read(self, ds: DatasetId, wanted: DataFrame, columns: Iterable[str] | None = None, approximate: bool = False, strict: bool = True) -> DataFrame:
        """Stored rows of the wanted keys, in request order and multiplicity.

        A missing key fails the read unless `strict` is off; `approximate` takes each key's nearest
        stored key first, so that none is missing: by the dataset's neighbour index if it has one,
        else by scoring all stored keys.
        """
        store, asked = self.results(ds).drop("row", "col"), self.wanted(wanted)
        if approximate:
            index = self._neighbours(ds)
            near = key_neighbour.nearest_keys(store, asked) if index is None else self._nearest(index, store, asked)
            asked = asked.join(near, "input").select("ord", F.col("neighbour").alias("input"))
        found = (lookup.strict_lookup if strict and not approximate else lookup.lookup)(store, asked, columns=columns)
        return lookup.ordered(found, "input").drop("ord")

    def _neighbours(self, ds: DatasetId) -> CellIndex | None:
        path = f"{ds.path}/neighbours"
        return CellIndex.open(self.spark, self.files.full(path)) if self.files.exists(f"{path}/centres/_SUCCESS") else None

    @staticmethod
    def _nearest(index: CellIndex, store: DataFrame, asked: DataFrame) -> DataFrame:
        """(input, neighbour): a stored key is its own neighbour; the index finds that of the others."""
        mine = durable(asked.select("input").distinct())
        held = durable(present(mine, store))
        others = durable(key_neighbour.vectors(mine.join(held, "input", "left_anti")))
        found = durable(index.top1(others))
        keys = sized_join(store.select("input", F.xxhash64("input").alias("id")), found.select("id").distinct(), "id").distinct()
        near = others.select(F.col("id").alias("query_id"), "input").join(found, "query_id").join(keys.withColumnRenamed("input", "neighbour"), "id")
        rest = others.join(found.select(F.col("query_id").alias("id")), "id", "left_anti")
        parts = [near, held.select("input", F.col("input").alias("neighbour")), key_neighbour.nearest_keys(store, rest)]
        return reduce(DataFrame.unionByName, [p.select("input", "neighbour") for p in parts])

    def index_neighbours(self, ds: DatasetId) -> None:
        """Inserts the stored keys that the dataset's neighbour index lacks; the first time it is fitted."""
        index = self._neighbours(ds)
        rows = durable(key_neighbour.vectors(self.results(ds)).select("id", "vector"))
        if index is None:
            cells = max(16, int(rows.count() ** 0.5) // 16)
            CellIndex(rows, cells=cells).save(self.files.full(f"{ds.path}/neighbours"))
        else:
            index.insert(rows)

    def list_available(self, model: str, version: str, bucket_names: Iterable[str] | None = None) -> DataFrame:
        """(input, bucket): the first bucket in the order given wins, by default public before private."""
        return buckets.listed(self._keys(model, version, bucket_names))

    def inspect_inputs(self, wanted: DataFrame, model: str, version: str, bucket_names: Iterable[str] | None = None) -> DataFrame:
        """(ord, input, available, bucket): the last bucket in the order given wins."""
        return buckets.inspected(self.wanted(wanted), buckets.listed(self._keys(model, version, bucket_names), last=True)).orderBy("ord")

    def _keys(self, model: str, version: str, names: Iterable[str] | None) -> list[tuple[str, DataFrame]]:
        ids = [DatasetId(b, model, version) for b in (names or (self.public, self.private))]
        found = [(i.bucket, self.results(i).select("input")) for i in ids if self.has(i)]
        if not found:
            raise DatasetNotFound(f"{model}/{version}")
        return found

    def catalog(self, bucket: str, prefix: str = "") -> DataFrame:
        """(model, entries, chunks) of every dataset of a bucket; `model` is name/version, taken from whole folder names.

        One scan of the key columns over all datasets, grouped by the folders in their files' paths.
        """
        found = [DatasetId(bucket, m, v) for m in self.files.prefixes(bucket) if m.startswith(prefix) for v in self.files.prefixes(f"{bucket}/{m}")]
        found = [self.files.full(f"{ds.path}/results") for ds in found if self.has(ds)]
        if not found:
            return self.spark.createDataFrame([], "model string, entries long, chunks long")
        rows = self.spark.read.schema("input string").option("recursiveFileLookup", True).parquet(*found)
        file = F.col("_metadata.file_path")
        folder = F.regexp_extract(file, r"([^/]+/[^/]+)/results/(?:[^/]+/)*[^/]+$", 1)
        keys = rows.select("input", folder.alias("model"), F.xxhash64(file).alias("file")).groupBy("model", "input", "file").agg(F.lit(1).alias("one"))
        chunks = keys.groupBy("model", "file").agg(F.lit(1).alias("one")).groupBy("model").agg(F.count("*").alias("chunks"))
        entries = keys.groupBy("model", "input").agg(F.lit(1).alias("one")).groupBy("model").agg(F.count("input").alias("entries"))
        return entries.join(chunks, "model").select(F.url_decode("model").alias("model"), "entries", "chunks")

    # -- writing -------------------------------------------------------------------------------

    def write(self, ds: DatasetId, rows: DataFrame, access: str | None = None) -> WriteStats:
        """Appends the rows whose key is new; of several with one key the first stays.

        Rows are taken in the order of a column `ord`, or as the source gives them. Features may be
        added later; a column whose type differs from the stored one stops the write.
        """
        began = time.monotonic()
        rows = rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())
        rows = durable(rows.withColumn("_key", key_of(rows)).withColumn("_at", F.monotonically_increasing_id()))
        total, n_keyed = rows.agg(F.count("*"), F.count("_key")).first()
        keyed = rows.drop(*[c for c in rows.columns if c.lower() in ("input", "smiles")]).withColumnRenamed("_key", "input").where(F.col("input").isNotNull())
        firsts = first_wins(keyed, "input", "ord", "_at").drop("_at")
        if self.has(ds):
            old = self.results(ds)
            stored = {f.name: f.dataType for f in old.schema}
            for f in firsts.schema:
                if f.name in stored and f.name not in ("row", "col", "ord") and stored[f.name] != f.dataType:
                    raise SchemaMismatch(f"{f.name}: stored as {stored[f.name].simpleString()}, given as {f.dataType.simpleString()}")
            firsts = unseen(firsts, old)
        placed = durable(firsts if {"row", "col"} <= set(firsts.columns) else place(firsts, self.provider))
        is_placed = F.col("row").isNotNull() & F.col("col").isNotNull()
        n_placed, n_new = placed.agg(F.count("*"), F.count_if(is_placed)).first()
        if n_new:
            new = placed.where(is_placed).drop("ord").withColumns({c: F.col(c).cast("int") for c in ("row", "col")})
            self._keep_schema(ds, new.schema)
            self._spread(new).write.mode("append").option("maxRecordsPerFile", self.max_rows).partitionBy("row", "col").parquet(self.files.full(f"{ds.path}/results"))
            if access is not None:
                self._append_access(ds, new.select("input", F.lit(access).alias("access")))
        return WriteStats(n_new, n_keyed - n_placed, total - n_keyed, n_placed - n_new, time.monotonic() - began)

    def _spread(self, rows: DataFrame) -> DataFrame:
        """`rows` by cell, each cell over as many tasks as it holds chunks, so that a full cell is no single task; sorted by key within."""
        sizes = rows.groupBy("row", "col").agg(F.count("*").alias("n"))
        parts = durable(sizes.select("row", "col", F.ceil(F.col("n") / self.max_rows).alias("_parts")))  # nine rows at most
        tasks = parts.agg(F.sum("_parts")).first()[0] or 1
        split = rows.join(F.broadcast(parts), ["row", "col"]).withColumn("_part", F.pmod(F.xxhash64("input"), "_parts")).drop("_parts")
        return split.repartition(tasks, "row", "col", "_part").sortWithinPartitions("row", "col", "input").drop("_part")

    def _append_access(self, ds: DatasetId, entries: DataFrame) -> None:
        start = self.access(ds).agg(F.max("seq")).first()[0] or 0
        entries.select("input", "access", (F.lit(start + 1) + F.monotonically_increasing_id()).alias("seq")).write.mode("append").parquet(self.files.full(f"{ds.path}/access"))

    def compact(self, ds: DatasetId) -> None:
        """Rewrites a dataset's many small files as few of at most `max_rows` rows."""
        staged = f"{ds.path}/results.staged"
        self.files.delete(staged)
        self._spread(self.results(ds)).write.option("maxRecordsPerFile", self.max_rows).partitionBy("row", "col").parquet(self.files.full(staged))
        self.files.replace(f"{ds.path}/results", staged)

    # -- moving --------------------------------------------------------------------------------

    def _targets(self, ds: DatasetId) -> list[tuple[str, DatasetId]]:
        return [("private", DatasetId(self.private, ds.model, ds.version)), ("public", DatasetId(self.public, ds.model, ds.version))]

    def copy(self, ds: DatasetId, dump_to: str | None = None, neighbours: bool = False) -> tuple[int, int]:
        """(private, public): rows newly copied to the two default buckets by their access; with `dump_to` the bucket is copied there too, with `neighbours` the new keys enter the targets' neighbour indexes."""
        entries, store = acc.cleaned(self.access(ds)), self.results(ds)
        done = {}
        for kind, target in self._targets(ds):
            if target != ds:
                done[kind] = self.write(target, acc.split(store, entries, kind), access=kind).new
                if done[kind] and neighbours:
                    self.index_neighbours(target)
        if dump_to:
            self.files.dump(ds.bucket, dump_to)
        return done.get("private", 0), done.get("public", 0)

    def unmatched(self, ds: DatasetId) -> DataFrame:
        """(input): stored keys whose access sends them neither to the private nor to the public bucket."""
        entries = acc.cleaned(self.access(ds)).where(F.col("access").isin("public", "private"))
        return acc.delta(self.results(ds).select("input"), entries)

    def move(self, ds: DatasetId) -> tuple[int, int]:
        """`copy`, then the source is deleted, if every stored key of it has a target and stands there.

        A source with keys of other access stays whole and `UnmatchedAccess` tells how many these are.
        """
        if ds.bucket in (self.public, self.private):
            raise ValueError("the source of a move can't be one of its targets")
        if homeless := self.unmatched(ds).count():
            raise UnmatchedAccess(f"{homeless} rows are neither public nor private; nothing was moved")
        counts = self.copy(ds)
        entries, store = acc.cleaned(self.access(ds)), self.results(ds)
        for kind, target in self._targets(ds):
            due = acc.split(store, entries, kind).select("input")
            if (acc.delta(due, self.results(target)).count() if self.has(target) else due.count()) > 0:
                raise RuntimeError(f"not all {kind} rows arrived; the source stays")
        self.files.delete(ds.path)
        return counts

    def remove(self, ds: DatasetId, confirm: bool = False) -> int:
        """Deletes a dataset; the number of files."""
        if not confirm:
            raise ValueError("removal needs confirm=True")
        if not self.files.exists(ds.path):
            raise DatasetNotFound(ds.path)
        return self.files.delete(ds.path)
