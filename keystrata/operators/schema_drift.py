"""Schemas that drift between the files of a dataset.

Every file gets a fingerprint of its schema (names and types without regard to order). Files are
ordered within their dataset; where the fingerprint differs from the file before, migration
steps are derived (rename, default, drop, cast) and recorded. Steps are chained, so any file is
routed from its own schema to the latest one of its dataset, and all records load into one table.

Defined cases: null dataset columns form a dataset of their own; a manifest row without a header
or without a batch number takes no part; equal batch numbers are taken in order of file_id; a
header naming a field twice counts its first cell; datasets with one file have no changes.

Two vanished fields equal to one new field are both renames of it; in the one table its values
come from the lesser name, and the other field ends there (`links`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.text import is_blank
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable
from keystrata.sources.layout import Files
from keystrata.sources.messy_csv import CsvLoad

DATASET = ["bucket", "model_id", "model_version"]
#: Keys on which both cells are non-empty and equal that a rename needs.
RENAME_KEYS = 3


def _is_key(name: Column) -> Column:
    return F.lower(name).isin("input", "smiles")


class SchemaHistory:
    """Versions, changes and migration of the files in a manifest.

    manifest: file_id, the DATASET columns, batch_no. load: the files' records.
    """

    def __init__(self, manifest: DataFrame, load: CsvLoad, rename_keys: int = RENAME_KEYS):
        self.load, self.rename_keys, self._renames = load, rename_keys, None
        schemas = load.headers.join(load.types, "file_id").select("file_id", "names", "types")
        order = Window.partitionBy(*DATASET).orderBy("batch_no", "file_id")  # one small row per file; the window spills
        files = manifest.where(F.col("batch_no").isNotNull()).select("file_id", *DATASET, "batch_no").dropDuplicates(["file_id"])
        fields = F.array_sort(F.arrays_zip("names", "types"))
        self.files = durable(
            files.join(schemas, "file_id")
            .withColumn("fingerprint", F.sha2(F.to_json(fields), 256))
            .withColumn("before", F.lag(F.struct("file_id", "names", "types", "fingerprint")).over(order))
            .withColumn("step_no", F.row_number().over(order))
        )

    def versions(self) -> DataFrame:
        """(dataset, version_no, fingerprint, file_id, fields): one row per file at which the schema changed."""
        w = Window.partitionBy(*DATASET).orderBy("step_no")
        changed = self.files.where(F.col("before").isNull() | (F.col("before.fingerprint") != F.col("fingerprint")))
        return changed.select(*DATASET, F.row_number().over(w).alias("version_no"), "fingerprint", "file_id", F.to_json(F.arrays_zip("names", "types")).alias("fields"))

    def _drift(self) -> DataFrame:
        """One row per file whose fingerprint differs: its new and vanished names and the positions of both."""
        d = self.files.where(F.col("before.fingerprint") != F.col("fingerprint"))
        return d.select(
            "file_id",
            F.col("before.file_id").alias("prev_id"),
            "names",
            "types",
            F.col("before.names").alias("old_names"),
            F.col("before.types").alias("old_types"),
            F.array_except("names", "before.names").alias("new"),
            F.array_except("before.names", "names").alias("gone"),
        )

    def renames(self, drift: DataFrame) -> DataFrame:
        """(file_id, old, new) by equal values over the keys both files hold; computed once."""
        if self._renames is None:
            self._renames = durable(self._renamed(drift))
        return self._renames

    def _renamed(self, drift: DataFrame) -> DataFrame:
        both = drift.where((F.size("new") > 0) & (F.size("gone") > 0))
        side = lambda fid, own, names, role: both.select(F.col(fid).alias("file_id"), F.col("file_id").alias("pair"), F.lit(role).alias("role"), F.transform(own, lambda x: F.array_position(F.col(names), x).cast("int") - 1).alias("at"))
        roles = durable(side("prev_id", "gone", "old_names", 0).unionByName(side("file_id", "new", "names", 1)))
        records = self.load.valid().select("file_id", "rec_no", "key", "cells")
        cells = sized_join(records, roles.groupBy("file_id").agg(F.collect_list(F.struct("pair", "role", "at")).alias("roles")), "file_id")
        picked = cells.select("key", "rec_no", "cells", F.explode("roles").alias("r")).select("r.pair", "r.role", "key", "rec_no", F.transform("r.at", lambda i: F.get("cells", i)).alias("vals"))
        first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("vals")), F.when(F.col("role") == role, F.col("rec_no")))
        keyed = picked.groupBy("pair", "key").agg(first(0).alias("old"), first(1).alias("new")).where(F.col("old").isNotNull() & F.col("new").isNotNull())
        compared = keyed.select("pair", F.posexplode("old").alias("i", "a"), "new").where("a != ''").select("pair", "i", "a", F.posexplode("new").alias("j", "b")).where("b != ''")
        same = compared.groupBy("pair", "i", "j").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("eq")).where((F.col("n") >= self.rename_keys) & (F.col("n") == F.col("eq")))
        return same.join(both, same["pair"] == both["file_id"]).select("file_id", F.get("gone", F.col("i")).alias("old"), F.get("new", F.col("j")).alias("new"))

    def changes(self) -> DataFrame:
        """(file_id, field_name, change_kind, old_name, detail): every change against the file before."""
        drift = self._drift()
        renames = self.renames(drift)
        new = renames.groupBy("file_id", F.col("new").alias("field_name")).agg(F.array_join(F.array_sort(F.collect_set("old")), ", ").alias("old_name"))
        row = lambda kind, detail: (F.lit(kind).alias("change_kind"), detail.alias("detail"))
        none = F.lit(None).cast("string")
        renamed = new.select("file_id", "field_name", *row("renamed", none), "old_name")
        added = drift.select("file_id", F.explode("new").alias("field_name")).join(new, ["file_id", "field_name"], "left_anti").select("file_id", "field_name", *row("added", none), none.alias("old_name"))
        gone = drift.select("file_id", F.explode("gone").alias("field_name"))
        removed = gone.join(renames.select("file_id", F.col("old").alias("field_name")), ["file_id", "field_name"], "left_anti").select("file_id", "field_name", *row("removed", none), none.alias("old_name"))
        was = F.get("old_types", (F.array_position(F.col("old_names"), F.col("f.names")) - 1).cast("int"))
        kept = drift.select("file_id", "names", "old_names", "old_types", F.posexplode(F.arrays_zip("names", "types")).alias("pos", "f")).where(F.array_contains("old_names", F.col("f.names")) & ~_is_key(F.col("f.names")) & (F.col("pos") == F.array_position(F.col("names"), F.col("f.names")) - 1))
        retyped = kept.where(was != F.col("f.types")).select("file_id", F.col("f.names").alias("field_name"), *row("retyped", F.concat_ws(" to ", was, F.col("f.types"))), none.alias("old_name"))
        return renamed.unionByName(added).unionByName(removed).unionByName(retyped)

    def migrations(self) -> DataFrame:
        """(dataset, step_no, file_id, rule, field_name, argument): the steps from each file's schema to the next one."""
        rule = F.create_map(*[F.lit(x) for x in ("renamed", "rename", "added", "default", "removed", "drop", "retyped", "cast")])
        c = self.changes().withColumn("rule", rule[F.col("change_kind")])
        merged = self.renames(self._drift()).select("file_id", "old", "new").join(self.links(), ["file_id", "old", "new"], "left_anti")
        ended = merged.join(self.links().select("file_id", "old"), ["file_id", "old"], "left_anti").groupBy("file_id", F.col("old").alias("field_name")).agg(F.min("new").alias("new"))
        none = F.lit(None).cast("string")
        c = c.select("file_id", "rule", "field_name", "old_name", "detail").unionByName(ended.select("file_id", F.lit("drop").alias("rule"), "field_name", none.alias("old_name"), F.concat(F.lit("equal to "), "new").alias("detail")))
        return self.files.select(*DATASET, "step_no", "file_id").join(c, "file_id").select(*DATASET, "step_no", "file_id", "rule", "field_name", F.coalesce("old_name", "detail").alias("argument"))

    def routes(self) -> DataFrame:
        """(file_id, name, field): the name a file's field has at the end of its dataset's history.

        A field lives through runs of files under one name; renames link the end of one run with
        the start of the next. Two fields of one file that end under one name are told apart by a number. The links are followed by pointer jumping over these runs (their
        number follows the changes, not the records), doubling the distance in every round.
        """
        w = Window.partitionBy(*DATASET, "name").orderBy("step_no")
        named = self.files.select(*DATASET, "step_no", "file_id", F.explode(F.array_distinct("names")).alias("name"))
        runs = named.withColumn("new_run", F.coalesce(F.col("step_no") - F.lag("step_no").over(w) != 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new_run").over(w))
        runs = durable(runs.withColumn("node", F.sha2(F.to_json(F.struct(*DATASET, "name", "run")), 256)).drop("new_run"))
        link = self.links()
        prev = self.files.select("file_id", F.col("before.file_id").alias("prev_id"))
        a = runs.select(F.col("file_id").alias("prev_id"), F.col("name").alias("old"), F.col("node").alias("node"))
        b = runs.select("file_id", F.col("name").alias("new"), F.col("node").alias("next"))
        hops = durable(link.join(prev, "file_id").join(a, ["prev_id", "old"]).join(b, ["file_id", "new"]).groupBy("node").agg(F.min("next").alias("next")))
        while True:
            far = hops.select(F.col("node").alias("next"), F.col("next").alias("further"))
            jumped = durable(hops.join(far, "next", "left").select("node", F.coalesce("further", "next").alias("next"), F.col("further").isNotNull().alias("moved")))
            if not jumped.where("moved").limit(1).count():
                break
            hops = jumped.drop("moved")
        names = runs.groupBy(F.col("node").alias("next")).agg(F.min("name").alias("last_name"))
        ends = hops.select("node", "next").join(names, "next", "left").select("node", "last_name", F.col("next").alias("end"))
        routed = durable(runs.join(ends, "node", "left").select("file_id", "name", F.coalesce("last_name", "name").alias("field"), F.coalesce("end", "node").alias("end")))
        several = routed.groupBy("file_id", "field").agg(F.sort_array(F.collect_set("end")).alias("ends")).where(F.size("ends") > 1)
        clashing = several.select(F.explode(F.slice("ends", F.lit(2), F.size("ends") - 1)).alias("end")).distinct().withColumn("clash", F.lit(True))
        own = F.concat("field", F.lit(" "), F.substring("end", 1, 8))
        return routed.join(clashing, "end", "left").select("file_id", "name", F.when(F.col("clash"), own).otherwise(F.col("field")).alias("field"))

    def links(self) -> DataFrame:
        """(file_id, old, new): the renames that values follow, one new name for each old one and one old for each new one.

        Of several equal candidates the least name wins; the others end there, recorded as drops.
        """
        one = self.renames(self._drift()).groupBy("file_id", "old").agg(F.min("new").alias("new"))
        return one.groupBy("file_id", "new").agg(F.min("old").alias("old")).select("file_id", "old", "new")

    def unified(self) -> DataFrame:
        """One table of all valid records: (bucket, model_id, model_version, file_id, rec_no, key, fields).

        `fields` maps every field of the dataset's history, under its last name, to the record's
        value: renamed by the chain, null by default where the file lacks it, and cast to DOUBLE
        and back where every file of the dataset holds numbers in it, so that equal numbers read alike.
        A file of keys alone has nulls in all of them, a dataset of such files no fields.
        """
        routes = durable(self.routes())
        typed = self.files.select(*DATASET, "file_id", F.explode(F.arrays_zip("names", "types")).alias("f")).select(*DATASET, "file_id", F.col("f.names").alias("name"), F.col("f.types").alias("type"))
        kinds = typed.join(routes, ["file_id", "name"]).where(~_is_key(F.col("field"))).groupBy(*DATASET, "field").agg(F.bool_and(F.col("type") != "text").alias("number"))
        target = kinds.groupBy(*DATASET).agg(F.map_from_entries(F.collect_list(F.struct("field", "number"))).alias("target"))
        per_file = routes.where(~_is_key(F.col("field"))).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("route"))
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in DATASET]
        plan = self.files.alias("f").join(target.alias("t"), same[0] & same[1] & same[2], "left").join(per_file, F.col("f.file_id") == per_file["file_id"], "left").select(
            F.col("f.file_id"), *[F.col(f"f.{c}") for c in DATASET], F.coalesce("route", F.create_map().cast("map<string,string>")).alias("route"), F.coalesce("target", F.create_map().cast("map<string,boolean>")).alias("target")
        )
        rows = sized_join(self.load.valid().select("file_id", "rec_no", "key", "names", "cells"), durable(plan), "file_id")
        distinct = F.array_distinct("names")
        cell_of = lambda n: F.get("cells", (F.array_position(F.col("names"), n) - 1).cast("int"))
        own = rows.withColumn("own", F.map_from_arrays(distinct, F.transform(distinct, cell_of)))
        value = lambda k: F.nullif(F.try_element_at("own", F.try_element_at("route", k)), F.lit(""))
        return own.select(*DATASET, "file_id", "rec_no", "key", F.transform_values("target", lambda k, num: F.when(num, value(k).try_cast("double").cast("string")).otherwise(value(k))).alias("fields"))


class SchemaRegistry:
    """Fingerprints and changes of all files so far, kept below the folder `path`; one writer at a time.

    A delivery parses its own files, the files before them in their datasets and, where a file comes
    in between two known ones, the next: no other record is read again.
    """

    FILES = "file_id long, bucket string, model_id string, model_version string, batch_no long, fingerprint string"
    CHANGES = "file_id long, field_name string, change_kind string, old_name string, detail string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Files(spark, path)
        done = sorted(int(g) for g in self.store.prefixes("generations") if self.store.exists(f"generations/{g}/changes/_SUCCESS"))
        self.generation = done[-1] if done else 0

    def _kept(self, what: str, schema: str) -> DataFrame:
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.store.full(f"generations/{self.generation}/{what}"))

    def files(self) -> DataFrame:
        """(file_id, the DATASET columns, batch_no, fingerprint) of the files so far."""
        return self._kept("files", self.FILES)

    def changes(self) -> DataFrame:
        """(file_id, field_name, change_kind, old_name, detail) of every file against the one before it."""
        return self._kept("changes", self.CHANGES)

    def add(self, manifest: DataFrame, records: DataFrame) -> DataFrame:
        """The changes that the delivery's files bring. `records` holds those of known files too; only the ones needed are parsed."""
        known = self.files()
        given = manifest.where(F.col("batch_no").isNotNull()).select("file_id", *DATASET, "batch_no").dropDuplicates(["file_id"])
        fresh = given.join(known.select("file_id"), "file_id", "left_anti").withColumn("fresh", F.lit(True))
        has_header = records.where((F.col("rec_no") == 0) & ~is_blank(F.col("raw"))).select("file_id").distinct()
        fresh = durable(fresh.join(has_header, "file_id", "left_semi"))
        order = Window.partitionBy(*DATASET).orderBy("batch_no", "file_id")
        placed = known.drop("fingerprint").withColumn("fresh", F.lit(False)).unionByName(fresh)
        told = placed.withColumn("told", F.col("fresh") | F.coalesce(F.lag("fresh").over(order), F.lit(False)))
        needed = durable(told.withColumn("needed", F.col("told") | F.coalesce(F.lead("told").over(order), F.lit(False))).where("needed"))
        ids = needed.select("file_id")
        history = SchemaHistory(needed.select("file_id", *DATASET, "batch_no"), CsvLoad(sized_join(records, ids, "file_id", "left_semi")))
        new = durable(history.changes().join(needed.where("told").select("file_id"), "file_id", "left_semi").select("file_id", "field_name", "change_kind", "old_name", "detail"))
        prints = history.files.select("file_id", *DATASET, F.col("batch_no").cast("long").alias("batch_no"), "fingerprint").join(fresh.select("file_id"), "file_id", "left_semi")
        into = f"generations/{self.generation + 1}"
        known.unionByName(prints).write.mode("overwrite").parquet(self.store.full(f"{into}/files"))
        self.changes().join(needed.where("told").select("file_id"), "file_id", "left_anti").unionByName(new).write.mode("overwrite").parquet(self.store.full(f"{into}/changes"))
        self.generation += 1
        self.store.delete(f"generations/{self.generation - 1}")
        return new
