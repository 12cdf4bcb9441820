"""Queries over the store's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.grid import bin_right_closed
from keystrata.functions.text import blank_to_null
from keystrata.operators import access, buckets, chunks, keys, lookup, nearest, packing
from keystrata.operators.key_neighbour import nearest_keys
from keystrata.plans.session import durable, shared_dir
from keystrata.sources import json_sidecars
from keystrata.sources.csv_io import read_results, write_results
from keystrata.sources.layout import DatasetId, Files, file_counts, next_component, part_of
from keystrata.store import Store, UnmatchedAccess
from keystrata.sync import pull, push

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WS = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _t(c: str) -> str:
    """SQL of a trimmed key, null if blank."""
    return f"nullif(regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', ''), '')"


#: Stored rows, first write of each key; the key is trimmed.
_STORE = f"(SELECT * FROM (SELECT * EXCLUDE (input), {_t('input')} AS input FROM stored_results) WHERE input IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input ORDER BY result_id) = 1)"
_WANTED = f"(SELECT ord, {_t('input')} AS input FROM wanted_keys WHERE {_t('input')} IS NOT NULL)"
_INDEX = f"(SELECT DISTINCT {_t('input')} AS input, tranche_row, tranche_col FROM key_index WHERE {_t('input')} IS NOT NULL)"
_ACCESS = f"(SELECT {_t('input')} AS input, lower(access) AS access, seq FROM access_entries WHERE {_t('input')} IS NOT NULL)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _rows(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Stored rows with a trimmed key, of the columns named."""
    return table(s, d, "stored_results").select("result_id", blank_to_null(F.col("input")).alias("input"), *columns).where(F.col("input").isNotNull())


def _store(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return keys.first_wins(_rows(s, d, *columns), "input", "result_id")


def _f3():
    """f3 with -1 for null, so that both engines give the column one integer type."""
    return F.coalesce(F.col("f3").cast("bigint"), F.lit(-1).cast("bigint")).alias("f3")


def _wanted(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "wanted_keys").select("ord", blank_to_null(F.col("input")).alias("input")).where(F.col("input").isNotNull())


def _index(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "key_index").select(blank_to_null(F.col("input")).alias("input"), "tranche_row", "tranche_col").where(F.col("input").isNotNull()).distinct()


def _access(s: SparkSession, d: str) -> DataFrame:
    return access.cleaned(table(s, d, "access_entries"))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("c_custkey"))


# -- lookup ------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS ord, c.* FROM orders JOIN customer c ON c_custkey = o_custkey ORDER BY ord")
def lookup_ordered(s, d):
    return lookup.ordered(lookup.lookup(table(s, d, "customer"), _orders(s, d), "c_custkey"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey)::BIGINT AS position, o_orderkey AS ord, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def lookup_positions(s, d):
    """The place of each row in the ordered result."""
    found = lookup.ordered(lookup.lookup(table(s, d, "customer"), _orders(s, d), "c_custkey", ["c_name"]), "c_custkey")
    return chunks.with_ordinal(found, "ord", name="position").select("position", "ord", "c_name")


@query("SELECT o_orderkey AS ord, c_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def lookup_projected(s, d):
    return lookup.lookup(table(s, d, "customer"), _orders(s, d), "c_custkey", ["c_mktsegment"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def lookup_semi(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name").join(_orders(s, d), "c_custkey", "left_semi")


@query(f"SELECT seq AS ord, a.input, result_id, coalesce(f3, -1)::BIGINT AS f3 FROM {_ACCESS} a JOIN {_STORE} r ON a.input = r.input")
def lookup_results(s, d):
    return lookup.lookup(_store(s, d, _f3()), _access(s, d).withColumnRenamed("seq", "ord"))


@query(f"SELECT seq AS ord, a.input, result_id FROM {_ACCESS} a JOIN (SELECT result_id, {_t('input')} AS input FROM stored_results) r ON a.input = r.input")
def lookup_repeated_store(s, d):
    return lookup.lookup(_rows(s, d), _access(s, d).withColumnRenamed("seq", "ord"))


@query(f"SELECT ord, input, tranche_row, tranche_col FROM {_WANTED} JOIN {_INDEX} USING (input)")
def lookup_lenient(s, d):
    return lookup.lookup(_index(s, d), _wanted(s, d))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (1, 7, 42, 99, 100000000)")
def lookup_literal_keys(s, d):
    return lookup.push_keys(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), [1, 7, 42, 99, 100000000], "c_custkey")


@query(f"SELECT ord, input FROM {_WANTED} WHERE input NOT IN (SELECT input FROM {_INDEX})")
def missing_inputs(s, d):
    return lookup.missing(_wanted(s, d), _index(s, d)).select("ord", "input")


@query(f"SELECT ord, input FROM {_WANTED} WHERE input NOT IN (SELECT input FROM {_INDEX}) ORDER BY ord LIMIT 5")
def missing_preview5(s, d):
    return lookup.missing_preview(_wanted(s, d), _index(s, d)).select("ord", "input")


@query(f"SELECT tranche_row AS row, tranche_col AS col, count(DISTINCT input)::BIGINT AS n FROM {_WANTED} JOIN {_INDEX} USING (input) GROUP BY ALL")
def wanted_by_cell(s, d):
    index = _index(s, d).withColumnsRenamed({"tranche_row": "row", "tranche_col": "col"})
    return lookup.cell_keys(_wanted(s, d), index)


@query(f"SELECT seq AS ord, a.input, result_id FROM {_ACCESS} a JOIN (SELECT {_t('input')} AS input, result_id FROM stored_results WHERE (tranche_row, tranche_col) IN ((2, 2), (3, 1))) r ON a.input = r.input")
def lookup_pruned_cells(s, d):
    rows = _rows(s, d, F.col("tranche_row").alias("row"), F.col("tranche_col").alias("col"))
    return lookup.lookup(lookup.push_cells(rows, [(2, 2), (3, 1)]), _access(s, d).withColumnRenamed("seq", "ord"), columns=["result_id"])


# -- keys and ingest ---------------------------------------------------------------------------


@query(f"SELECT ord, input AS key FROM {_WANTED}")
def key_normalise(s, d):
    return _wanted(s, d).withColumnRenamed("input", "key")


@query(f"SELECT input, result_id, coalesce(f3, -1)::BIGINT AS f3 FROM {_STORE}")
def first_write_wins(s, d):
    return _store(s, d, _f3()).select("input", "result_id", "f3")


_HALF = f"(SELECT result_id, batch_no, {_t('input')} AS input FROM stored_results WHERE {_t('input')} IS NOT NULL)"
_NEW = f"(SELECT input, min(result_id) AS result_id FROM {_HALF} WHERE batch_no % 2 = 1 AND input NOT IN (SELECT input FROM {_HALF} WHERE batch_no % 2 = 0) GROUP BY input)"


def _delivery(s, d) -> tuple[DataFrame, DataFrame]:
    rows = _rows(s, d, "batch_no")
    return rows.where("batch_no % 2 = 0").drop("batch_no"), rows.where("batch_no % 2 = 1").drop("batch_no")


@query(f"SELECT input, result_id FROM {_NEW}")
def write_second_delivery(s, d):
    old, new = _delivery(s, d)
    return keys.unseen(keys.first_wins(new, "input", "result_id"), old).select("input", "result_id")


@query(f"SELECT (SELECT count(*) FROM {_NEW})::BIGINT AS new, (SELECT count(*) FROM {_HALF} WHERE batch_no % 2 = 1)::BIGINT - (SELECT count(*) FROM {_NEW})::BIGINT AS duplicates, (SELECT count(*) FROM stored_results WHERE batch_no % 2 = 1 AND {_t('input')} IS NULL)::BIGINT AS blank")
def write_stats(s, d):
    old, new = _delivery(s, d)
    fresh = keys.unseen(new.select("input").distinct(), old).agg(F.count("*").alias("new"))
    given = table(s, d, "stored_results").where("batch_no % 2 = 1").select(blank_to_null(F.col("input")).alias("k")).agg(F.count("k").alias("keyed"), F.count_if(F.col("k").isNull()).alias("blank"))
    return fresh.join(given).select("new", (F.col("keyed") - F.col("new")).alias("duplicates"), "blank")


@query("SELECT c_custkey, c_mktsegment, NULL::VARCHAR AS remark FROM customer")
def schema_conform(s, d):
    return keys.conform(table(s, d, "customer"), ["c_custkey", "c_mktsegment", "remark"]).withColumn("remark", F.col("remark").cast("string"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


# -- grid --------------------------------------------------------------------------------------

_BIN = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= {a} THEN 1 WHEN {c} <= {b} THEN 2 ELSE 3 END::INTEGER"
_ROW, _COL = _BIN.format(c="p_retailprice", a=925, b=975), _BIN.format(c="p_size", a=10, b=40)


def _placed(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", "p_name", bin_right_closed(F.col("p_retailprice"), (925, 975)).alias("row"), bin_right_closed(F.col("p_size"), (10, 40)).alias("col"))


@query(f"SELECT p_partkey, {_ROW} AS row, {_COL} AS col FROM part")
def grid_bins(s, d):
    return _placed(s, d).drop("p_name")


@query(f"SELECT {_ROW} AS row, {_COL} AS col, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def grid_counts(s, d):
    return _placed(s, d).groupBy("row", "col").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT {_ROW} AS row, {_COL} AS col, p_name FROM part")
def grid_keys(s, d):
    return _placed(s, d).select("row", "col", "p_name").distinct()


# -- chunks ------------------------------------------------------------------------------------


@query("SELECT result_id, ((row_number() OVER (ORDER BY result_id) - 1) // 1000 + 1)::BIGINT AS chunk FROM stored_results")
def chunk_assign(s, d):
    return chunks.with_ordinal(table(s, d, "stored_results").select("result_id"), "result_id").select("result_id", chunks.chunk_no(F.col("ordinal"), 1000).alias("chunk"))


@query("SELECT chunk, count(*)::BIGINT AS n FROM (SELECT (4 + (row_number() OVER (ORDER BY seq) - 1 + 300) // 1000)::BIGINT AS chunk FROM access_entries) GROUP BY chunk")
def chunk_top_up(s, d):
    rows = chunks.with_ordinal(table(s, d, "access_entries").select("seq"), "seq")
    return rows.groupBy(chunks.chunk_no(F.col("ordinal"), 1000, open_rows=300, first=4).alias("chunk")).agg(F.count("*").alias("n"))


_PATH = "bucket || '/' || model_id || '/' || model_version || '/data/chunk_' || batch_no || '.parquet'"


@query("SELECT file_id, bucket AS bucket_part, model_version AS version_part, batch_no::BIGINT AS chunk, true AS is_chunk FROM csv_files")
def path_parse(s, d):
    p = F.col("path")
    return _paths(s, d).select("file_id", part_of(p, 1).alias("bucket_part"), part_of(p, 3).alias("version_part"), chunks.chunk_index(p).alias("chunk"), chunks.is_chunk(p).alias("is_chunk"))


@query("SELECT bucket || '/' || model_id || '/' || model_version AS dataset, max(batch_no)::BIGINT AS last_chunk FROM csv_files GROUP BY ALL")
def last_chunk(s, d):
    p = F.col("path")
    return _paths(s, d).groupBy(F.concat_ws("/", part_of(p, 1), part_of(p, 2), part_of(p, 3)).alias("dataset")).agg(F.max(chunks.chunk_index(p)).alias("last_chunk"))


@query("SELECT DISTINCT model_id AS component FROM csv_files WHERE bucket = 'quartz-tox'")
def prefix_listing(s, d):
    return next_component(_paths(s, d), "path", "quartz-tox/")


def _paths(s, d) -> DataFrame:
    return table(s, d, "csv_files").select("file_id", F.concat(F.concat_ws("/", "bucket", "model_id", "model_version"), F.lit("/data/chunk_"), "batch_no", F.lit(".parquet")).alias("path"))


# -- catalog and buckets -----------------------------------------------------------------------


def _models(s, d) -> DataFrame:
    return _rows(s, d, "model_id", "model_version")


@query(f"SELECT model_id || '/' || model_version AS model, count(DISTINCT {_t('input')})::BIGINT AS entries, ((count(DISTINCT {_t('input')}) + 99) // 100)::BIGINT AS chunks FROM stored_results WHERE {_t('input')} IS NOT NULL GROUP BY ALL")
def catalog_models(s, d):
    e = buckets.entries(_models(s, d), "model_id", "model_version")
    return e.select(F.concat_ws("/", "model_id", "model_version").alias("model"), "entries", F.ceil(F.col("entries") / 100).alias("chunks"))


@query(f"SELECT model_id, count(DISTINCT {_t('input')})::BIGINT AS entries FROM stored_results WHERE {_t('input')} IS NOT NULL AND starts_with(model_id, 'mdl4') GROUP BY ALL")
def catalog_prefix(s, d):
    return buckets.entries(buckets.of_prefix(_models(s, d), "mdl4"), "model_id")


def _by_bucket(s, d) -> list[tuple[str, DataFrame]]:
    rows = _rows(s, d, "bucket")
    return [(b, rows.where(F.col("bucket") == b)) for b in ("lake-public", "lake-private")]


def _listed_sql(pick: str) -> str:
    return f"(SELECT {_t('input')} AS input, {pick}(bucket) AS bucket FROM stored_results WHERE bucket IN ('lake-public', 'lake-private') AND {_t('input')} IS NOT NULL GROUP BY ALL)"


@query(f"SELECT input, bucket FROM {_listed_sql('max')}")
def list_available_first_wins(s, d):
    return buckets.listed(_by_bucket(s, d))


@query(f"SELECT seq AS ord, a.input, bucket IS NOT NULL AS available, coalesce(bucket, '') AS bucket FROM {_ACCESS} a LEFT JOIN {_listed_sql('min')} b ON a.input = b.input")
def inspect_inputs_last_wins(s, d):
    return buckets.inspected(_access(s, d).withColumnRenamed("seq", "ord"), buckets.listed(_by_bucket(s, d), last=True))


@query("SELECT DISTINCT bucket FROM stored_results WHERE bucket IS NOT NULL")
def bucket_list(s, d):
    return table(s, d, "stored_results").select("bucket").where(F.col("bucket").isNotNull()).distinct()


# -- access and transfer -----------------------------------------------------------------------


def _split_sql(kind: str) -> str:
    return f"SELECT input, result_id FROM {_STORE} WHERE input IN (SELECT input FROM {_ACCESS} WHERE access = '{kind}')"


@query(_split_sql("public"))
def access_split_public(s, d):
    return access.split(_store(s, d), _access(s, d), "public").select("input", "result_id")


@query(_split_sql("private"))
def access_split_private(s, d):
    return access.split(_store(s, d), _access(s, d), "private").select("input", "result_id")


@query(f"SELECT DISTINCT input FROM {_ACCESS} WHERE input NOT IN (SELECT input FROM {_ACCESS} WHERE access IN ('public', 'private'))")
def access_unmatched(s, d):
    return access.unmatched(_access(s, d))


@query(f"SELECT (SELECT count(*) FROM ({_split_sql('private')}))::BIGINT AS private, (SELECT count(*) FROM ({_split_sql('public')}))::BIGINT AS public")
def copy_counts(s, d):
    n = lambda kind: access.split(_store(s, d), _access(s, d), kind).agg(F.count("*").alias(kind))
    return n("private").join(n("public"))


@query(f"SELECT input, access, seq FROM {_ACCESS} QUALIFY row_number() OVER (PARTITION BY input ORDER BY seq DESC) = 1")
def access_latest(s, d):
    return access.latest(_access(s, d))


@query(f"SELECT input, result_id FROM {_STORE} WHERE input NOT IN (SELECT input FROM {_ACCESS} WHERE access IN ('public', 'private'))")
def remaining_after_move(s, d):
    moved = _access(s, d).where(F.col("access").isin("public", "private"))
    return access.delta(_store(s, d), moved).select("input", "result_id")


def _delta_sql(a: str, b: str) -> str:
    return f"SELECT DISTINCT {_t('input')} AS input FROM stored_results WHERE bucket = '{a}' AND {_t('input')} NOT IN (SELECT {_t('input')} FROM stored_results WHERE bucket = '{b}' AND {_t('input')} IS NOT NULL)"


def _delta(s, d, a: str, b: str) -> DataFrame:
    rows = _rows(s, d, "bucket")
    return access.delta(rows.where(F.col("bucket") == a).select("input").distinct(), rows.where(F.col("bucket") == b))


@query(_delta_sql("lake-public", "lake-private"))
def pull_delta(s, d):
    return _delta(s, d, "lake-public", "lake-private")


@query(_delta_sql("lake-private", "lake-public"))
def push_delta(s, d):
    return _delta(s, d, "lake-private", "lake-public")


@query(f"SELECT input, tranche_row AS row, tranche_col AS col FROM {_INDEX}")
def index_json_roundtrip(s, d):
    texts = _index(s, d).select(json_sidecars.index_json(F.col("input"), F.col("tranche_row"), F.col("tranche_col")).alias("value"))
    return json_sidecars.index_rows(texts)


# -- the store on disk -------------------------------------------------------------------------


@contextmanager
def _scratch(s: SparkSession) -> Iterator[str]:
    """A folder of the shared file system for one query, deleted with all it holds; results that outlive it are made durable first."""
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        Files(s, path).delete("")


def _given(s, d) -> DataFrame:
    return table(s, d, "stored_results").select(F.col("result_id").alias("ord"), "result_id", "input", "f1", _f3(), F.col("tranche_row").alias("row"), F.col("tranche_col").alias("col"))


DS = DatasetId("project", "all", "v1")
#: Rows of a chunk in these queries.
CHUNK = 500


def _stored(s, d, path: str) -> Store:
    """A store into which all stored results were written under one dataset, in two deliveries."""
    store, rows = Store(s, path, max_rows=CHUNK), _given(s, d)
    store.write(DS, rows.where("ord % 2 = 0"))
    store.write(DS, rows.where("ord % 2 = 1"))
    return store


_WRITTEN = f"(SELECT result_id, {_t('input')} AS input, f1, coalesce(f3, -1)::BIGINT AS f3, tranche_row, tranche_col FROM stored_results WHERE {_t('input')} IS NOT NULL AND tranche_row IS NOT NULL AND tranche_col IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_t('input')} ORDER BY result_id % 2, result_id) = 1)"


@query(f"SELECT r.input, result_id, f3 FROM {_ACCESS} a JOIN {_WRITTEN} r ON a.input = r.input")
def write_read_roundtrip(s, d):
    with _scratch(s) as path:
        return durable(_stored(s, d, path).read(DS, _access(s, d).withColumnRenamed("seq", "ord"), columns=["result_id", "f3"], strict=False))


@query(f"SELECT input, result_id, f3 FROM (SELECT * FROM {_WRITTEN} WHERE result_id % 3 = 0) CROSS JOIN range(2)")
def store_strict_read(s, d):
    """Every third row's key wanted twice, none missing."""
    with _scratch(s) as path:
        store = _stored(s, d, path)
        keys_ = durable(store.results(DS).where("result_id % 3 = 0").select("input", "result_id"))
        wanted = keys_.select(F.col("result_id").alias("ord"), "input").unionByName(keys_.select((-F.col("result_id")).alias("ord"), "input"))
        return durable(store.read(DS, wanted, columns=["result_id", "f3"]))


@query(f"SELECT 'all/v1' AS model, count(*)::BIGINT AS entries FROM {_WRITTEN}")
def store_catalog(s, d):
    """Chunks are files, whose number rests on hashes; `store_chunks` checks their sizes."""
    with _scratch(s) as path:
        return durable(_stored(s, d, path).catalog(DS.bucket)).drop("chunks")


@query(f"SELECT tranche_row AS row, tranche_col AS col, count(*)::BIGINT AS entries, true AS within_cap, true AS as_catalogued FROM {_WRITTEN} GROUP BY ALL")
def store_chunks(s, d):
    """Rows of each cell from the files' counts, whether no file exceeds the cap, and whether the catalog counts as many files."""
    with _scratch(s) as path:
        store = _stored(s, d, path)
        files = file_counts(store.results(DS))
        n = store.catalog(DS.bucket).first().chunks
        cell = lambda c: F.regexp_extract("file", rf"/{c}=(\d+)/", 1).cast("int").alias(c)
        per_cell = files.groupBy(cell("row"), cell("col")).agg(F.sum("n").alias("entries"), (F.max("n") <= CHUNK).alias("within_cap"))
        return durable(per_cell.crossJoin(files.agg((F.count("*") == n).alias("as_catalogued"))))


def _moved(s, d, path: str) -> Store:
    """The store after each key of an access entry was copied to where its entries say."""
    store = _stored(s, d, path)
    store._append_access(DS, table(s, d, "access_entries").select("input", "access"))
    store.copy(DS)
    return store


def _to(kind: str) -> str:
    return f"SELECT input, result_id, '{kind}' AS bucket FROM {_WRITTEN} WHERE input IN (SELECT input FROM {_ACCESS} WHERE access = '{kind}')"


@query(f"{_to('public')} UNION ALL {_to('private')}")
def store_copy(s, d):
    with _scratch(s) as path:
        store = _moved(s, d, path)
        parts = [store.results(DatasetId(b, DS.model, DS.version)).select("input", "result_id", F.lit(b).alias("bucket")) for b in ("public", "private")]
        return durable(parts[0].unionByName(parts[1]))


@query(f"SELECT count(*)::BIGINT AS kept, (SELECT count(*) FROM {_WRITTEN} WHERE input NOT IN (SELECT input FROM {_ACCESS} WHERE access IN ('public', 'private')))::BIGINT AS unmatched FROM {_WRITTEN}")
def store_move_refused(s, d):
    """A move that would lose keys without a target leaves every row in place."""
    with _scratch(s) as path:
        store = _moved(s, d, path)
        n = store.unmatched(DS).count()
        try:
            store.move(DS)
        except UnmatchedAccess:
            pass
        return durable(store.results(DS).agg(F.count("*").alias("kept")).withColumn("unmatched", F.lit(n).cast("long")))


@query(f"SELECT input, result_id FROM {_WRITTEN} WHERE input IN (SELECT input FROM {_ACCESS} WHERE access = 'public')")
def store_move(s, d):
    """After a move of keys that all have a target the source is gone and the target holds them."""
    with _scratch(s) as path:
        store = _stored(s, d, path)
        store._append_access(DS, store.results(DS).join(access.keys_with(_access(s, d), "public"), "input", "left_semi").select("input", F.lit("public").alias("access")))
        store._append_access(DS, store.unmatched(DS).select("input", F.lit("private").alias("access")))
        store.move(DS)
        if store.has(DS):
            raise RuntimeError("the source is still there")
        return durable(store.results(DatasetId("public", DS.model, DS.version)).select("input", "result_id"))


@query(f"SELECT input, result_id FROM {_WRITTEN} WHERE input IN (SELECT input FROM {_ACCESS})")
def store_pull(s, d):
    with _scratch(s) as path, _scratch(s) as other:
        remote, local = _stored(s, d, path), Store(s, other)
        pull(remote, local, DS, table(s, d, "access_entries").select("input", F.col("seq").alias("ord")))
        return durable(local.results(DS).select("input", "result_id"))


@query(f"SELECT input, min(bucket) AS bucket FROM (SELECT {_t('input')} AS input, CASE bucket WHEN 'lake-public' THEN 'a' ELSE 'b' END AS bucket FROM stored_results WHERE bucket IN ('lake-public', 'lake-private') AND {_t('input')} IS NOT NULL) GROUP BY input")
def store_push(s, d):
    """A key in both buckets goes as public only."""
    with _scratch(s) as path, _scratch(s) as other:
        local, remote = Store(s, path), Store(s, other)
        for bucket in ("public", "private"):
            local.write(DatasetId(bucket, "m", "v"), table(s, d, "stored_results").where(F.col("bucket") == f"lake-{bucket}").select(F.col("result_id").alias("ord"), "input"))
        push(local, remote, "m", "v")
        parts = [remote.results(DatasetId(b, "m", "v")).select("input", F.lit(t).alias("bucket")) for b, t in (("public", "a"), ("private", "b"))]
        return durable(parts[0].unionByName(parts[1]))


@query(f"SELECT count(*)::BIGINT AS rows_dumped FROM {_WRITTEN}")
def store_dump(s, d):
    with _scratch(s) as path, _scratch(s) as other:
        _stored(s, d, path).files.dump(DS.bucket, f"{other}/dump/{DS.bucket}")
        return durable(Store(s, f"{other}/dump").results(DS).agg(F.count("*").alias("rows_dumped")))


@query("SELECT result_id::VARCHAR AS result_id, coalesce(input, '') AS input, coalesce(model_id, '') AS model_id FROM stored_results")
def csv_roundtrip(s, d):
    """Rows out to CSV files and in again, nulls as empty strings."""
    with _scratch(s) as path:
        write_results(table(s, d, "stored_results").select("result_id", "input", "model_id"), f"{path}/csv")
        return durable(read_results(s, f"{path}/csv"))


@query(f"SELECT input, tranche_row AS row, tranche_col AS col FROM {_INDEX}")
def json_index_files(s, d):
    with _scratch(s) as path:
        json_sidecars.write_index(_index(s, d).withColumnsRenamed({"tranche_row": "row", "tranche_col": "col"}), f"{path}/index")
        return durable(json_sidecars.read_index(s, f"{path}/index"))


@query(f"SELECT {_t('input')} AS input, access FROM access_entries WHERE access IS NOT NULL AND input IS NOT NULL")
def json_access_files(s, d):
    with _scratch(s) as path:
        table(s, d, "access_entries").where("access is not null and input is not null").select("input", "access").write.json(f"{path}/access")
        return durable(json_sidecars.read_access(s, f"{path}/access", lines=True).select("input", "access"))


# -- nearest neighbours and packing ------------------------------------------------------------


def _vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_TOP1 = "SELECT query_id, id, round(sim, 4) AS similarity, label FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, r.label, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) = 1"


@query(f"SELECT query_id, id, similarity FROM ({_TOP1})")
def ann_exact_top1(s, d):
    v = _vectors(s, d)
    return nearest.exact_top1(v, v.where("id % 100 = 0")).withColumn("similarity", F.round("similarity", 4))


@query(f"SELECT query_id, id, label FROM ({_TOP1})")
def ann_lookup(s, d):
    v = _vectors(s, d)
    near = nearest.exact_top1(v, v.where("id % 100 = 0")).select(F.col("query_id").alias("ord"), "id")
    return lookup.lookup(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), near, "id").withColumnRenamed("ord", "query_id")


@query()
def ann_cells_top1(s, d):
    v = _vectors(s, d)
    return nearest.CellIndex(v).top1(v.where("id % 100 = 0"))


@query()
def ann_saved_cells_top1(s, d):
    """The index kept in a folder: fitted on half of the rows, the others inserted, only the probed cells read."""
    v = _vectors(s, d)
    with _scratch(s) as path:
        index = nearest.CellIndex(v.where("id % 2 = 0")).save(path)
        index.insert(v)
        return durable(nearest.CellIndex.open(s, path).top1(v.where("id % 100 = 0")))


_GRAMS = "list_distinct(list_transform(range(1, length(input) + 3), lambda i: substr(chr(2) || chr(2) || input || chr(3) || chr(3), i, 3)))"
_STORED_KEYS = f"(SELECT input, {_GRAMS} AS grams FROM (SELECT DISTINCT {_t('input')} AS input FROM stored_results) WHERE input IS NOT NULL)"
_ASKED_KEYS = f"(SELECT input, {_GRAMS} AS grams FROM (SELECT DISTINCT {_t('input')} AS input FROM access_entries WHERE seq % 100 = 0) WHERE input IS NOT NULL)"


@query(f"SELECT input, neighbour, round(common / (n + m - common), 6) AS similarity FROM (SELECT a.input, b.input AS neighbour, len(list_intersect(a.grams, b.grams))::DOUBLE AS common, len(a.grams) AS n, len(b.grams) AS m FROM {_ASKED_KEYS} a, {_STORED_KEYS} b) QUALIFY row_number() OVER (PARTITION BY input ORDER BY common / (n + m - common) DESC, neighbour) = 1")
def ann_key_neighbour(s, d):
    asked = table(s, d, "access_entries").where("seq % 100 = 0").select(blank_to_null(F.col("input")).alias("input"))
    return nearest_keys(_rows(s, d), asked).withColumn("similarity", F.round("similarity", 6))


_FEATURES = ["f1", "f2"]


@query(f"SELECT result_id, f1 FROM stored_results WHERE {_t('input')} IS NOT NULL")
def features_packed_column(s, d):
    return packing.unpack(durable(packing.pack(_rows(s, d, *_FEATURES), _FEATURES)), _FEATURES, wanted=["f1"]).drop("input")


@query("SELECT vec_id, embedding[1]::DOUBLE AS v0, embedding[64]::DOUBLE AS v63 FROM embeddings")
def features_unpack(s, d):
    names = [f"v{i}" for i in range(64)]
    wide = packing.unpack(table(s, d, "embeddings").select("vec_id", "embedding"), names, "embedding", ["v0", "v63"])
    return wide.select("vec_id", F.col("v0").cast("double"), F.col("v63").cast("double"))
