import pytest

from keystrata.functions.grid import SuppliedDescriptors, bin_right_closed
from keystrata.operators.chunks import chunk_no, with_ordinal
from keystrata.operators.lookup import MissingInputs, lookup, push_keys
from keystrata.plans.joins import measured_bytes, sized_join
from keystrata.plans.session import shared_dir
from keystrata.sources import csv_io, json_sidecars
from keystrata.sources.layout import DatasetId, DatasetNotFound, file_counts
from keystrata.store import SchemaMismatch, Store, UnmatchedAccess
from keystrata.streaming.ingest import ingest
from keystrata.sync import pull, push
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


DS = DatasetId("proj", "m", "v1")


def rows(spark, pairs, f="f1"):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], f"ord long, input string, {f} string")


def wanted(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "ord long, input string")


def stats(s):
    return s.new, s.duplicates, s.blank, s.rejected


def test_first_write_wins_and_idempotence(spark, store):
    assert stats(store.write(DS, rows(spark, [("a", "1"), ("b", "2"), (" a\t", "9"), ("", "5"), (" ", "6"), (None, "7")]))) == (2, 1, 3, 0)
    second = rows(spark, [("b", "7"), ("c", "3")])
    assert stats(store.write(DS, second)) == (1, 1, 0, 0)
    assert stats(store.write(DS, second)) == (0, 2, 0, 0)
    assert {(r.input, r.f1) for r in store.results(DS).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    store.write(DS, rows(spark, [("d", "4")], "g"))
    assert {(r.input, r.f1, r.g) for r in store.results(DS).collect()} >= {("d", None, "4"), ("a", "1", None)}
    with pytest.raises(SchemaMismatch):
        store.write(DS, spark.createDataFrame([("e", 1)], "input string, f1 int"))


def test_ordered_read(spark, store):
    store.write(DS, rows(spark, [("a", "1"), ("b", "2"), ("c", "3")]))
    assert [r.f1 for r in store.read(DS, wanted(spark, ["c", " a", "c"])).collect()] == ["3", "1", "3"]
    with pytest.raises(MissingInputs) as e:
        store.read(DS, wanted(spark, ["a", "z1", "z2", "z3", "z4", "z5", "z6", "z7"]))
    assert e.value.first == ["z1", "z2", "z3", "z4", "z5"] and e.value.total == 7
    assert store.read(DS, wanted(spark, ["zz", "a"]), strict=False).count() == 1
    assert store.read(DS, wanted(spark, []).limit(0)).count() == 0
    with pytest.raises(DatasetNotFound):
        store.read(DatasetId("proj", "m", "v9"), wanted(spark, ["a"]))


def test_a_full_cell_is_written_by_several_tasks(spark, tmp_path):
    s = Store(spark, str(tmp_path), max_rows=1_000)
    assert stats(s.write(DS, spark.range(20_000).selectExpr("concat('k', id) input", "id f"))) == (20_000, 0, 0, 0)
    files = file_counts(s.results(DS)).collect()
    assert len(files) >= 20 and max(r.n for r in files) <= 1_000
    assert "/row=2/" in files[0].file and s.read(DS, spark.range(20_000).selectExpr("id ord", "concat('k', 19999 - id) input")).count() == 20_000


def test_equal_orders_keep_one_row(spark, store):
    d = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (0, "b", "z"), (1, "b", "q")], "ord long, input string, f string")
    assert stats(store.write(DS, d)) == (2, 2, 0, 0)
    assert {r.f for r in store.results(DS).where("input = 'b'").collect()} == {"z"}


def test_long_lists_of_keys_are_filtered_too(spark):
    d = spark.range(2_000).selectExpr("cast(id as string) input")
    for n in (3, 300):
        assert push_keys(d, [str(i) for i in range(n)]).count() == n
    assert push_keys(d, []).count() == 0


def test_null_and_repeated_ordinals(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "input string, f int")
    w = spark.createDataFrame([(None, "a"), (5, "a"), (5, "a"), (9, "c"), (1 << 40, "b")], "ord long, input string")
    assert sorted(lookup(d, w).collect(), key=str) == sorted([(None, "a", 1), (5, "a", 1), (5, "a", 1), (1 << 40, "b", 2)], key=str)


def test_measured_bytes_is_an_upper_bound(spark):
    d = spark.range(100).selectExpr("array_repeat(id, 2048) a", "cast(id as string) s", "map('k', array('x')) m", "named_struct('q', id, 'r', cast(null as string)) t", "id")
    assert measured_bytes(d) >= 100 * 2048 * 8
    assert measured_bytes(d.limit(0)) == 0
    assert sized_join(spark.range(10), spark.range(5), "id", limit=0).count() == 5


def test_write_needs_an_access_on_the_command_line(tmp_path):
    from keystrata import cli

    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--root", str(tmp_path), "write", "-b", "p", "-m", "m", "--input", "x.csv"])


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_approximate_read(spark, store):
    store.write(DS, rows(spark, [("CCOCC", "1"), ("NNNN", "2")]))
    assert [(r.input, r.f1) for r in store.read(DS, wanted(spark, ["NNN", "CCOC"]), approximate=True).collect()] == [("NNNN", "2"), ("CCOCC", "1")]


def test_approximate_read_by_the_neighbour_index(spark, store):
    keys = ["".join("CNO"[(i // 3**j) % 3] for j in range(6)) for i in range(300)]
    store.write(DS, rows(spark, [(k, k) for k in keys[:200]]))
    store.index_neighbours(DS)
    store.write(DS, rows(spark, [(k, k) for k in keys[200:]]))
    store.index_neighbours(DS)
    got = [(r.input, r.f1) for r in store.read(DS, wanted(spark, [keys[250], keys[3] + "C", keys[250]]), approximate=True).collect()]
    assert len(got) == 3 and got[0] == got[2] == (keys[250], keys[250]) and got[1][0] in keys


def test_bins(spark):
    d = spark.createDataFrame([(200.0,), (200.0001,), (500.0,), (500.0001,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in d.select(bin_right_closed(F.col("x"), (200, 500))).collect()] == [1, 2, 2, 3, 3, None]


def test_grid_and_rejects(spark, tmp_path):
    s = Store(spark, str(tmp_path), provider=SuppliedDescriptors())
    d = spark.createDataFrame([("a", "200", "-1"), ("b", "501", "6"), ("c", "?", "1"), ("d", None, "1")], "input string, mw string, logp string")
    assert stats(s.write(DS, d)) == (2, 0, 0, 2)
    assert {(r.input, r.row, r.col) for r in s.index(DS).collect()} == {("a", 1, 1), ("b", 3, 3)}
    assert "row=1" in file_counts(s.results(DS)).where("n = 1").orderBy("file").first().file


def test_copy_move_remove(spark, store):
    store.write(DS, rows(spark, [(k, k) for k in "abcd"]))
    access = spark.createDataFrame([("a", "public"), ("b", "PRIVATE"), ("c", "both"), ("d", None), ("", "public")], "input string, access string")
    store._append_access(DS, access)
    assert store.copy(DS) == (1, 1) and store.copy(DS) == (0, 0)
    assert [(r.input, r.bucket) for r in store.list_available("m", "v1").orderBy("input").collect()] == [("a", "public"), ("b", "private")]
    with pytest.raises(ValueError):
        store.move(DatasetId("public", "m", "v1"))
    with pytest.raises(UnmatchedAccess):
        store.move(DS)  # c and d have no target: nothing is lost
    assert store.results(DS).count() == 4 and {r.input for r in store.unmatched(DS).collect()} == {"c", "d"}
    store._append_access(DS, spark.createDataFrame([("c", "public"), ("d", "private")], "input string, access string"))
    assert store.move(DS) == (1, 1) and not store.has(DS)
    assert {(r.input, r.bucket) for r in store.list_available("m", "v1").collect()} == {("a", "public"), ("b", "private"), ("c", "public"), ("d", "private")}
    with pytest.raises(ValueError):
        store.remove(DatasetId("public", "m", "v1"))
    assert store.remove(DatasetId("public", "m", "v1"), confirm=True) > 0
    with pytest.raises(DatasetNotFound):
        store.list_available("m", "v2")


def test_bucket_precedence(spark, store):
    for b, keys in (("public", "ab"), ("private", "bc")):
        store.write(DatasetId(b, "m", "v1"), rows(spark, [(k, b) for k in keys]))
    assert {(r.input, r.bucket) for r in store.list_available("m", "v1").collect()} == {("a", "public"), ("b", "public"), ("c", "private")}
    got = store.inspect_inputs(wanted(spark, ["b", "x", "b"]), "m", "v1").collect()
    assert [(r.input, r.available, r.bucket) for r in got] == [("b", True, "private"), ("x", False, ""), ("b", True, "private")]


def test_catalog_and_compaction(spark, store):
    store.write(DS, rows(spark, [("a", "1"), ("b", "1")]))
    ten = DatasetId("proj", "m", "v10")
    for k in "xyz":
        store.write(ten, rows(spark, [(k, "1")]))
    assert {(r.model, r.entries, r.chunks) for r in store.catalog("proj").collect()} == {("m/v1", 2, 1), ("m/v10", 3, 3)}
    store.compact(ten)
    assert {(r.model, r.entries, r.chunks) for r in store.catalog("proj", "m").collect()} == {("m/v1", 2, 1), ("m/v10", 3, 1)}
    assert store.catalog("proj", "q").count() == 0


def test_sync(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    pub, pri = DatasetId("public", "m", "v1"), DatasetId("private", "m", "v1")
    a.write(pub, rows(spark, [("a", "1"), ("b", "2")]), access="public")
    a.write(pri, rows(spark, [("b", "3"), ("c", "4")]), access="private")
    assert push(a, b, "m", "v1") == {"public": 2, "private": 1}
    c = Store(spark, str(tmp_path / "c"))
    assert stats(pull(b, c, pub, wanted(spark, ["b", "b", "zz"])))[0] == 1
    assert stats(pull(b, c, pub, wanted(spark, ["a", "b"])))[0] == 1
    assert {(r.input, r.access) for r in c.access(pub).collect()} == {("a", "public"), ("b", "public")}


def test_chunks(spark):
    d = spark.range(11).select((F.col("id") * 3).alias("k"))
    n = with_ordinal(d, "k").select("k", "ordinal", chunk_no(F.col("ordinal"), 3, 2, 5).alias("c")).orderBy("k").collect()
    assert [r.ordinal for r in n] == list(range(1, 12)) and [r.c for r in n] == [5, 6, 6, 6, 7, 7, 7, 8, 8, 8, 9]


def test_csv_fixture(spark, tmp_path):
    lines = ["input,f1,f2", '"C/C=C\\C",1,', '"C\\\\",2,x', '" CCO ",3,"a ""q"" b"', "", ",4,y", '"multi\nline",5,z', "short,6", '"T\\","7,8",w']
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    got = csv_io.read_wanted(spark, str(tmp_path / "w.csv")).orderBy("ord").collect()
    assert [(r.input, r.f1, r.f2) for r in got] == [("C/C=C\\C", "1", ""), ("C\\\\", "2", "x"), (" CCO ", "3", 'a "q" b'), ("", "4", "y"), ("multi\nline", "5", "z"), ("short", "6", ""), ("T\\", "7,8", "w")]
    csv_io.write_results(spark.createDataFrame([("C\\", 'a "q"', "")], "input string, f string, g string"), str(tmp_path / "out"), single=True)
    assert csv_io.read_results(spark, str(tmp_path / "out")).first() == ("C\\", 'a "q"', "")
    assert (tmp_path / "out").is_file()
    csv_io.write_results(spark.createDataFrame([(" a ", None)], "input string, f string"), str(tmp_path / "many"))
    assert csv_io.read_results(spark, str(tmp_path / "many")).first() == (" a ", "")


def test_json_sidecars(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"a": [1, 2], "C\\\\": [3, 1]}')
    i = json_sidecars.read_index(spark, str(tmp_path / "i.json"))
    assert {tuple(r) for r in i.collect()} == {("a", 1, 2), ("C\\", 3, 1)}
    json_sidecars.write_index(i, str(tmp_path / "o"))
    assert json_sidecars.read_index(spark, str(tmp_path / "o")).count() == 2
    (tmp_path / "a.json").write_text('[{"input": " a", "access": "public"}, {"input": "a", "access": "private"}]')
    a = json_sidecars.read_access(spark, str(tmp_path / "a.json")).orderBy(F.desc("seq")).collect()
    assert [(r.input, r.access) for r in a] == [("a", "public"), ("a", "private")]


def test_streamed_ingest(spark, store, tmp_path):
    src = tmp_path / "src"
    for part in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]):
        rows(spark, part).drop("ord").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("input string, f1 string").option("maxFilesPerTrigger", 1).parquet(str(src))
    ingest(stream, store, DS, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.input for r in store.results(DS).collect()) == ["a", "b", "c"]


def test_dump(spark, store, tmp_path):
    store.write(DS, rows(spark, [("a", "1")]))
    store.copy(DS, str(tmp_path / "dump"))
    assert list((tmp_path / "dump").rglob("*.parquet"))


def test_catalog_on_the_command_line_is_whole(spark, tmp_path, monkeypatch, capsys):
    from keystrata import cli

    many = spark.range(1_100).selectExpr("concat('m', id, '/v1') model", "id entries", "1 chunks")
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    monkeypatch.setattr(cli.Store, "catalog", lambda *a: many)
    cli.run(["--root", str(tmp_path), "catalog", "-b", "b"])
    assert capsys.readouterr().out.count("/v1") == 1_100
    cli.run(["--root", str(tmp_path), "catalog", "-b", "b", "--output", str(tmp_path / "out.csv")])
    assert (tmp_path / "out.csv").exists()
