from keystrata.operators.schema_drift import SchemaHistory
from keystrata.sources.messy_csv import RECORD_SCHEMA, CsvLoad

FILES = "file_id long, bucket string, model_id string, model_version string, batch_no int"


def load(spark, rows):
    return CsvLoad(spark.createDataFrame(rows, RECORD_SCHEMA))


def reasons(x):
    return {(r.file_id, r.rec_no): r.reason for r in x.failed().collect()}


def test_reasons_and_types(spark):
    rows = [(1, 0, '﻿"input", a ,b\r')] + [(1, i, f"C{i},{i},{i}.5") for i in range(1, 20)]
    rows += [(1, 20, "(C,1,1"), (1, 21, "C C,1,1"), (1, 22, ",1,1"), (1, 23, "C,x,1"), (1, 24, "C,1"), (1, 25, 'C,"1"x,1'), (1, 26, "  "), (1, 27, None), (1, 28, ' C , "1",1'), (1, 29, "C]1[,,"), (1, 30, "C,,")]
    x = load(spark, rows)
    assert reasons(x) == {(1, 20): "value", (1, 21): "value", (1, 22): "value", (1, 23): "value", (1, 24): "columns", (1, 25): "quoting", (1, 28): "quoting", (1, 29): "value"}
    v = {r.rec_no: r for r in x.valid().collect()}
    assert v[1].names == ["input", "a", "b"] and v[1].types == ["text", "integer", "number"] and v[30].key == "C"


def test_no_header_no_rows_extra_columns(spark):
    assert reasons(load(spark, [(7, 1, "a,b")])) == {(7, 1): "columns"}
    empty = load(spark, [])
    assert empty.failed().count() == 0 and empty.valid().count() == 0
    df = spark.createDataFrame([(1, 0, "input,f", 5), (1, 1, "C,1", 6), (1, 1, "C,1", 6)], "file_id long, rec_no int, raw string, names int")
    assert CsvLoad(df.withColumn("types", df.names).withColumn("n", df.names)).valid().count() == 2


def test_long_and_many_cells(spark):
    wide = ",".join(["input", *(f"f{i}" for i in range(3000))])
    x = load(spark, [(1, 0, wide), (1, 1, ",".join(["C", *["1"] * 3000])), (1, 2, ",".join(["C" * 500_000, *['"1""2"'] * 3000]))])
    assert reasons(x) == {}  # half the cells read 1, the others 1"2: the columns are text


def history(spark, files, rows):
    return SchemaHistory(spark.createDataFrame(files, FILES), load(spark, rows))


def changes(h):
    return {(r.file_id, r.field_name, r.change_kind) for r in h.changes().collect()}


def body(fid, header, cells):
    return [(fid, 0, header), *((fid, i + 1, c) for i, c in enumerate(cells))]


def test_changes(spark):
    files = [(10, "b", "m", "v", 1), (11, "b", "m", "v", 5), (12, "b", "m", "v", 9), (13, None, "m", "v", 9)]
    rows = body(10, "input,a,b,c", [f"C{i},{i},{i},t" for i in range(5)])
    rows += body(11, "a2,smiles,b,d", [f"{i},C{i},{i}.5,z" for i in range(5)])
    rows += body(12, "input,B,d", [f"C{i},{i}.5,z" for i in range(2)])
    rows += body(13, "input,q", ["C1,1"])
    h = history(spark, files, rows)
    assert changes(h) == {
        (11, "a2", "renamed"), (11, "smiles", "renamed"), (11, "c", "removed"), (11, "d", "added"), (11, "b", "retyped"),
        (12, "input", "added"), (12, "B", "added"), (12, "a2", "removed"), (12, "smiles", "removed"), (12, "b", "removed"),
    }  # file 12 shares two keys only, too few for a rename
    assert {r.version_no for r in h.versions().where("bucket = 'b'").collect()} == {1, 2, 3}


def test_chain_of_renames(spark):
    files = [(i, "b", "m", "v", i) for i in range(1, 5)]
    rows = []
    for i, name in enumerate(["a", "b", "c", "c"], 1):
        rows += body(i, f"input,{name}", [f"C{k},{k}" for k in range(4)])
    h = history(spark, files, rows)
    assert changes(h) == {(2, "b", "renamed"), (3, "c", "renamed")}
    routes = {(r.file_id, r.name): r.field for r in h.routes().collect()}
    assert routes[1, "a"] == routes[2, "b"] == routes[4, "c"] == "c"
    out = h.unified().collect()
    assert len(out) == 16 and all(set(r.fields) == {"c"} for r in out)
    assert {r.rule for r in h.migrations().collect()} == {"rename"}


def test_empty_manifest(spark):
    h = history(spark, [], body(1, "input,a", ["C,1"]))
    assert h.changes().count() == 0 and h.unified().count() == 0


def test_files_of_keys_alone(spark):
    files = [(1, "b", "m", "v", 1), (2, "b", "m", "v", 2), (3, None, "m", "v", 1), (4, None, "m", "v", 2)]
    rows = body(1, "input,a", ["C1,1", "C2,2"]) + body(2, "smiles", ["C1", "C3"]) + body(3, "input", ["C1"]) + body(4, "input,smiles", ["C1,C1"])
    out = {(r.file_id, r.key): r.fields for r in history(spark, files, rows).unified().collect()}
    assert out == {(1, "C1"): {"a": "1.0"}, (1, "C2"): {"a": "2.0"}, (2, "C1"): {"a": None}, (2, "C3"): {"a": None}, (3, "C1"): {}, (4, "C1"): {}}


def test_merged_fields_and_equal_last_names(spark):
    files = [(i, "b", "m", "v", i) for i in range(1, 5)]
    same = [f"C{k},{k},{k}" for k in range(4)]
    rows = body(1, "input,a,b", same) + body(2, "input,c", [f"C{k},{k}" for k in range(4)])
    # later a new field is called a again, and then renamed to c while the first c has gone
    rows += body(3, "input,a,x", [f"C{k},9{k},t" for k in range(4)]) + body(4, "input,c,x", [f"C{k},9{k},t" for k in range(4)])
    h = history(spark, files, rows)
    assert changes(h) == {(2, "c", "renamed"), (3, "c", "removed"), (3, "a", "added"), (3, "x", "added"), (4, "c", "renamed")}
    out = {(r.file_id, r.key): r.fields for r in h.unified().collect()}
    assert len(out) == 16 and out[1, "C1"]["c"] == "1.0" and out[1, "C1"]["b"] == "1.0" and out[2, "C1"]["b"] is None
    drops = {(r.file_id, r.field_name, r.argument) for r in h.migrations().collect() if r.rule == "drop"}
    assert drops == {(2, "b", "equal to c"), (3, "c", None)}
