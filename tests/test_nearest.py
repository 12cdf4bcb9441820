import random
import re
import time

import numpy as np

from keystrata.operators.key_neighbour import grams, nearest_keys
from keystrata.operators.nearest import CellIndex, exact_top1
from keystrata.plans.joins import sized_join


def vectors(spark, n=400, d=16, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "id long, vector array<double>")


def brute(x, q):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2
    return dict(zip(q, s.argmax(axis=1)))


def test_exact_in_blocks(spark):
    x, df = vectors(spark)
    q = list(range(0, 400, 10))
    want = brute(x, q)
    for block in (1000, 16):
        assert {r.query_id: r.id for r in exact_top1(df, df.where("id % 10 = 0"), block).collect()} == want
    assert exact_top1(df.where("id < 0"), df).count() == 0 == exact_top1(df, df.where("id < 0")).count()


def test_cell_index_recall(spark, small):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id id", "embedding vector")
    q = df.where("id % 10 = 0")
    want = {r.query_id: r.similarity for r in exact_top1(df, q).collect()}
    got = {r.query_id: r.similarity for r in CellIndex(df).top1(q).collect()}
    assert np.mean([got.get(k, -1) >= s - 1e-9 for k, s in want.items()]) >= 0.9


def test_key_neighbours(spark):
    stored = ["CCO", "CCOCC", "NNN", "", None, "CCO"]
    asked = ["CCOC", "NN", "NNN", None]
    d = lambda ks: spark.createDataFrame([(k,) for k in ks], "input string")
    jac = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = {a: min((s for s in stored if s is not None), key=lambda s: (-jac(a, s), s)) for a in asked if a}
    assert {r.input: r.neighbour for r in nearest_keys(d(stored), d(asked), block=2).collect()} == want


def test_join_form_follows_size(spark):
    big, small = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    plan = lambda limit: sized_join(big, small, "k", limit=limit)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(1 << 20) and "broadcast" not in plan(1)


def test_key_without_common_grams(spark):
    df = lambda *keys: spark.createDataFrame([(k,) for k in keys], "input string")
    got = {tuple(r) for r in nearest_keys(df("CCO", "CCN", "BBB"), df("CCO", "zq#", "B")).collect()}
    assert {(a, b) for a, b, _ in got} == {("CCO", "CCO"), ("zq#", "BBB"), ("B", "BBB")} and ("zq#", "BBB", 0.0) in got
    assert nearest_keys(df("CCO").limit(0), df("CCO")).count() == 0


def test_saved_index_reads_probed_cells_and_takes_new_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))]
    df = spark.createDataFrame(data, "id long, vector array<double>")
    index = CellIndex(df.where("id < 400"), cells=12).save(str(tmp_path / "i"))
    index.insert(df)
    index.insert(df.limit(5))  # known ids are not added again
    index = CellIndex.open(spark, str(tmp_path / "i"))
    assert index.rows.count() == 600
    asked = df.where("id % 3 = 0")
    got = {r.query_id: r.id for r in index.top1(asked).collect()}
    want = {r.query_id: r.id for r in exact_top1(df, asked).collect()}
    assert sum(got.get(q) == i for q, i in want.items()) / len(want) >= 0.9
    assert index._cells([1, 2]).select("cell").distinct().count() == 2
    assert re.search(r"PartitionFilters: \[[^]]*cell", index._cells([1, 2])._jdf.queryExecution().toString())


def test_small_score_blocks_give_the_same(spark, monkeypatch):
    from keystrata.operators import nearest

    x, df = vectors(spark, n=200)
    monkeypatch.setattr(nearest, "SCORES", 64)
    assert {r.query_id: r.id for r in exact_top1(df, df.where("id < 40")).collect()} == brute(x, list(range(40)))


def test_key_neighbours_of_many_keys(spark):
    """Pairs are scored in matrices: 60 M pairs with most n-grams in common take seconds."""
    rng = random.Random(4)
    stored, asked = (["".join(rng.choices("CNO(", k=rng.randint(30, 50))) for _ in range(n)] for n in (20_000, 3_000))
    asked += ["é" + asked[0], "CCCC", stored[0], "x"]
    stored += ["CCCCCC", "CCCCC", "\U0001f600x"]
    d = lambda ks: spark.createDataFrame([(k,) for k in ks], "input string").repartition(4)
    d(asked[:3]).count()
    began = time.time()
    got = {r.input: (r.neighbour, r.similarity) for r in nearest_keys(d(stored), d(asked)).collect()}
    assert time.time() - began < 15 and set(got) == set(asked)
    jac = lambda a, b: len(a & b) / len(a | b)
    sets = {k: grams(k) for k in stored}
    for a in asked[:3] + asked[-4:]:
        least = min((-jac(grams(a), s), k) for k, s in sets.items())
        assert got[a] == (least[1], -least[0])
    assert got["CCCC"] == ("CCCCC", 1.0)  # the same n-grams
