import contextlib
import os
import random
import sys
import threading
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from keystrata.llm import bpe, history_graph, leaks, same_record, shared_spans  # noqa: E402
from keystrata.llm.close_pairs import FLIPS, entries  # noqa: E402
from keystrata.llm.queries import ORACLES, QUERIES, TOKENIZERS  # noqa: E402
from keystrata.llm.seen_keys import Chain, KeyHistory, SeenKeys  # noqa: E402
from keystrata.llm.small_world import SmallWorld, planted, scan, signatures  # noqa: E402
from keystrata.plans.session import release, shared_dir  # noqa: E402

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, d, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{d}/{name}.parquet").select(*cols).collect()]


#: Queries with a comparison of their own below.
COMPARED = {"p2_found", "p2_batches", *ORACLES}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - COMPARED))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("wanted_keys", "key_index", "posted_records", "documents", "eval_items"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df, res = QUERIES[name](spark, small), c.execute(ORACLES[name])
    columns = [x[0] for x in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(r) for r in res.fetchall())


# -- seen keys ---------------------------------------------------------------------------------


def test_seen_matches_brute(spark, small):
    want = brute.seen(column(spark, small, "wanted_keys", "ord", "input"), [r[0] for r in column(spark, small, "key_index", "input")])
    assert [r[0] for r in tuples(QUERIES["p3_found"](spark, small))] == sorted(want)


def test_seen_edges(spark):
    rows = [(1, "a"), (2, " a\t"), (3, "A"), (4, None), (5, " "), (6, "　"), (7, "a"), (8, "x" * 200_000), (9, "x" * 200_000), (9, "x" * 200_000), (-5, "q"), (None, "A"), (70_000, "A"), (10, "h")]
    df = spark.createDataFrame([(o, k, 0, "z") for o, k in rows], "ord long, input string, h int, shard string")
    past = spark.createDataFrame([("h ",), (None,), ("",)], "input string")
    assert [r[0] for r in tuples(SeenKeys(block=16).seen(df, past))] == [2, 7, 9, 10, 70_000]
    assert SeenKeys().seen(df.limit(0), past.limit(0)).count() == 0
    assert [r[0] for r in tuples(SeenKeys(per_shard=3, rest=1).seen(df))] == [2, 7, 9, 70_000]


def test_hot_key(spark):
    df = spark.range(30_000).selectExpr("id ord", "if(id % 3 = 0, 'hot', cast(id as string)) input")
    assert SeenKeys(block=512, per_shard=8192, rest=1000).seen(df).count() == 9_999


def test_chain_bound_holds():
    chain, h = Chain(error=0.01, first=256), np.random.default_rng(1).integers(0, 1 << 63, 60_000, dtype=np.uint64)
    wrong = sum(chain.ask(part).sum() for part in np.array_split(h, 40))
    assert len(chain.layers) > 5 and chain.bound <= 0.01 and wrong / len(h) <= 0.01
    assert chain.ask(h).all()  # what was kept is never called new


def test_chain_answers_as_one_by_one():
    h = np.random.default_rng(2).integers(0, 3_000, 5_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, many = Chain(error=0.3, first=64), Chain(error=0.3, first=64)
    want = np.concatenate([one.ask(h[i : i + 1]) for i in range(len(h))])
    firsts = np.unique(h, return_index=True)[1]
    assert want[firsts].any() and not want[firsts].all()  # some new keys are called seen
    assert (many.ask(h, 700) == want).all() and many.packed() == one.packed()


def test_answers_are_the_chains(spark):
    """Loose chains are wrong about new keys of one table, within their bound; exact grouping never is."""
    r = SeenKeys(error=0.1, first=64).rate(spark.range(20_000).selectExpr("id ord", "cast(id as string) input")).first()
    assert 0 < r.wrong == r.seen and r.measured_rate <= r.bound <= 0.1


def test_large_ordinals(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a"), (big + 1, "a"), (big + 2, "h"), (big + 200_000, "a")], "ord long, input string")
    assert [r[0] for r in tuples(SeenKeys().seen(df, spark.createDataFrame([("h",)], "input string")))] == [big + 1, big + 2, big + 200_000]


def test_error_report(spark, small):
    r = QUERIES["p3_error_rate"](spark, small).first()
    assert r.asked > r.seen > 0 and 0 <= r.measured_rate <= r.bound <= SeenKeys().error


def test_error_report_is_of_the_answering_filter(spark, small):
    r = QUERIES["p3_error_rate"](spark, small).first()
    assert 0 < r.bound <= SeenKeys().error and r.seen == QUERIES["p3_found"](spark, small).count()
    loose = SeenKeys(error=1e-3).rate(spark.range(50_000).selectExpr("id ord", "cast(id as string) input")).first()
    assert loose.asked == 50_000 and loose.wrong == loose.seen and 0 <= loose.measured_rate <= loose.bound <= 1e-3


def test_saved_chains_answer_later_deliveries(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/wanted_keys.parquet").select("ord", "input")
    want, got = brute.seen(column(spark, small, "wanted_keys", "ord", "input"), []), []
    middle = df.agg({"ord": "max"}).first()[0] // 2
    for part in (df.where(df.ord <= middle), df.where(df.ord > middle), df.limit(0)):
        got += [r[0] for r in KeyHistory(spark, str(tmp_path / "chains"), shards=5).add(part).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        KeyHistory(spark, str(tmp_path / "chains"), shards=6)


# -- history graph -----------------------------------------------------------------------------


def test_repeats_match_brute(spark, small):
    got = {tuple(r) for r in QUERIES["p2_found"](spark, small).collect()}
    for name, i in (("stored_results", "result_id"), ("access_entries", "seq")):
        assert {(a, b) for t, a, b in got if t == name} == brute.repeats(column(spark, small, name, i, "input"))


def test_batches_give_the_same(spark, small):
    assert tuples(QUERIES["p2_batches"](spark, small)) == tuples(QUERIES["p2_found"](spark, small))


def chains():
    base = "c1ccccc1NC(=O)CCN(C)C(=O)OC"
    # b matches a, c matches b but not a: c is accepted
    return [(1, base), (2, base + "XY"), (3, base + "XYZW"), (4, base), (5, "short"), (6, "shorT"), (7, " short "), (8, None), (9, ""), (10, base[1:] + "Q"), (None, base), (11, "y" * 1_500), (12, "y" * 1_499)]


def test_repeat_edges(spark, tmp_path):
    df = spark.createDataFrame([(i, k, 1, 2, "c") for i, k in chains()], "seq long, input string, n int, rep int, cell string")
    want = brute.repeats(chains())
    assert (1, 2) in want and (1, 4) in want and all(d != 3 for _, d in want)
    assert {tuple(r) for r in history_graph.link(df, "seq").collect()} == want
    assert {tuple(r) for r in history_graph.link(df.union(df), "seq").collect()} == want
    assert history_graph.link(df.limit(0), "seq").count() == 0
    open_ = lambda: history_graph.HistoryIndex(spark, f"{tmp_path}/3", fan=3)  # noqa: E731  # every delivery opens the saved index anew
    parts = [open_().add(df.where(c), "seq").collect() for c in ("seq <= 2", "seq > 2 and seq <= 4", "seq > 4 and seq <= 10", "seq > 10 or seq is null")]
    assert {tuple(r) for p in parts for r in p} == want and open_().segments() == [(0, 3), (1, 0)]
    assert open_().shards().select("level", "k").distinct().count() == len(open_().segments())
    assert open_().add(df.limit(0), "seq").count() == 0 and open_().batches == 4
    with pytest.raises(ValueError):
        history_graph.HistoryIndex(spark, f"{tmp_path}/3", fan=5)


def test_unfinished_delivery_is_taken_again(spark, tmp_path):
    df = spark.createDataFrame(chains()[:4], "seq long, input string")
    index = history_graph.HistoryIndex(spark, str(tmp_path / "h"))
    index.add(df.where("seq <= 2"), "seq").collect()
    index.add(df.where("seq > 2"), "seq").collect()
    index.files.delete("commits/2")  # as if the job had ended before its commit
    again = history_graph.HistoryIndex(spark, str(tmp_path / "h"))
    assert again.batches == 1 and {tuple(r) for r in again.add(df.where("seq > 2"), "seq").collect()} == {(1, 4)}


def test_schedule():
    for fan in (2, 3, 8):
        for n in range(1, 70):
            covered = sorted(b for level, k in history_graph.standing(n, fan) for b in range(k * fan**level, (k + 1) * fan**level))
            assert covered == list(range(n))
            alive = history_graph.standing(n, fan)
            met = [(level, k) for level in history_graph._levels(n, fan) for k in range(n // fan**level + 1) if history_graph._met(np.array([n]), level, k, fan)[0]]
            assert sorted(met) == sorted([*alive, (0, n)])


def test_small_shards_and_parts_lose_nothing(spark, small):
    rows = column(spark, small, "access_entries", "seq", "input")
    df = spark.read.parquet(f"{small}/access_entries.parquet")
    assert {tuple(r) for r in history_graph.link(df, "seq", batch=None, cap=8, queries=16, fan=3).collect()} == brute.repeats(rows)


def peak_bytes(spark, work):
    """Most bytes of shuffles, checkpoints and files of an index that stood at once while `work` ran, beyond those before."""
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_dir(spark).removeprefix("file:")]
    on, seen = threading.Event(), []

    def size():
        total = 0
        for folder, _, names in (x for f in folders for x in os.walk(f)):
            for name in names:
                with contextlib.suppress(OSError):
                    total += os.path.getsize(f"{folder}/{name}")
        return total

    def watch():
        while not on.wait(0.05):
            seen.append(size())

    release(spark)
    time.sleep(2)
    seen.append(size())
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        work()
    finally:
        on.set()
        watcher.join()
    return max(seen) - seen[0]


def test_disk_of_a_delivery_follows_its_keys(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("CNOSP()=c1", k=40)), i // 1_000) for i in range(8_000)]
    df = spark.createDataFrame(rows, "seq long, input string, batch_no long").repartition(4)
    assert peak_bytes(spark, lambda: history_graph.link(df, "seq", batch="batch_no", room=1 << 21).count()) < 7 * 8_000 * (40 + history_graph.KEPT)


def test_waves_and_rounds_lose_nothing(spark, small, tmp_path):
    rows = column(spark, small, "access_entries", "seq", "input")
    df = spark.read.parquet(f"{small}/access_entries.parquet")
    index = history_graph.HistoryIndex(spark, str(tmp_path / "w"), cap=128, queries=256, fan=2, room=1)
    assert {tuple(r) for part in ("seq % 2 >= 0 and seq < 300", "seq >= 300") for r in index.add(df.where(part), "seq").collect()} == brute.repeats(rows)
    assert index.files.prefixes("work") == [] and index.shards().count() > 1


def test_probes_reach_the_cells_of_the_router(spark):
    sets, keys = (3, 17), ["c1ccccc1NC(=O)CCN(C)C(=O)OC", "short", "y" * 40, "CNO" * 20, "é" * 24]
    placed = history_graph._placed(spark.createDataFrame([(0, i, 1, k) for i, k in enumerate(keys)], "batch long, id long, n long, key string"), sets)
    got = {(r.id, r.cell) for r in history_graph._probing(placed, 1 + len(sets)).collect()}
    assert got == {(i, c) for i, k in enumerate(keys) for _, c in history_graph._cells([k], len(k) >= history_graph.LEAST, sets)}


def test_very_long_keys(spark):
    long = [(1, "y" * 300_000), (2, "y" * 299_999), (3, "y" * 299_990), (4, "z" * 300_000)]
    assert {tuple(r) for r in history_graph.link(spark.createDataFrame(long, "seq long, input string"), "seq").collect()} == {(1, 2)}


def test_dense_group(spark):
    """Many variants of one key: beams widen until all of a dense group is found."""
    rng, base = random.Random(5), "CCN(C)C(=O)c1ccc(Cl)cc1OCCNC(=O)"
    rows = []
    for i in range(150):
        k = list(base)
        for _ in range(rng.randint(0, 2)):
            k[rng.randrange(len(k))] = rng.choice("CNOSP")
        rows.append((i, "".join(k)))
    df = spark.createDataFrame(rows, "seq long, input string")
    assert {tuple(r) for r in history_graph.link(df, "seq").collect()} == brute.repeats(rows)


def test_graph_recall_against_exhaustive_search(spark):
    """The beam planted neighbours set gives at least 99 % of other planted ones and of the true pairs."""
    keys = sorted({k.strip() for (k,) in column(spark, "/root/testdata/sf0.1", "stored_results", "input") if k and len(k.strip()) >= 24})[:4000]
    s = signatures(keys)
    g = SmallWorld.build(s, signatures(planted(keys[::10], 2)), 12)
    assert len(g.entries) < len(s) / 4
    for queries in (s, signatures(planted(keys[5::10], 2, seed=4))):
        got = set(zip(*[x.tolist() for x in g.within(queries, 12)]))
        want = {(a + i, b) for a in range(0, len(queries), 500) for i, b in zip(*[x.tolist() for x in np.nonzero(scan(queries[a : a + 500], s) <= 12)])}
        assert got <= want and len(want) > 300 and len(got) / len(want) >= 0.99


def test_two_edits_leave_a_common_piece():
    rng = random.Random(1)
    for n in (24, 25, 31, 32, 33, 40, 47):
        keys = ["".join(rng.choice("CNO()=c1é" if n % 2 else "CNO()=c1") for _ in range(n)) for _ in range(300)]
        pairs = [(a, b) for a, b in zip(keys, planted(keys, 2)) if len(b) >= history_graph.LEAST]
        at, piece, entered, sketch = (x.tolist() for x in entries(pa.array([k for p in pairs for k in p])))
        asked, own, bits = [set() for _ in range(2 * len(pairs))], [set() for _ in range(2 * len(pairs))], dict(zip(at, sketch))
        for i, h, e in zip(at, piece, entered):
            asked[i].add(h)
            own[i].update([h] if e else [])
        assert len(pairs) > 100 and all((own[i] & asked[i + 1] or own[i + 1] & asked[i]) and (bits[i] ^ bits[i + 1]).bit_count() <= FLIPS for i in range(0, 2 * len(pairs), 2))


def test_a_checked_delivery_finds_all_planted_keys_without_graphs(spark, monkeypatch):
    """Work no longer follows the size of cells: graphs are for pieces that many keys hold only."""
    rng = random.Random(6)
    keys = ["".join(rng.choices("CNO()=c1", k=rng.randint(24, 70))) for _ in range(3_000)]
    rows = [*enumerate(keys), *enumerate(planted(keys, 2), 3_000)]
    monkeypatch.setattr(history_graph, "build_shards", None)
    got = {tuple(r) for r in history_graph.link(spark.createDataFrame(rows, "seq long, input string"), "seq", room=1).collect()}  # in several waves
    assert got == {(i, i + 3_000) for i, k in enumerate(keys) if len(rows[i + 3_000][1]) >= history_graph.LEAST or rows[i + 3_000][1] == k}


def test_crowded_pieces_enter_graphs(spark, small, monkeypatch):
    rows, built = column(spark, small, "access_entries", "seq", "input"), []
    made = history_graph.build_shards
    monkeypatch.setattr(history_graph, "build_shards", lambda *a: built.append(1) or made(*a))
    df = spark.read.parquet(f"{small}/access_entries.parquet")
    assert {tuple(r) for r in history_graph.link(df, "seq", batch="batch_no", dense=1, cap=8, queries=16).collect()} == brute.repeats(rows) and built


def test_edits_match_brute():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(2))
        assert history_graph.within_edits(a, b) == brute.within(a, b, 2)


def test_routing_loses_no_pair():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("CNO()=c1") for _ in range(rng.randint(24, 70)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("CNOxyé")] * rng.randint(0, 1)
        own = {c for _, c in history_graph._cells([a], False)}
        assert own <= {c for _, c in history_graph._cells(["".join(b)], True)}


# -- same record -------------------------------------------------------------------------------


def test_same_records_match_brute(spark, small):
    rows = column(spark, small, "posted_records", "rec_id", "body")
    assert set(tuples(QUERIES["p4_found"](spark, small))) == brute.same_records(rows)
    counts = QUERIES["p4_records"](spark, small).collect()
    assert sum(r.copies for r in counts) == sum(bool(brute.key(b)) for _, b in rows)


def test_same_record_edges(spark):
    bodies = ["input=C(C); mw = 1.50", "MW:'1.50'|Smiles: c (c)", "mw=1.5;input=C(C)", None, " ", ";;", "|\n", "a;b=1", "b:1\na", "a;a;b=1", "remark=" + "x y" * 200_000, "REMARK: " + "X-Y" * 200_000, "t=1,5", "t=15", "t=1.5", "é=É", "É:é", "input=​C", "input=C"]
    rows = list(enumerate(bodies))
    df = spark.createDataFrame([(i, b, "r", 1) for i, b in rows], "rec_id long, body string, root string, copies int")
    want = brute.same_records(rows)
    assert {(0, 1), (5, 6), (7, 8), (10, 11), (12, 13), (15, 16)} == want
    assert set(tuples(same_record.copies(df))) == want == set(tuples(same_record.copies(df.union(df))))
    assert same_record.copies(df.limit(0)).count() == 0 == same_record.collapsed(df.limit(0)).count()


def test_nested_digest(spark):
    df = spark.sql("select map('a', array(1, 2), 'b', array(3)) m, named_struct('x', 1, 'y', 'q') s union all select map('b', array(3), 'a', array(2, 1)), named_struct('x', 1, 'y', null)")
    d = lambda c, ordered: [r[0] for r in df.select(same_record.digest(df[c], df.schema[c].dataType, ordered=ordered)).collect()]
    assert len(set(d("m", False))) == 1 and len(set(d("m", True))) == 2 == len(set(d("s", False)))


# -- tokenizer ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_match_library(spark, small, reference):
    texts = dict(column(spark, small, "documents", "doc_id", "text"))
    got = {r.doc_id: list(r.ids) for r in QUERIES["p6_ids"](spark, small).collect()}
    assert got == {i: reference(t) for i, t in texts.items()}


def test_ids_edges(spark, reference):
    rng = random.Random(4)
    signs = [chr(c) for c in (*range(1, 256), 0x85, 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0x1C, 0x1F, 0x660, 0x2160, 0x4E2D, 0x1F600, 0x301)]
    texts = [None, "", " ", "\x00", "<|endoftext|>", "a" * 60_000, " " * 5_000 + "x", "ab" * 20_000, *("".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(2000))]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = bpe.encode_corpus(df, VOCABULARY)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: reference(t) for i, t in enumerate(texts)}
    assert bpe.encode_corpus(df.limit(0), VOCABULARY).count() == 0


# -- leaks -------------------------------------------------------------------------------------


def test_leaks_match_brute(spark, small):
    docs, items = column(spark, small, "documents", "doc_id", "text"), column(spark, small, "eval_items", "item_id", "passage")
    want = brute.leaked(docs, items)
    assert set(tuples(QUERIES["p7_found"](spark, small))) == want
    clean = {r.doc_id for r in QUERIES["p7_clean"](spark, small).select("doc_id").collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_leak_edges(spark, monkeypatch):
    p = "one two three four five six seven eight nine ten eleven"
    items = [(1, p), (2, "zero " + p[:39]), (3, "a b c"), (4, None), (5, ""), (6, "one " * 12)]
    docs = [
        (1, p.upper()), (2, "one two three four <b>five</b> six&nbsp;seven [i]eight[/i] x"), (3, "one two three four five six seven"), (4, None), (5, ""),
        (6, "one " * 9), (7, ("z " * 50_000) + p), (8, "one two three four five six seven eight, zero one two three four five six seven eight"), (9, p + "\n" + p),
    ]
    df = spark.createDataFrame([(d, t, 1, "o") for d, t in docs], "doc_id long, text string, item_id int, owner string")
    ev = spark.createDataFrame(items, "item_id long, passage string")
    want = brute.leaked(docs, items)
    full = leaks.leaks(df, ev)
    assert {(r.doc_id, r.item_id) for r in full.collect()} == want
    best = {(r.doc_id, r.item_id): (r.words, r.word_at, r.passage_at) for r in full.collect()}
    assert best[7, 1] == (11, 50_000, 0) and best[2, 1] == (8, 0, 0) and best[9, 1] == (11, 0, 0) and best[8, 2] == (9, 8, 0)
    assert set(tuples(leaks.leaks(df.union(df), ev.union(ev)).select("doc_id", "item_id"))) == want
    assert set(tuples(leaks.leaks(df, ev, block_bytes=64).select("doc_id", "item_id"))) == want
    assert leaks.leaks(df.limit(0), ev).count() == 0 == leaks.leaks(df, ev.limit(0)).count()
    monkeypatch.setattr(leaks, "SHARD_WORDS", 4)
    assert set(tuples(leaks.leaks(df, ev).select("doc_id", "item_id"))) == want


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        order, _ = leaks.suffix_array(s, n + 1)
        assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(n))


# -- shared spans ------------------------------------------------------------------------------


def test_shared_match_brute(spark, small):
    want = brute.shared(column(spark, small, "documents", "doc_id", "text"))
    assert [r[0] for r in tuples(QUERIES["p8_found"](spark, small))] == sorted(want)


def noise(seed, n):
    return "".join(random.Random(seed).choices("abcdefghij klmno.\n😀é", k=n))


def test_shared_edges(spark, monkeypatch):
    s = noise(1, 200)
    docs = [
        (1, noise(2, 90) + s + noise(3, 130)), (2, noise(4, 20) + s), (3, noise(5, 50) + s[:199] + "#"), (4, "#" + s[1:] + noise(6, 40)), (5, noise(7, 199)), (6, noise(7, 199)),
        (7, noise(8, 200)), (8, noise(8, 200)), (9, None), (10, ""), (11, "a" * 900), (12, "x" + "a" * 199 + "y"), (13, noise(9, 3000) * 2), (14, noise(10, 700) + "b" * 150 + noise(11, 60)), (15, "b" * 150 + noise(11, 60)),
    ]
    want = brute.shared(docs)
    assert {1, 2, 7, 8, 14, 15} == want
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, span int, whole string")
    assert [r[0] for r in tuples(shared_spans.shared_documents(df))] == sorted(want)
    assert [r[0] for r in tuples(shared_spans.shared_documents(df.union(df)))] == sorted(want)
    assert shared_spans.shared_documents(df.limit(0)).count() == 0
    monkeypatch.setattr(shared_spans, "PART", 300)
    assert [r[0] for r in tuples(shared_spans.shared_documents(df))] == sorted(want)


def test_exact_thresholds(spark):
    """Shared stretches of every length around the threshold, at every place of the text."""
    docs = []
    for k in range(60):
        length, left = 190 + k % 20, k * 5
        s = noise(1000 + k, length)
        docs += [(2 * k, noise(2000 + k, left) + s + noise(3000 + k, 300 - left)), (2 * k + 1, noise(4000 + k, 37) + s + noise(5000 + k, 11))]
    got = shared_spans.shared_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r[0] for r in tuples(got)] == sorted(brute.shared(docs))


def test_sentence_cover(spark):
    part = " ".join(f"Sentence {i} has quite a number of words in it, so that runs are long enough." for i in range(3))
    docs = [(1, "First. " + part + " Own end."), (2, part), (3, part.replace("1", "x")), (4, None), (5, ""), (6, part + "\n" + part)]
    got = {r.doc_id: r for r in shared_spans.sentence_cover(spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, s string")).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[1].shared_chars == got[2].shared_chars > 200 and got[1].repeated_chars == 0 == got[3].shared_chars
    assert got[2].repeated_chars == got[2].n_chars and got[2].kept == "" and "Own end." in got[1].kept and got[5].n_chars == 0


def test_short_texts_are_one_run(spark):
    one, two = "word " * 50 + "end.", "word " * 30 + "stop. " + "more " * 30 + "end."
    docs = [(1, one), (2, one), (3, two), (4, two), (5, "長い文" * 80 + "。" + "次の文" * 30 + "。"), (6, "長い文" * 80 + "。" + "次の文" * 30 + "。"), (7, "short."), (8, "short.")]
    got = {r.doc_id: r for r in shared_spans.sentence_cover(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[d].shared_chars == got[d].n_chars > 200 for d in range(1, 7)) and got[7].shared_chars == 0 == got[8].shared_chars
    assert [got[d].repeated_chars > 0 for d in range(1, 7)] == [False, True] * 3


def test_amounts_match_brute(spark, small):
    docs = column(spark, small, "documents", "doc_id", "text")
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in QUERIES["p8_amounts"](spark, small).collect()}
    want = brute.shared_chars(docs)
    assert got == {d: (None if t is None else len(t), want[d]) for d, t in docs} and sum(map(bool, want.values())) > 10


def test_amount_edges(spark, monkeypatch):
    """Stretches of many lengths at all places, inside one another, repeated within a text, copied whole."""
    rng = random.Random(3)
    base = [noise(100 + i, 700) for i in range(4)] + ["ab" * 350, "q" * 450]
    docs = [(1, None), (2, ""), (3, noise(7, 200)), (4, noise(7, 200)), (5, noise(7, 200) + "#"), (6, "a" * 900), (7, "x" + "a" * 230), (8, noise(9, 300) * 3)]
    for i in range(120):
        b = rng.choice(base)
        lo = rng.choice([0, rng.randrange(400)])
        docs.append((10 + i, noise(500 + i, rng.choice([0, 3, 80, 300])) + b[lo : lo + rng.randint(150, 500)] + noise(900 + i, rng.choice([0, 5, 120]))))
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, at int, whole string")
    want = {d: (None if t is None else len(t), n) for (d, t), n in zip(docs, brute.shared_chars(docs).values())}
    amounts = lambda df: {r.doc_id: (r.n_chars, r.shared_chars) for r in shared_spans.shared_amounts(df).collect()}
    assert amounts(df) == want and amounts(df.union(df)) == want
    assert shared_spans.shared_amounts(df.limit(0)).count() == 0
    monkeypatch.setattr(shared_spans, "PART", 300)
    assert amounts(df) == want
