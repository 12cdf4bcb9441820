"""Long exact spans shared between records.

`sentence_cover` hashes every run of several consecutive sentences, joins the hashes over the
whole corpus and marks the sentences under any run that is not the first of its kind.

Runs of sentences can't settle a question about characters: a shared stretch of 200 of them
may begin and end inside sentences, or lie within one. `shared_documents` therefore slides the
same kind of span over borders that the characters themselves set: of every `window`
consecutive `gram`-character pieces the one of smallest hash begins a span, so any shared
stretch of gram + window - 1 = `least` characters holds a span that begins at the same
character in both texts. Spans are hashed, joined over the corpus, and settled by the digests
of whole windows of `least` characters:
 1. exact copies of a text are settled by its digest, and only the first of them is looked at further;
 2. the window in the middle of which a span lies settles most of what is really shared;
 3. only for spans that recur in texts not yet settled, all windows over the span are compared.

`shared_amounts` returns how many characters of each document lie in shared windows. A shared
window holds a recurring span, and all windows over one span overlap, so the shared middles are
covered at once; around a recurring span only the side that they leave open is compared window
by window, in all texts that hold the span. Exact copies count in full.

Shuffled are one hash and one digest for about 50 characters of text. Hashes are grouped with
partial aggregation and never paired, so a span in a third of all texts costs its rows once.
What recurs goes back to the rows by a broadcast where it measures below a bound, else by a
shuffle join with each value once on that side, of which AQE may split hot ones.

Defined cases: null, empty and short texts share nothing; repeated rows of one doc_id are the
same document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.text import trim_unicode
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable

LEAST = 200
#: Characters hashed at once; longer texts are taken in parts that overlap by a window.
PART = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of `k` code points, by differences of a prefix sum."""
    n = len(codes)
    up, down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes + np.uint64(1)) * up[:n], dtype=np.uint64)])
    return _mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding(x: np.ndarray, w: int, fold: np.ufunc) -> np.ndarray:
    """Minimum (or maximum) of every `w` neighbours, in linear time."""
    pad = -len(x) % w
    edge = np.full(pad, fold.identity if fold.identity is not None else (np.iinfo(x.dtype).max if fold is np.minimum else 0), x.dtype)
    rows = np.concatenate([x, edge]).reshape(-1, w)
    ahead = fold.accumulate(rows, axis=1).ravel()
    back = fold.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def spans(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the spans of one text: those smallest in some window."""
    h = gram_hashes(codes, gram)
    low = sliding(h, window, np.minimum)
    side = np.zeros(window - 1, np.uint64)
    chosen = sliding(np.concatenate([side, low, side]), window, np.maximum) == h
    at = np.flatnonzero(chosen)
    return at, h[at]


def _parts(text: str, least: int) -> Iterator[tuple[int, np.ndarray]]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for a in range(0, max(1, len(codes) - least + 1), PART):
        part = codes[a : a + PART + least - 1]
        if len(part) >= least:
            yield a, part


def _digest(text: str, a: int, least: int) -> bytes:
    return blake2b(text[a : a + least].encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _span_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, span, middle): each text's different spans, each with the digest of the window around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, middles = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, known = len(text), set()
                for a, codes in _parts(text, least):
                    for p, h in zip(*(x.tolist() for x in spans(codes, gram, least - gram + 1))):
                        start = min(max(0, a + p - (least - gram) // 2), n - least)
                        row = (h, _digest(text, start, least))
                        if row not in known:
                            known.add(row)
                ids += [doc] * len(known)
                hashes += [h for h, _ in known]
                middles += [m for _, m in known]
                if len(ids) >= 1 << 15:
                    yield out(ids, hashes, middles)
                    ids, hashes, middles = [], [], []
            if ids:
                yield out(ids, hashes, middles)

    def out(ids: list, hashes: list, middles: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(middles, pa.binary())], names=["doc_id", "span", "middle"])

    return docs.mapInArrow(run, "doc_id long, span long, middle binary")


def _window_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, window): digests of all windows over the listed spans (column `wanted`) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, wanted = len(text), np.array(wanted, np.int64).view(np.uint64)
                for a, codes in _parts(text, least):
                    at, h = spans(codes, gram, least - gram + 1)
                    starts = {s for p in at[np.isin(h, wanted)].tolist() for s in range(max(0, a + p - least + gram), min(a + p, n - least) + 1)}
                    if starts:
                        digests = sorted({_digest(text, s, least) for s in starts})
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(digests), pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "window"])

    return docs.mapInArrow(run, "doc_id long, window binary")


def _in_several(rows: DataFrame, key: str) -> DataFrame:
    """Values of `key` that stand in more than one document."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where(F.col("a") != F.col("b")).select(key)


def _copies(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, first_id) of texts that several documents hold whole, and (doc_id, text) of each different text's first document."""
    texts = documents.select("doc_id", "text").where((F.char_length("text") >= least) & F.col("doc_id").isNotNull()).withColumn("whole", F.unhex(F.sha2("text", 256)))
    classes = durable(texts.groupBy("whole").agg(F.min("doc_id").alias("first_id"), (F.min("doc_id") != F.max("doc_id")).alias("copied")))
    copied = classes.where("copied").select("whole", "first_id")
    members = durable(sized_join(texts.select("doc_id", "whole"), copied, "whole").select("doc_id", "first_id").distinct())
    return members, sized_join(texts.select("doc_id", "text"), members.where("doc_id != first_id").select("doc_id"), "doc_id", "left_anti")


def shared_documents(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id): documents of which `least` consecutive characters also stand in another document."""
    gram = least // 2
    members, own = _copies(documents, least)
    rows = durable(_span_rows(own, least, gram))
    middles = durable(_in_several(rows, "middle"))
    settled = durable(sized_join(rows, middles, "middle", "left_semi").select("doc_id").distinct())
    marked = sized_join(rows.select("doc_id", "span"), settled.withColumn("done", F.lit(1)), "doc_id", "left")
    recurring = durable(marked.groupBy("span").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count_if(F.col("done").isNull()).alias("open")).where((F.col("a") != F.col("b")) & (F.col("open") > 0)).select("span"))
    wanted = durable(sized_join(rows.select("doc_id", "span"), recurring, "span").groupBy("doc_id").agg(F.collect_set("span").alias("wanted")))
    windows = durable(_window_rows(sized_join(own, wanted, "doc_id").select("doc_id", "text", "wanted"), least, gram))
    late = windows.join(_in_several(windows, "window"), "window", "left_semi").select("doc_id")
    return settled.union(late).union(members.select("doc_id")).distinct()


def _open_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, covered, spans, sides): the stretches of a text under shared middles, and its recurring spans with the sides (1 before, 2 after, 3 both) on which a window over them leaves these.

    docs: doc_id, text, whole (the text is known to be shared in full), its recurring `spans` and shared `middles`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, whole, wanted, middles in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if whole:
                    continue
                n, wanted, middles = len(text), np.array(wanted, np.int64).view(np.uint64), set(middles)
                found, steps = [], np.zeros(n + 1, np.int64)
                for a, codes in _parts(text, least):
                    at, h = spans(codes, gram, least - gram + 1)
                    kept = np.isin(h, wanted)
                    found += zip((at[kept] + a).tolist(), h[kept].view(np.int64).tolist())
                for p, _ in found:
                    start = min(max(0, p - (least - gram) // 2), n - least)
                    if _digest(text, start, least) in middles:
                        steps[start] += 1
                        steps[start + least] -= 1
                inside = np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8)
                bare = np.concatenate([[0], np.cumsum(inside[1:-1] == 0)])
                leaves = np.concatenate([[0], np.cumsum(bare[least:] > bare[:-least])])
                sides: dict[int, int] = {}
                for p, h in found:
                    first, middle, last = max(0, p - least + gram), p - (least - gram) // 2, min(p, n - least)
                    before = leaves[max(first, min(middle, last) + 1)] > leaves[first]
                    after = leaves[last + 1] > leaves[min(last + 1, max(middle, first))]
                    if before or after:
                        sides[h] = sides.get(h, 0) | before | after << 1
                ends = np.diff(inside)
                covered = [{"lo": lo, "hi": hi} for lo, hi in zip(np.flatnonzero(ends == 1).tolist(), np.flatnonzero(ends == -1).tolist())]
                columns = [pa.array([doc], pa.int64()), pa.array([covered], stretches), pa.array([list(sides)], pa.list_(pa.int64())), pa.array([[int(x) for x in sides.values()]], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "covered", "spans", "sides"])

    stretches = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return docs.mapInArrow(run, "doc_id long, covered array<struct<lo: int, hi: int>>, spans array<long>, sides array<int>")


def _side_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, window, at): digests and places of the windows on the listed sides of the listed spans (columns `spans`, `sides`) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, listed, sides in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n, side, places = len(text), dict(zip(listed, sides)), set()
                for a, codes in _parts(text, least):
                    for p, h in zip(*(x.tolist() for x in (lambda at, h: (at, h.view(np.int64)))(*spans(codes, gram, least - gram + 1)))):
                        if s := side.get(h):
                            middle = a + p - (least - gram) // 2
                            low = a + p - least + gram if s & 1 else middle
                            high = a + p if s & 2 else middle
                            places.update(range(max(0, low), min(high, n - least) + 1))
                windows: dict[bytes, list[int]] = {}
                for p in sorted(places):
                    windows.setdefault(_digest(text, p, least), []).append(p)
                if windows:
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(windows), pa.int64()), pa.array(list(windows), pa.binary()), pa.array(list(windows.values()), pa.list_(pa.int32()))], names=["doc_id", "window", "at"])

    return docs.mapInArrow(run, "doc_id long, window binary, at array<int>")


def shared_amounts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars): how many characters of each document lie in a stretch of `least` or more that also stands in another document.

    Null texts have null characters, none of them shared.
    """
    gram = least // 2
    members, own = _copies(documents, least)
    rows = durable(_span_rows(own, least, gram))
    spans_of = sized_join(rows.select("doc_id", "span"), durable(_in_several(rows, "span")), "span").groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    middles_of = sized_join(rows.select("doc_id", "middle"), durable(_in_several(rows, "middle")), "middle").groupBy("doc_id").agg(F.collect_set("middle").alias("middles"))
    whole = members.select("doc_id", F.lit(True).alias("whole"))
    known = durable(spans_of.join(middles_of, "doc_id", "left").join(whole, "doc_id", "left"))
    marked = sized_join(own, known, "doc_id").select("doc_id", "text", F.coalesce("whole", F.lit(False)), "spans", F.coalesce("middles", F.array().cast("array<binary>")))
    held = durable(_open_rows(marked, least, gram))
    sides = durable(held.select(F.explode(F.arrays_zip("spans", "sides")).alias("s")).groupBy(F.col("s.spans").alias("span")).agg(F.bit_or("s.sides").alias("side")))
    wanted = durable(sized_join(rows.select("doc_id", "span").distinct(), sides, "span").groupBy("doc_id").agg(F.collect_list(F.struct("span", "side")).alias("w")))
    windows = durable(_side_rows(sized_join(own, wanted, "doc_id").select("doc_id", "text", "w.span", "w.side"), least, gram))
    late = sized_join(windows, durable(_in_several(windows, "window")), "window", "left_semi").select("doc_id", F.transform("at", lambda p: F.struct(p.alias("lo"), (p + least).cast("int").alias("hi"))).alias("covered"))
    stretches = held.select("doc_id", "covered").unionByName(late).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("covered"))).alias("covered"))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    wider = lambda t, x: F.struct(F.greatest(t["end"], x["hi"]).alias("end"), (t["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(t["end"], x["lo"]))).alias("n"))
    amounts = stretches.select("doc_id", F.aggregate("covered", nothing, wider, lambda t: t["n"]).alias("part"))
    sizes = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n_chars"))
    shared = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
    return sizes.join(amounts, "doc_id", "left").join(whole, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"))


#: A sentence ends after closing punctuation before white space, or at a line feed.
_SENTENCE = r"(?U)(?<=[.!?…。！？])\s++|\n++"


def sentence_cover(documents: DataFrame, run: int = 3, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars, repeated_chars, kept): how much of each text lies under shared runs of sentences.

    shared_chars counts the characters of sentences in runs of `run` sentences and at least
    `least` characters that other documents hold too (a text of fewer sentences is one run;
    `shared_amounts` counts by characters), repeated_chars those under a run that is not
    the first of its kind (the first stands in the lowest doc_id), kept the text without them.
    """
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    sentences = docs.select("doc_id", F.filter(F.transform(F.split("text", _SENTENCE), trim_unicode), lambda s: s != "").alias("s"))
    length = F.least(F.size("s"), F.lit(run))
    at = F.sequence(F.lit(1), F.size("s") - length + 1)
    pieces = F.when(F.size("s") > 0, F.filter(F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("s", i, length), "\n").alias("t"))), lambda x: F.char_length(x["t"]) >= least))
    hashed = durable(sentences.select("doc_id", F.explode(F.transform(pieces, lambda x: F.struct(x["at"].alias("at"), F.unhex(F.md5(x["t"])).alias("h")))).alias("r")).select("doc_id", "r.at", "r.h"))
    several = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("b")).where(F.col("first_id") != F.col("b")).select("h", "first_id")
    hits = hashed.join(several, "h").select("doc_id", "at", (F.col("first_id") != F.col("doc_id")).alias("again"))
    per_doc = hits.groupBy("doc_id").agg(F.collect_set("at").alias("shared"), F.collect_set(F.when(F.col("again"), F.col("at"))).alias("again"))
    covers = lambda marks, i: F.exists(marks, lambda a: (a <= i + 1) & (i + 1 < a + run))
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda n, s: n + F.char_length(s))
    none = F.array().cast("array<int>")
    d = sentences.join(per_doc, "doc_id", "left").withColumns({"shared": F.coalesce("shared", none), "again": F.coalesce("again", none)})
    return d.select(
        "doc_id",
        total("s").alias("n_chars"),
        total(F.filter("s", lambda x, i: covers(F.col("shared"), i))).alias("shared_chars"),
        total(F.filter("s", lambda x, i: covers(F.col("again"), i))).alias("repeated_chars"),
        F.array_join(F.filter("s", lambda x, i: ~covers(F.col("again"), i)), "\n").alias("kept"),
    )
