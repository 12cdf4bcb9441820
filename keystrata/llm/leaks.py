"""Evaluation passages in training text, by suffix arrays over shards of the corpus.

Each task turns its documents into word numbers, gathers them into shards, builds a suffix
array of every shard by prefix doubling and binary-searches every suffix of every evaluation
passage in it. That gives the longest run of words each suffix has anywhere in the shard, and
the range of places that share at least `least` words with it. Words that no passage holds are
left out beforehand: each breaks a run, so only runs of passage words of at least `least` words enter a shard.

The corpus is read once and not shuffled; documents of any length stay whole. The passages
are the small side: their size is measured, and beyond `block_bytes` they are searched in
several passes over blocks of items.

Defined cases: null and empty texts and passages match nothing; a passage of fewer than `least`
words cannot leak; repeated rows give one result row; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markup and entities that count as a space.
MARKUP = r"</?[A-Za-z][^<>\n]*>|\[/?[A-Za-z*][^\[\]\n]*\]|&#?[0-9A-Za-z]{1,10};"
LEAST = 8
#: Words of a shard; one document may exceed it.
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 8 << 20


@functools.cache
def _patterns():
    import regex

    return regex.compile(MARKUP), regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters or digits, markup taken as a space."""
    markup, run = _patterns()
    return [w.lower() for w in run.findall(markup.sub(" ", text))] if text else []


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of `s`, compared over at least `depth` symbols."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    span, order = 1, None
    while True:
        after = np.zeros(len(s), np.int64)
        after[: max(0, len(s) - span)] = rank[span:] + 1
        both = rank * (len(s) + 1) + after
        order = np.argsort(both, kind="stable")
        new = np.empty(len(s), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)]) if len(s) else 0
        rank, span = new, span * 2
        if span >= depth or (len(s) and rank[order[-1]] == len(s) - 1):
            return order, rank


class Shard:
    """Suffix array of the word numbers of some documents; 0 ends a run."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, depth: int):
        self.s, self.owner = symbols, owner
        self.padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)])
        self.order, _ = suffix_array(symbols, depth)

    def _below(self, text: np.ndarray, starts: np.ndarray, length: int, equal: bool) -> np.ndarray:
        """For the `length` symbols from each start in `text` the number of suffixes smaller than these (or, with `equal`, not larger)."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        cols = np.arange(length)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            diff = self.padded[self.order[mid][:, None] + cols] - text[starts[open_][:, None] + cols]
            first = np.argmax(diff != 0, axis=1)
            sign = diff[np.arange(len(open_)), first]
            smaller = (sign < 0) | (equal & (sign == 0))
            lo[open_[smaller]] = mid[smaller] + 1
            hi[open_[~smaller]] = mid[~smaller]

    def matches(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, run): every place that shares at least `least` symbols with the stretch of `text` from a start to its end, and how many it shares."""
        if not len(self.order) or not len(starts):
            return (np.zeros(0, np.int64),) * 3
        lo, hi = self._below(text, starts, least, False), self._below(text, starts, least, True)
        n = hi - lo
        q = np.repeat(np.arange(len(starts)), n)
        place = self.order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        run, same = np.full(len(q), least), np.arange(len(q))
        while len(same):  # one symbol further for all that still agree
            at = starts[q[same]] + run[same]
            same, at = same[at < ends[q[same]]], at[at < ends[q[same]]]
            same = same[self.padded[np.minimum(place[same] + run[same], len(self.padded) - 1)] == text[at]]
            run[same] += 1
        return q, place, run


class Passages:
    """Word numbers of the evaluation passages, one after the other, and where their suffixes of at least `least` words begin and end."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST):
        self.least = least
        lists = [(i, words(p)) for i, p in items]
        lists = [(i, w) for i, w in lists if len(w) >= least]
        self.number = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in lists for x in ws}))}
        self.text = np.array([self.number[x] for _, ws in lists for x in ws], np.int32)
        lengths = np.array([len(w) for _, w in lists], np.int64)
        begins = np.cumsum(lengths) - lengths
        counts = lengths - least + 1
        self.at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.item = np.repeat(np.array([i for i, _ in lists], np.int64), counts)
        self.starts, self.ends = np.repeat(begins, counts) + self.at, np.repeat(begins + lengths, counts)

    def runs(self, text: str | None) -> tuple[list[int], list[int]]:
        """Word numbers and word positions of the runs of passage words in a text, 0 after each run."""
        symbols, places, run = [], [], []
        get = self.number.get
        ws = words(text)
        for k, w in enumerate([*ws, None]):
            x = get(w, 0)
            if x:
                run.append(x)
                continue
            if len(run) >= self.least:
                symbols += [*run, 0]
                places += range(k - len(run), k + 1)
            run = []
        return symbols, places

    def search(self, symbols: list[int], owner: list[int], places: list[int]) -> pd.DataFrame:
        """(owner, item_id, words, word_at, passage_at): the longest run of each item in each owner."""
        shard = Shard(np.array(symbols, np.int32), np.array(owner, np.int64), self.least)
        q, place, run = shard.matches(self.text, self.starts, self.ends, self.least)
        found = pd.DataFrame({"owner": shard.owner[place], "item_id": self.item[q], "words": run, "word_at": np.array(places, np.int64)[place], "passage_at": self.at[q]})
        return found.sort_values(["owner", "item_id", "words", "word_at", "passage_at"], ascending=[True, True, False, True, True]).drop_duplicates(["owner", "item_id"])


def _search(documents: DataFrame, items: list[tuple[int, str | None]], least: int) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        passages = Passages(sent.value, least)
        symbols, owner, places, ids = [], [], [], []

        def flush() -> pa.RecordBatch:
            found = passages.search(symbols, owner, places)
            out = pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[k] for k in found["owner"]], pa.int64()), **{c: pa.array(found[c].to_numpy(np.int64)) for c in ("item_id", "words", "word_at", "passage_at")}})
            for x in (symbols, owner, places, ids):
                x.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, p = passages.runs(text)
                if s:
                    owner += [len(ids)] * len(s)
                    ids.append(doc)
                    symbols += s
                    places += p
                if len(symbols) >= SHARD_WORDS:
                    yield flush()
        if symbols:
            yield flush()

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, "doc_id long, item_id long, words long, word_at long, passage_at long")


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, words, word_at, passage_at): documents with a passage's longest common run of at least `least` words."""
    items = eval_items.select("item_id", "passage").where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("passage") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        part = _search(documents, block, least)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("words", (-F.col("word_at")).alias("w"), (-F.col("passage_at")).alias("p"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", (-F.col("best.w")).alias("word_at"), (-F.col("best.p")).alias("passage_at"))


def cleaned(documents: DataFrame, eval_items: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without those that hold part of an evaluation passage."""
    return documents.join(leaks(documents, eval_items, least).select("doc_id").distinct(), "doc_id", "left_anti")
