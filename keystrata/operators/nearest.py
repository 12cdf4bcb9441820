"""Nearest stored vector of each query vector: exact, and through an inverted index of cells.

Queries are a stated set. They go to the executors in blocks of bounded size; each task scores
its rows against a block in matrix products of bounded size and keeps the best per query, and
the tasks' bests are combined by an aggregation. Ties go to the lower id.

The inverted index can be kept in a folder, a partition for each cell: a search then reads the
cells it probes only, and rows are inserted without reading the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.keys import unseen

#: Query vectors sent to the executors at once.
QUERY_BLOCK = 1 << 14
#: Scores a task holds at once.
SCORES = 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(vectors: list) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _slices(batches: Iterator[pd.DataFrame], queries: int) -> Iterator[pd.DataFrame]:
    """Rows in order of id, as many at a time as may be scored against so many queries at once."""
    step = max(1, SCORES // max(1, queries))
    for batch in batches:
        batch = batch.sort_values("id")
        for a in range(0, len(batch), step):
            yield batch.iloc[a : a + step]


def _query_blocks(queries: DataFrame, size: int) -> Iterator[list]:
    n = max(1, -(-queries.count() // size))
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).collect() if n > 1 else queries.collect()
        if rows:
            yield rows


def _best(rows: DataFrame, scorer) -> DataFrame:
    scored = rows.mapInPandas(scorer, "query_id long, id long, similarity double")
    best = F.max(F.struct("similarity", (-F.col("id")).alias("minus"))).alias("b")
    return scored.groupBy("query_id").agg(best).select("query_id", (-F.col("b.minus")).alias("id"), F.col("b.similarity").alias("similarity"))


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_top1(rows: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, similarity): nearest row of every query by cosine, itself excepted.

    rows and queries: (id, vector); null vectors take no part.
    """
    rows, queries = (d.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("vector").isNotNull()) for d in (rows, queries))
    parts = []
    for q in _query_blocks(queries, block):
        sent = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in q]), _unit(_matrix([r[1] for r in q]))))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, vectors = sent.value
            top, who = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
            for part in _slices(batches, len(ids)):
                own = part["id"].to_numpy(np.int64)
                s = _unit(_matrix(part["vector"].tolist())) @ vectors.T
                s[own[:, None] == ids[None, :]] = -np.inf
                at = s.argmax(axis=0)
                best = s[at, np.arange(len(ids))]
                better = (best > top) | ((best == top) & (own[at] < who))
                top[better], who[better] = best[better], own[at][better]
            hit = top > -np.inf
            yield pd.DataFrame({"query_id": ids[hit], "id": who[hit], "similarity": top[hit]})

        parts.append(_best(rows, score))
    return _union(parts, rows)


class CellIndex:
    """Inverted index: each vector in the cell of its nearest centre, a query searches the nearest cells.

    Centres are fitted by k-means on at most `sample` rows (lowest hashes of the id, a documented
    bound); every row is indexed. The number of cells searched is the least that finds the nearest
    row of at least `recall` of the sample's rows within the sample.
    """

    def __init__(self, rows: DataFrame, cells: int = 16, recall: float = 0.96, sample: int = 4096, rounds: int = 8):
        self.rows, self.path = self._given(rows), None
        fit = _unit(_matrix([r[0] for r in self.rows.orderBy(F.xxhash64("id")).limit(sample).select("vector").collect()]))
        centres = fit[: min(cells, len(fit))].copy()
        for _ in range(rounds):
            near = (fit @ centres.T).argmax(axis=1) if len(fit) else np.zeros(0, int)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = fit[near == c].mean(axis=0)
            centres = _unit(centres)
        self.centres, self.probes = centres, self._tuned(fit, centres, recall)

    @staticmethod
    def _given(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("vector").isNotNull())

    def save(self, path: str) -> CellIndex:
        """Keeps the index below `path`; the centres come last, so an index that can be opened is whole."""
        spark = self.rows.sparkSession
        self.assigned(self.rows).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        kept = [(i, [float(x) for x in c], self.probes) for i, c in enumerate(self.centres)]
        spark.createDataFrame(kept, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return CellIndex.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        index = cls.__new__(cls)
        kept = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        index.path, index.rows = path, spark.read.parquet(f"{path}/rows").select("id", "vector")
        index.centres, index.probes = _matrix([r.centre for r in kept]), kept[0].probes if kept else 1
        return index

    def insert(self, rows: DataFrame) -> None:
        """Adds the rows whose id the saved index lacks."""
        fresh = unseen(self._given(rows), self.rows, "id")
        self.assigned(fresh).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        self.rows = self.rows.sparkSession.read.parquet(f"{self.path}/rows").select("id", "vector")

    @staticmethod
    def _tuned(fit: np.ndarray, centres: np.ndarray, recall: float) -> int:
        if len(fit) < 2:
            return max(1, len(centres))
        home = (fit @ centres.T).argmax(axis=1)
        asked = fit[:1024]
        s = asked @ fit.T
        s[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        cell = home[s.argmax(axis=1)]
        place = (np.argsort(-(asked @ centres.T), axis=1) == cell[:, None]).argmax(axis=1)
        return int(np.searchsorted(np.cumsum(np.bincount(place, minlength=len(centres))), recall * len(asked)) + 1)

    def assigned(self, rows: DataFrame) -> DataFrame:
        """(cell, id, vector) of every row."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not batch.empty:
                    yield batch.assign(cell=(_unit(_matrix(batch["vector"].tolist())) @ sent.value.T).argmax(axis=1))[["cell", "id", "vector"]]

        return rows.mapInPandas(run, f"cell int, id long, vector {rows.schema['vector'].dataType.simpleString()}")

    def _cells(self, wanted: list[int]) -> DataFrame:
        """(cell, id, vector) of these cells; a saved index reads no others."""
        if self.path is None:
            return self.assigned(self.rows).where(F.col("cell").isin(wanted))
        return self.rows.sparkSession.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(wanted)).select("cell", "id", "vector")

    def top1(self, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, id, similarity): nearest row of every query among the cells it searches."""
        queries = queries.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("vector").isNotNull())
        parts = []
        for q in _query_blocks(queries, block):
            vectors = _unit(_matrix([r[1] for r in q]))
            probed = np.argsort(-(vectors @ self.centres.T), axis=1)[:, : self.probes]
            sent = self.rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in q]), vectors, probed))

            def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                ids, vectors, probed = sent.value
                for part in _slices(batches, len(ids)):
                    for cell, part in part.groupby("cell"):
                        mine = np.flatnonzero((probed == cell).any(axis=1))
                        if not len(mine):
                            continue
                        own = part["id"].to_numpy(np.int64)
                        s = _unit(_matrix(part["vector"].tolist())) @ vectors[mine].T
                        s[own[:, None] == ids[mine][None, :]] = -np.inf
                        at = s.argmax(axis=0)
                        best = s[at, np.arange(len(mine))]
                        hit = best > -np.inf
                        yield pd.DataFrame({"query_id": ids[mine][hit], "id": own[at][hit], "similarity": best[hit]})

            parts.append(_best(self._cells(np.unique(probed).tolist()), score))
        return _union(parts, self.rows)
