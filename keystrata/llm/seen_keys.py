"""Has this key been seen before? Scalable Bloom chains over a keyed stream.

Keys are routed by hash to shards; every shard holds one chain of Bloom layers. A layer takes
keys until it is half full; then one of `growth` times its capacity and `tighten` times its
error rate follows. A chain answers wrongly only if one of its layers does, so the compounded
rate of wrong answers stays below the sum of the layers' rates, at most `error`, however long
the history grows (`Chain.bound`).

Every answer is a chain's, given in order of `ord` and read from its bits alone: a row is new if
it is the first to set one of them, else it was seen. Rows go by blocks of `ord` to slices, each
with a chain of its own, which is asked every row. What a slice has seen is settled; the others,
one row or so of a key in a slice, are asked of their shard's chain. So a key that holds a third
of all rows is spread over all slices and reaches its shard about once from each. Either kind of
chain has half of `error`.

Memory: a chain keeps about 1.44 log2(1/rate) bits a key and no key. The number of shards and of
slices follows the rows (`per_shard`); a slice is a stream, a task of a shard holds its chain and
the rows it is asked. `KeyHistory` keeps the shards' chains in a folder of the shared file system,
for deliveries of several jobs; its number of shards is set when it is made.

Defined cases: null and blank keys are never seen and never kept, rows without `ord` take no
part; repeated rows are one row; an empty table gives no rows; extra columns are ignored. A
negative `ord` is legal (history comes before every row).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.text import blank_to_null
from keystrata.plans.session import durable
from keystrata.sources.layout import Files

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a key's turn among those put at once.
_TURN = np.uint64(20)


def _second(h: np.ndarray) -> np.ndarray:
    """A second hash of each key from its first, made odd as the step of double hashing."""
    x = (h ^ (h >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


class Layer:
    """One Bloom filter of a chain."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error, self.kept, self.ones = capacity, error, 0, 0
        self.hashes = max(1, math.ceil(-math.log2(error)))
        self.size = np.uint64(math.ceil(capacity * self.hashes / math.log(2)))
        self.bits = np.zeros(int(self.size) // 8 + 1, np.uint8)

    def _at(self, h: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        steps = np.arange(first, self.hashes if last is None else min(last, self.hashes), dtype=np.uint64)
        return (h[:, None] + steps * _second(h)[:, None] + steps * steps * steps) % self.size

    def has(self, h: np.ndarray) -> np.ndarray:
        """The first hashes turn nearly all new keys down, the others are asked for the rest."""
        left = np.arange(len(h))
        for first, last in ((0, 4), (4, self.hashes)):
            at = self._at(h[left], first, last)
            left = left[((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)]
        seen = np.zeros(len(h), bool)
        seen[left] = True
        return seen

    def put(self, h: np.ndarray) -> np.ndarray:
        """Keeps the keys one after another; marks those new at their turn, that is the first to set one of their bits."""
        turns = np.sort(((self._at(h) << _TURN) | np.arange(len(h), dtype=np.uint64)[:, None]).ravel())
        at = turns >> _TURN
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at, row = at[first], (turns[first] & ((np.uint64(1) << _TURN) - np.uint64(1))).astype(np.int64)
        byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        unset = (self.bits[byte] & bit) == 0
        np.bitwise_or.at(self.bits, byte[unset], bit[unset])
        new = np.zeros(len(h), bool)
        new[row[unset]] = True
        self.ones += int(unset.sum())
        self.kept += int(new.sum())
        return new

    @property
    def full(self) -> bool:
        return self.kept >= self.capacity or self.ones * 2 >= int(self.size)

    @property
    def room(self) -> int:
        """Keys that can be put before the layer may be full."""
        return max(1, min(self.capacity - self.kept, (int(self.size) // 2 - self.ones) // self.hashes))


@dataclass
class Chain:
    """Layers of growing capacity and falling error rate."""

    error: float
    first: int = 1024
    growth: int = 2
    tighten: float = 0.5
    layers: list[Layer] = field(default_factory=list)

    def _open(self) -> Layer:
        if not self.layers or self.layers[-1].full:
            i = len(self.layers)
            self.layers.append(Layer(self.first * self.growth**i, self.error * (1 - self.tighten) * self.tighten**i))
        return self.layers[-1]

    @property
    def bound(self) -> float:
        """Largest rate of wrong answers of the chain as it stands."""
        return sum(x.error for x in self.layers)

    def packed(self) -> bytes:
        """The chain as plain values, to be opened by any later job."""
        return pickle.dumps((self.error, self.first, self.growth, self.tighten, [(x.capacity, x.error, x.kept, x.ones, x.bits) for x in self.layers]), protocol=5)

    @classmethod
    def opened(cls, data: bytes) -> Chain:
        *settings, layers = pickle.loads(data)
        chain = cls(*settings)
        for capacity, error, kept, ones, bits in layers:
            layer = Layer(capacity, error)
            layer.kept, layer.ones, layer.bits = kept, ones, bits
            chain.layers.append(layer)
        return chain

    def has(self, h: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(h), bool)
        for layer in reversed(self.layers):  # the last layers hold most keys
            left = np.flatnonzero(~seen)
            if len(left):
                seen[left] = layer.has(h[left])
        return seen

    def ask(self, h: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """For each key of `h`, in order: seen before? The unseen ones are kept. Up to `step` keys are worked on at once; the answers are those of asking one by one."""
        seen, at, step = np.ones(len(h), bool), 0, min(step, 1 << int(_TURN))
        while at < len(h):
            layer = self._open()
            part = h[at : at + min(step, max(1024, 4 * layer.room))]
            left = np.flatnonzero(~self.has(part))
            if len(left) > layer.room:  # the rest is asked when the layer's state is known
                part, left = part[: left[layer.room]], left[: layer.room]
            if len(left):
                seen[at + left] = ~layer.put(part[left])
            at += len(part)
        return seen


def _keyed(rows: DataFrame, key: str, ord: str) -> DataFrame:
    """(ord, h) of the rows with both."""
    k = blank_to_null(F.col(key))
    return rows.select(F.col(ord).cast("long").alias("ord"), F.xxhash64(k).alias("h"), k.alias("k")).where(F.col("k").isNotNull() & F.col("ord").isNotNull()).drop("k")


_CHAINS = "shard int, chain binary, bound double"


class SeenKeys:
    """Decides for the rows of a keyed stream whether their key came before.

    per_shard: rows of a shard and of a slice; block: ordinals that go to one slice together; first:
    capacity of a chain's first layer; rest: rows that a chain is asked at once.
    """

    def __init__(self, error: float = 1e-9, per_shard: int = 1 << 16, block: int = 1 << 16, first: int = 4096, rest: int = 1 << 16):
        self.error, self.per_shard, self.block, self.first, self.rest = error, per_shard, block, first, rest

    def asked(self, rows: DataFrame, history: DataFrame | None = None, key: str = "input", ord: str = "ord", chains: DataFrame | None = None, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The answers (ord) and the chains after them (shard, chain, bound), going on from `chains`.

        Two shuffles of hashes and ordinals: all rows by block of `ord`, and those that their slice hasn't seen by shard.
        """
        error, first, step = self.error / 2, self.first, self.rest
        shards = shards or max(1, -(-(rows.count() + (0 if history is None else history.count())) // self.per_shard))

        def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, last = Chain(error, first), None
            for batch in batches:
                ords, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(h):
                    continue
                other = np.concatenate([[last != (ords[0], h[0])], (ords[1:] != ords[:-1]) | (h[1:] != h[:-1])])  # repeated rows are one row
                ords, h, last = ords[other], h[other], (ords[-1], h[-1])
                yield pa.RecordBatch.from_arrays([pa.array(ords), pa.array(h), pa.array(own.ask(h.view(np.uint64), step)), pa.nulls(len(h), pa.float64())], names=["ord", "h", "seen", "bound"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([own.bound], pa.float64())], names=["ord", "h", "seen", "bound"])

        slices = _keyed(rows, key, ord).select("ord", "h").repartition(shards, F.floor(F.col("ord") / self.block)).sortWithinPartitions("ord", "h")
        sliced = durable(slices.mapInArrow(slice_, "ord long, h long, seen boolean, bound double"))
        bound = sliced.agg(F.max("bound")).first()[0] or 0.0
        shard = F.pmod(F.hash("h"), F.lit(shards)).cast("int").alias("shard")
        heads = sliced.where(~F.col("seen")).select(shard, "h", "ord", F.lit(False).alias("past"))
        if history is not None:
            past = history.select(blank_to_null(F.col(key)).alias("k")).where(F.col("k").isNotNull()).select(F.xxhash64("k").alias("h")).distinct()
            heads = heads.unionByName(past.select(shard, "h", F.lit(0).cast("long").alias("ord"), F.lit(True).alias("past")))
        if chains is None:
            chains = rows.sparkSession.createDataFrame([], _CHAINS)

        def ask(heads: pd.DataFrame, chain: pd.DataFrame) -> pd.DataFrame:
            own = Chain(error, first) if chain.empty else Chain.opened(chain["chain"].iloc[0])
            heads = heads.sort_values(["past", "ord"], ascending=[False, True], kind="stable")
            seen = own.ask(heads["h"].to_numpy(np.int64).view(np.uint64), step) & ~heads["past"].to_numpy(bool)
            out = pd.DataFrame({"ord": heads["ord"][seen].astype("Int64"), "chain": None, "bound": np.nan})
            kept = pd.DataFrame({"ord": pd.array([None], "Int64"), "chain": [own.packed()], "bound": [own.bound + bound]})
            return pd.concat([out, kept]).assign(shard=(heads if chain.empty else chain)["shard"].iloc[0])[["shard", "ord", "chain", "bound"]]

        told = durable(heads.repartition(shards, "shard").groupBy("shard").cogroup(chains.select("shard", "chain").repartition(shards, "shard").groupBy("shard")).applyInPandas(ask, "shard int, ord long, chain binary, bound double"))
        after = told.where(F.col("chain").isNotNull()).select("shard", "chain", "bound")
        return sliced.where("seen").select("ord").unionByName(told.where(F.col("ord").isNotNull()).select("ord")), after

    def seen(self, rows: DataFrame, history: DataFrame | None = None, key: str = "input", ord: str = "ord") -> DataFrame:
        """(ord): the rows of `rows` whose trimmed key is in `history` or in a row of lower `ord`."""
        return self.asked(rows, history, key, ord)[0]

    def rate(self, rows: DataFrame, history: DataFrame | None = None, key: str = "input", ord: str = "ord") -> DataFrame:
        """(asked, seen, wrong, measured_rate, bound): the answers held against an exact count, and the largest bound of the chains that gave them.

        A filter only errs by calling a new key seen, so the wrong answers are the seen rows beyond
        the exact number: rows with a key less one for each key that the history lacks.
        """
        k = blank_to_null(F.col(key)).alias("k")
        mine = rows.select(k).where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n"))
        if history is not None:
            mine = mine.join(history.select(k).where(F.col("k").isNotNull()).distinct().withColumn("old", F.lit(1)), "k", "left")
        else:
            mine = mine.withColumn("old", F.lit(None).cast("int"))
        exact = mine.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("asked"), F.count_if(F.col("old").isNull()).alias("new"))
        answers, chains = self.asked(rows, history, key, ord)
        got = answers.agg(F.count("*").alias("seen"))
        bound = chains.agg(F.coalesce(F.max("bound"), F.lit(0.0)).alias("bound"))
        wrong = F.col("seen") - (F.col("asked") - F.col("new"))
        return exact.join(got).join(bound).select("asked", "seen", wrong.alias("wrong"), (wrong / F.greatest(F.col("new"), F.lit(1))).alias("measured_rate"), "bound")


class KeyHistory:
    """Chains kept below the folder `path`, a generation for each delivery; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, **settings):
        self.spark, self.files, self.shards, self.filter = spark, Files(spark, path), shards, SeenKeys(**settings)
        done = sorted(int(g) for g in self.files.prefixes("chains") if self.files.exists(f"chains/{g}/_SUCCESS"))
        self.generation = done[-1] if done else 0
        if done and (kept := self.spark.read.text(self.files.full("shards")).first()[0]) != str(shards):
            raise ValueError(f"this history was made with {kept} shards")

    def add(self, rows: DataFrame, key: str = "input", ord: str = "ord") -> DataFrame:
        """(ord): the rows of a delivery whose key came before, in it or in any earlier one; its keys join the history."""
        past = self.spark.read.schema(_CHAINS).parquet(self.files.full(f"chains/{self.generation}")) if self.generation else None
        answers, after = self.filter.asked(rows, None, key, ord, past, self.shards)
        answers = durable(answers)
        if past is not None:
            after = after.unionByName(past.join(after.select("shard"), "shard", "left_anti"))
        else:
            self.spark.createDataFrame([(str(self.shards),)], "value string").coalesce(1).write.mode("overwrite").text(self.files.full("shards"))
        after.write.mode("overwrite").parquet(self.files.full(f"chains/{self.generation + 1}"))
        self.generation += 1
        self.files.delete(f"chains/{self.generation - 1}")
        return answers
