"""Has this key been seen before? Scalable Bloom chains, one for each hash bucket of the key, kept from run to run."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) of each key."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Layer:
    def __init__(self, capacity: int, error: float, used: int = 0, words: np.ndarray | None = None):
        self.capacity, self.error, self.used = capacity, error, used
        self.probes = max(1, math.ceil(-math.log2(error)))
        self.bits = math.ceil(capacity * self.probes / math.log(2))
        self.words = np.zeros(self.bits // 64 + 1, dtype=np.uint64) if words is None else words

    def _at(self, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # the cubic term keeps keys whose steps agree from sharing all their places
        with np.errstate(over="ignore"):
            i = (a + np.uint64(k) * b + np.uint64((k**3 - k) // 6)) % np.uint64(self.bits)
        return (i >> np.uint64(6)).astype(np.int64), np.uint64(1) << (i & np.uint64(63))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # most keys drop out after a few probes, so only those still in question go on
        at = np.arange(len(a))
        for k in range(self.probes):
            w, m = self._at(a[at], b[at], k)
            at = at[(self.words[w] & m) != 0]
            if not len(at):
                break
        out = np.zeros(len(a), dtype=bool)
        out[at] = True
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for k in range(self.probes):
            w, m = self._at(a, b, k)
            np.bitwise_or.at(self.words, w, m)
        self.used += len(a)


class Chain:
    """A key is answered "seen" if any layer has it. When the newest layer is at its capacity (half of its bits set), a layer
    ``growth`` times as large with ``tighten`` times the error is put on top, so the compounded rate of false positives stays below
    error / (1 - tighten) for any length of history."""

    def __init__(self, capacity: int = 1 << 9, error: float = 0.001, growth: int = 2, tighten: float = 0.5):
        self.growth, self.tighten = growth, tighten
        self.layers = [Layer(capacity, error)]

    def bound(self) -> float:
        return 1.0 - math.prod(1.0 - x.error for x in self.layers)

    def __len__(self) -> int:
        return sum(x.used for x in self.layers)

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = mix(keys, 0x9E3779B97F4A7C15), mix(keys, 0x632BE59BD9B4E019) | np.uint64(1)
        out = np.zeros(len(keys), dtype=bool)
        for layer in reversed(self.layers):
            rest = np.flatnonzero(~out)
            if not len(rest):
                break
            out[rest] = layer.has(a[rest], b[rest])
        return out

    def add(self, keys: np.ndarray) -> None:
        a, b = mix(keys, 0x9E3779B97F4A7C15), mix(keys, 0x632BE59BD9B4E019) | np.uint64(1)
        at = 0
        while at < len(keys):
            top = self.layers[-1]
            if top.used >= top.capacity:
                top = Layer(top.capacity * self.growth, top.error * self.tighten)
                self.layers.append(top)
            n = min(len(keys) - at, top.capacity - top.used)
            top.add(a[at : at + n], b[at : at + n])
            at += n

    def dump(self, part: int = 4 << 20) -> Iterator[bytes]:
        """The chain in pieces of at most about ``part`` bytes, in order."""
        head = struct.pack("<idq", self.growth, self.tighten, len(self.layers)) + b"".join(struct.pack("<qdq", x.capacity, x.error, x.used) for x in self.layers)
        yield head
        for x in self.layers:
            data = x.words.tobytes()
            for k in range(0, len(data), part):
                yield data[k : k + part]

    @classmethod
    def load(cls, pieces: list[bytes]) -> "Chain":
        growth, tighten, n = struct.unpack_from("<idq", pieces[0])
        data, at = b"".join(pieces[1:]), 0
        self = cls.__new__(cls)
        self.growth, self.tighten, self.layers = growth, tighten, []
        for k in range(n):
            layer = Layer(*struct.unpack_from("<qdq", pieces[0], struct.calcsize("<idq") + k * struct.calcsize("<qdq")))
            layer.words = np.frombuffer(data, dtype=np.uint64, count=len(layer.words), offset=at).copy()
            at += layer.words.nbytes
            self.layers.append(layer)
        return self


#: A key with at least 1/HOT of an Arrow batch is hot there.
HOT = 64
#: Kinds of rows in a bucket, in their order: pieces of the chain of earlier runs, keys to remember, records, repeats that are certain.
CHAIN, OLD, NEW, CERTAIN = range(4)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the records of a batch's hot keys but the one of smallest order of each as certain repeats (of equal orders the first in the batch isn't). Every row comes out once, in the same pass."""
    for b in batches:
        key, order = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        by = np.lexsort((order, key))
        first = np.ones(len(by), dtype=bool)
        first[1:] = key[by][1:] != key[by][:-1]
        times = np.diff(np.append(np.flatnonzero(first), len(by)))
        certain = np.empty(len(by), dtype=bool)
        certain[by] = ~first & np.repeat(times * HOT >= len(by), times)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(certain, CERTAIN, NEW).astype(np.int32))], names=["key", "order", "kind"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the bucket changes."""
    for batch in batches:
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield int(bucket[lo]), batch.slice(lo, hi - lo)


def _through(capacity: int, error: float, keep: bool):
    """Rows of each bucket in order of kind and order, through its chain. keep: comes out with the chains as they are at the end instead of the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, pieces = None, None, []

        def state() -> Chain:
            return Chain.load(pieces) if pieces else Chain(capacity, error)

        def kept() -> Iterator[pa.RecordBatch]:
            if keep and now is not None:
                done = chain if chain is not None else state()
                for k, data in enumerate(done.dump()):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([k], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "part", "state"])

        for bucket, b in _buckets(batches):
            if bucket != now:
                yield from kept()
                now, chain, pieces = bucket, None, []
            kind, key = b.column(1).to_numpy(zero_copy_only=False), b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            told = int((kind == CHAIN).sum())
            pieces += b.column(4).slice(0, told).to_pylist()
            if told == len(kind):
                continue
            if chain is None:
                chain, pieces = state(), []
            lo, hi = np.searchsorted(kind, [NEW, CERTAIN])
            if lo > told:
                old = np.unique(key[told:lo])
                chain.add(old[~chain.has(old)])
            said = np.ones(len(kind), dtype=bool)
            if hi > lo:
                uniq, first, back = np.unique(key[lo:hi], return_index=True, return_inverse=True)
                known = chain.has(uniq)
                chain.add(uniq[~known])
                answer = known[back]
                answer[np.setdiff1d(np.arange(hi - lo), first, assume_unique=True)] = True
                said[lo:hi] = answer
            if not keep and len(kind) > lo:
                bound = pa.array(np.where(kind[lo:] == NEW, chain.bound(), 0.0))
                yield pa.RecordBatch.from_arrays([b.column(2).slice(lo), b.column(3).slice(lo), pa.array(said[lo:]), bound, pa.array(kind[lo:] == CERTAIN)], names=["key", "order", "said", "bound", "settled"])
        yield from kept()

    return run


def _rows(df: DataFrame | None, key: str, order: str | None, history: DataFrame | None, history_key: str | None, chains: DataFrame | None, buckets: int) -> DataFrame:
    """All rows in one exchange by bucket, sorted within. Certain repeats go to any bucket, by their order, as no chain has to see them."""
    home, out = lambda: F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), []
    none = F.lit(None).cast("binary").alias("state")
    if df is not None:
        src = df.select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("order")).where("key is not null and `order` is not null")
        told = src.mapInArrow(_settle, "key bigint, `order` bigint, kind int")
        bucket = F.when(F.col("kind") == CERTAIN, F.pmod(F.xxhash64("order"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("int")
        out.append(told.select(bucket.alias("bucket"), "kind", "key", "order", none))
    if history is not None:
        old = history.select(F.col(history_key or key).cast("bigint").alias("key")).where("key is not null")
        out.append(old.select(home(), F.lit(OLD).alias("kind"), "key", F.lit(0).cast("bigint").alias("order"), none))
    if chains is not None:
        out.append(chains.select("bucket", F.lit(CHAIN).alias("kind"), F.lit(None).cast("bigint").alias("key"), F.col("part").alias("order"), "state"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "order")


#: Buckets of keys. A task holds one bucket's chain at a time: at 1e-7 about 4.5 bytes a distinct key, at 0.001 about 2.
BUCKETS = 256


def remembered(history: DataFrame | None, key: str, chains: DataFrame | None = None, buckets: int = BUCKETS, capacity: int = 1 << 9, error: float = 1e-7) -> DataFrame:
    """(bucket, part, state): the chains of a run, to be written and given to the next one, with the keys of ``history`` added to those of ``chains`` (of the same number of buckets). Null keys aren't remembered."""
    return _rows(None, key, None, history, key, chains, buckets).mapInArrow(_through(capacity, error, True), "bucket int, part bigint, state binary")


def answers(df: DataFrame, key: str, order: str, history: DataFrame | None = None, history_key: str | None = None, chains: DataFrame | None = None, buckets: int = BUCKETS, capacity: int = 1 << 9, error: float = 1e-7) -> DataFrame:
    """(key, order, said, bound, settled) of each record whose key and order aren't null.

    said: the chain's answer, never wrong when it says no, and wrong when it says yes for at most the share ``bound`` of the unseen records: the compounded bound of the chain when the record came, below
    2 x error. What was seen before these records comes as keys (``history``), as the chains that ``remembered`` left (``chains``), or both. Records of null key or order have no answer and aren't remembered;
    repeated rows count like any other; of records with the same key and order all but one are seen. Other columns aren't read.

    Repeats of a hot key within an Arrow batch are certain (``settled``) and go past the chains, spread over all buckets, so a key with a third of all rows leaves one row a batch to its bucket. There is one pass and
    one exchange, by bucket; each bucket's rows run through its chain in order of arrival. No key is kept, and no record is compared with another.
    """
    return _rows(df, key, order, history, history_key, chains, buckets).mapInArrow(_through(capacity, error, False), "key bigint, `order` bigint, said boolean, bound double, settled boolean")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, history first, then by order: a record was seen unless it is its key's first. Certain repeats come last and are what they are."""
    last = None
    for b in batches:
        settled = b.column(4).fill_null(False).to_numpy(zero_copy_only=False)
        key = b.column(0).to_numpy(zero_copy_only=False)
        n = int((~settled).sum())
        first = np.zeros(len(key), dtype=bool)
        if n:
            first[1:n] = key[1:n] != key[: n - 1]
            first[0] = last is None or key[0] != last
            last = key[n - 1]
        out = pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(~first), *b.columns[3:]], names=["order", "said", "seen", "bound", "settled"])
        yield out.filter(b.column(2).is_valid())


def checked(told: DataFrame, history: DataFrame | None = None, history_key: str = "key") -> DataFrame:
    """(order, said, seen, bound, settled): the answers beside the truth, by a sort of all keys; for measuring, not for answering. Certain repeats are spread by their order."""
    rows = told.select("key", "order", "said", "bound", "settled")
    if history is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("said", "boolean"), ("bound", "double"))]
        rows = rows.unionByName(history.select(F.col(history_key).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("order"), *none, F.lit(False).alias("settled")).where("key is not null"))
    rows = rows.repartition(F.when(F.col("settled"), F.xxhash64("order")).otherwise(F.xxhash64("key"))).sortWithinPartitions(F.col("settled"), F.col("key"), F.col("said").isNotNull(), F.col("order"))
    return rows.mapInArrow(_confirm, "`order` bigint, said boolean, seen boolean, bound double, settled boolean")


def wrong_rate(checked_: DataFrame) -> DataFrame:
    """One row: records, those said to be seen, those of them settled in their batch without a chain, those wrongly said to be seen, their share of the unseen, and the bound that held for it (0 without records)."""
    n = lambda c: F.count(F.when(c, 1))
    a = checked_.agg(F.count(F.lit(1)).alias("records"), n(F.col("said")).alias("said_seen"), n(F.col("settled")).alias("batch_settled"), n(F.col("said") & ~F.col("seen")).alias("wrong"), n(~F.col("seen")).alias("unseen"), F.coalesce(F.max("bound"), F.lit(0.0)).alias("bound"))
    return a.select("records", "said_seen", "batch_settled", "wrong", F.coalesce(F.try_divide(F.col("wrong"), F.col("unseen")), F.lit(0.0)).alias("wrong_rate"), "bound")
