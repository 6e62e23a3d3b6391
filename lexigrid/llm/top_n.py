"""The N best rows of every group, with bounds that each partition can give for itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of so many groups, those with most rows, go to all tasks: three numbers each, some 4 MB.
BOUNDS = 1 << 17
#: A task keeps about so many rows at once.
KEPT = 500_000


def _places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each group, rank of each row in its group) of rows sorted by the keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(new) > 1 else True
    at = np.arange(len(new))
    return np.flatnonzero(new), at - np.maximum.accumulate(np.where(new, at, 0))


def _bounds(n: int):
    """Columns h1, h2 (hashes of the group) and score; one row for each group of which the partition has n rows or more: its n-th best score here, a lower bound of the group's n-th best, and its rows."""

    def best(parts: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(parts, axis=1)
        x = x[:, np.lexsort((-x[2], x[1], x[0]))]
        start, rank = _places(x[0], x[1])
        rows = np.add.reduceat(x[3], start) if len(start) else x[3]
        kept = x[:, rank < n]
        start, rank = _places(kept[0], kept[1])
        kept[3] = 1
        if len(start):
            kept[3, start] = rows - np.diff(np.append(start, kept.shape[1])) + 1
        return kept

    def told(x: np.ndarray) -> pa.RecordBatch:
        start, rank = _places(x[0], x[1])
        rows = np.add.reduceat(x[3], start) if len(start) else x[3]
        full = rank == n - 1
        group = np.cumsum(rank == 0) - 1
        return pa.RecordBatch.from_arrays([pa.array(x[0][full]), pa.array(x[1][full]), pa.array(x[2][full]), pa.array(rows[group[full]])], names=["h1", "h2", "bound", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        for b in batches:
            held.append(np.stack([*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)), np.ones(b.num_rows, dtype=np.int64)]))
            size += b.num_rows
            if size > 2 * max(kept, 32_768):
                held = [best(held)]
                size = kept = held[0].shape[1]
                if kept > KEPT:  # a bound over part of a partition is a bound as well
                    yield told(held[0])
                    held, size, kept = [], 0, 0
        if held:
            yield told(best(held))

    return run


def _local(n: int):
    """Columns grp, score, tie, id; the partition's n best rows of each group."""

    def best(parts: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(parts).combine_chunks()
        if not len(t):
            return t
        code = t["grp"].combine_chunks().dictionary_encode().indices
        order = pc.sort_indices(t.append_column("code", code), sort_keys=[("code", "ascending"), ("score", "descending"), ("tie", "ascending"), ("id", "ascending")])
        _, rank = _places(code.take(order).to_numpy())
        return t.take(order.filter(pa.array(rank < n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > 2 * max(kept, 32_768):
                t = best(held)
                size = kept = len(t)
                held = t.to_batches()
                if kept > KEPT:
                    yield from held
                    held, size, kept = [], 0, 0
        if held:
            yield from best(held).to_batches()

    return run


def group_bounds(df: DataFrame, group: str, score: str, n: int = 3, most: int = BOUNDS) -> DataFrame:
    """(h1, h2, bound): for the ``most`` groups with most rows in partitions that have n of them, the largest of the partitions' n-th best scores. Groups are named by 128 bits of hashes."""
    src = df.select(F.xxhash64(group).alias("h1"), F.xxhash64(group, F.lit(1)).alias("h2"), F.col(score).cast("bigint").alias("score"))
    told = src.mapInArrow(_bounds(n), "h1 bigint, h2 bigint, bound bigint, rows bigint")
    return told.groupBy("h1", "h2").agg(F.max("bound").alias("bound"), F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "h1", "h2").limit(most).drop("rows")


def top_n(df: DataFrame, group: str, score: str, tie: str, row_id: str, n: int = 3, most: int = BOUNDS) -> DataFrame:
    """(grp, score, tie, id, place): the first n rows of each group by score descending, tie ascending (by code point), id ascending.

    Rows with a null group, score, tie or id don't take part; repeated rows count singly; a smaller group gives all its rows. Other columns aren't read.

    The n-th best score that a partition sees in a group bounds the group's n-th best from below. The largest bound of each group (of the ``most`` groups with most rows, a table of bounded size) is joined
    with the rows where they lie, and rows under it go before anything is moved. What is left is cut to the partition's own n best of each group, which also ends ties at the bound; survivors
    are moved once and ranked. The result doesn't depend on which groups have a bound.
    """
    src = df.select(F.col(group).alias("grp"), F.col(score).cast("bigint").alias("score"), F.col(tie).alias("tie"), F.col(row_id).cast("bigint").alias("id"))
    src = src.where("grp is not null and score is not null and tie is not null and id is not null")
    bounds = group_bounds(src, "grp", "score", n, most)
    told = src.withColumns({"h1": F.xxhash64("grp"), "h2": F.xxhash64("grp", F.lit(1))}).join(F.broadcast(bounds), ["h1", "h2"], "left")
    kept = told.where("bound is null or score >= bound").select("grp", "score", "tie", "id").mapInArrow(_local(n), "grp string, score bigint, tie string, id bigint")
    place = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("score"), "tie", "id"))
    return kept.withColumn("place", place).where(F.col("place") <= n).select("grp", "score", "tie", "id", "place")
