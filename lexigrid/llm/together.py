"""Items that appear together: weighted pair counts and lift by heavy-light decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: An item is heavy if it stands in at least one of HEAVY records, so each side has at most HEAVY heavy items.
HEAVY = 64


def dense_counts(a: np.ndarray, b: np.ndarray, weight: np.ndarray, size: int = HEAVY) -> np.ndarray:
    """Weight of the records of each pair of heavy codes (a row of bits for each item, ANDed and counted per binary digit of the weight)."""
    out = np.zeros((size, size), dtype=np.int64)
    if not len(a):
        return out
    ua, ub = np.unique(a), np.unique(b)
    rows_a = np.packbits(ua[:, None] == a[None, :], axis=1)
    rows_b = np.packbits(ub[:, None] == b[None, :], axis=1)
    for sign in (1, -1):
        w = np.where(weight * sign > 0, weight * sign, 0)
        for digit in range(int(w.max()).bit_length()):
            plane = np.packbits((w >> digit & 1).astype(bool))
            hit = rows_b & plane
            out[np.ix_(ua, ub)] += sign * (1 << digit) * np.bitwise_count(rows_a[:, None, :] & hit[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, weight, code_a, code_b to partial sums (code_a, a, code_b, b, s); a text stands only where its code is null."""
    names, dense, met = ["code_a", "a", "code_b", "b", "s"], np.zeros((HEAVY, HEAVY), dtype=np.int64), np.zeros((HEAVY, HEAVY), dtype=bool)

    def grouped(t: pa.Table, keys: list[str]) -> pa.RecordBatch:
        g = t.group_by(keys).aggregate([("weight", "sum")])
        n = len(g)
        col = lambda k, kind: g[k].combine_chunks() if k in keys else pa.nulls(n, kind)
        arrays = [col("code_a", pa.int32()), col("a", pa.string()), col("code_b", pa.int32()), col("b", pa.string()), g["weight_sum"].combine_chunks()]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        ha, hb = pc.is_valid(t["code_a"]), pc.is_valid(t["code_b"])
        both = t.filter(pc.and_(ha, hb))
        codes = [both[k].to_numpy() for k in ("code_a", "code_b", "weight")]
        dense += dense_counts(*codes)
        met[codes[0], codes[1]] = True
        # rare with rare: counted by hash
        rare = t.filter(pc.invert(pc.or_(ha, hb)))
        if len(rare):
            yield grouped(rare, ["a", "b"])
        # frequent with rare: the records of each rare item are looked up among the frequent ones
        for mask, keys in ((pc.and_not(ha, hb), ["code_a", "b"]), (pc.and_not(hb, ha), ["a", "code_b"])):
            mixed = t.filter(mask)
            if len(mixed):
                yield grouped(mixed, keys)
    i, j = np.nonzero(met)  # pairs whose weights sum to 0 occur as well
    if len(i):
        none = pa.nulls(len(i), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), none, pa.array(j, pa.int32()), none, pa.array(dense[i, j])], names=names)


def _paired(df: DataFrame, left: str, right: str, weight: str, least: int | None) -> tuple[DataFrame, Column]:
    """(pairs of ``pair_counts``, total weight of all records). The input is read twice: once for the items of both sides, once for the pairs."""
    src = df.select(F.col(left).alias("a"), F.col(right).alias("b"), F.col(weight).cast("bigint").alias("weight")).where("a is not null and b is not null and weight is not null")
    # both sides' items in one exchange, which everything below that needs totals reads again
    both = src.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("item")), F.struct(F.lit(1).alias("side"), F.col("b").alias("item")))).alias("x"), "weight")
    # the side comes out of the aggregation, so that no reader's filter gets below it; all readers take all columns, and the filter that joins would add to some of them stands for all
    items = both.groupBy("x.side", "x.item").agg(F.max("x.side").alias("which"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).select("which", "item", "total", "n").where("item is not null and total is not null")
    every = items.where("which = 0").agg(F.struct(F.sum("n").alias("records"), F.sum("total").alias("weights")).alias("x")).scalar()
    records, weights = every["records"], every["weights"]
    top = items.where(F.col("n") * HEAVY >= records).withColumn("code", F.row_number().over(W.partitionBy("which").orderBy("item")) - 1)
    heavy = {k: F.broadcast(top.where(f"which = {side}").select(F.col("item").alias(f"heavy_{k}"), F.col("total").alias(f"heavy_total_{k}"), F.col("code").alias(f"code_{k}"))) for side, k in enumerate("ab")}
    coded = src.join(heavy["a"], F.col("a") == F.col("heavy_a"), "left").join(heavy["b"], F.col("b") == F.col("heavy_b"), "left")
    parts = coded.select("a", "b", "weight", "code_a", "code_b").mapInArrow(_count, "code_a int, a string, code_b int, b string, s bigint")
    pairs = parts.groupBy("code_a", "a", "code_b", "b").agg(F.sum("s").alias("s"))
    if least is not None:
        pairs = pairs.where(F.col("s") >= least)
    # A heavy item's total comes from the broadcast table; its rows take a spread key that no total has, so they don't meet in one task.
    light = items.where(F.col("n") * HEAVY < records)
    for side, k, o in ((0, "a", "b"), (1, "b", "a")):
        spread = F.when(F.col(f"code_{k}").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(o, f"code_{o}"), F.lit(4096)))
        t = light.where(f"which = {side}").select(F.col("item").alias("light"), F.col("total").alias("light_total"), F.lit(0).cast("bigint").alias("light_spread"))
        pairs = pairs.withColumn("spread", spread.cast("bigint")).withColumn("at", F.coalesce(k, F.lit("")))
        pairs = pairs.join(t, (F.col("at") == F.col("light")) & (F.col("spread") == F.col("light_spread")), "left")
        pairs = pairs.withColumn(f"light_total_{k}", F.col("light_total")).drop("light", "light_total", "light_spread", "spread", "at")
    pairs = pairs.join(heavy["a"], "code_a", "left").join(heavy["b"], "code_b", "left")
    pick = lambda k: F.coalesce(f"light_total_{k}", f"heavy_total_{k}").alias(f"total_{k}")
    return pairs.select(F.coalesce("a", "heavy_a").alias("a"), F.coalesce("b", "heavy_b").alias("b"), "s", pick("a"), pick("b")), weights


def pair_counts(df: DataFrame, left: str, right: str, weight: str, least: int | None = None) -> DataFrame:
    """(a, b, s, total_a, total_b): summed weight of each pair of items (only those with s >= least, if it is given), and of either item over all records.

    A record holds one item a side and a weight; records with a null among the three don't count, repeated records do. Sums are exact.
    Items in at least 1/64 of the records (so at most 64 a side, which may be broadcast) are heavy: pairs of two heavy items
    are counted in each task as bit rows and leave it as one small matrix; pairs of two rare items are counted by hash, and for mixed pairs the rare
    item's records are looked up among the heavy codes. All partial sums meet in one shuffle in which a heavy item's text doesn't occur.
    """
    return _paired(df, left, right, weight, least)[0]


def lift(df: DataFrame, left: str, right: str, weight: str, least: int | None = None, times: int = 0) -> DataFrame:
    """(a, b, s, total_a, total_b, lift) of each pair; with ``least`` only of pairs with s >= least, with ``times`` only of those that stand together at least so often as by chance: s * total >= times * total_a * total_b. The lift is null where a total is 0. Empty input has no pair.

    The comparison is exact where both products have at most 37 digits, as with sums up to 10^17; beyond it is made between doubles.
    """
    pairs, weights = _paired(df, left, right, weight, least)
    p = pairs.withColumn("total", weights)
    if times:
        big = lambda c: F.col(c).cast("decimal(19,0)")
        exact = F.try_multiply(big("total_a") * big("total_b"), F.lit(times).cast("decimal(5,0)")).cast("decimal(38,0)")
        near = F.col("s").cast("double") * F.col("total") >= F.col("total_a").cast("double") * F.col("total_b") * times
        p = p.where(F.coalesce(big("s") * big("total") >= exact, near))
    return p.select("a", "b", "s", "total_a", "total_b", F.try_divide(F.try_divide(F.col("s").cast("double") * F.col("total"), F.col("total_a")), F.col("total_b")).alias("lift"))
