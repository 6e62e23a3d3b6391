"""Joins that stand skewed keys: fragment-replicate (block), frequency-driven (lean), checked broadcast, cogroup in bounded lists, Bloom pre-check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from lexigrid.operators.eager import key_states


def row_hash(df: DataFrame) -> Column:
    """A hash of the row's own columns: the same after any retry, in whatever order rows come. Maps and variants don't enter it."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))), F.lit(7))


def _cells(df: DataFrame, own: Column | int, other: Column | int, own_name: str, other_name: str) -> DataFrame:
    """Each row in one cell of its own axis, by its hash, copied along the other's. Only rows that repeat in all columns share a cell for that."""
    one = F.lit(own) if isinstance(own, int) else own
    two = F.lit(other) if isinstance(other, int) else other
    return df.withColumn(own_name, F.pmod(row_hash(df), one).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), (two - 1).cast("int"))))


def block_join(left: DataFrame, right: DataFrame, key: str, left_cells: int = 4, right_cells: int = 4, how: str = "inner") -> DataFrame:
    """Equi-join over a grid of left_cells x right_cells per key: each pair of rows meets in exactly one cell. Equal to the plain join, for any skew on either side.

    An outer join keeps its preserved side in a single copy, so its axis has all the cells and the other side is replicated.
    """
    if how == "left":
        left_cells, right_cells = left_cells * right_cells, 1
    elif how == "right":
        left_cells, right_cells = 1, left_cells * right_cells
    a = _cells(left, left_cells, right_cells, "__i", "__j")
    b = _cells(right, right_cells, left_cells, "__j", "__i")
    return a.join(b, [key, "__i", "__j"], how).drop("__i", "__j")


def replication(other: Column, parts: int, factor: float = 0.01) -> Column:
    """Copies of a row whose key has ``other`` rows on the other side: a hundredth of them, between 1 and the number of partitions."""
    return F.greatest(F.least((other * factor).cast("int"), F.lit(parts)), F.lit(1))


def fixed_replication(other: Column, copies: int, least: int) -> Column:
    """The same number of copies for every key with at least ``least`` rows on the other side, 1 below."""
    return F.when(other >= least, F.lit(copies)).otherwise(F.lit(1))


def root_replication(own: Column, other: Column, parts: int) -> Column:
    """Copies so that cells are about square: the root of parts times other over own, between 1 and the number of partitions."""
    return F.greatest(F.least(F.sqrt(F.lit(float(parts)) * other / own).cast("int"), F.lit(parts)), F.lit(1))


def key_frequency(df: DataFrame, key: str) -> DataFrame:
    """(key, n), exact, folded map-side."""
    return key_states(df, key)


#: A key is looked at by lean_join if it may hold more than 1/TRACKED of a side's rows: no more keys than that can.
TRACKED = 4096


def frequent_keys(df: DataFrame, key: str) -> dict[int, int]:
    """Hashes of keys and about how many rows they hold, by a sketch of bounded size; no key with more than about 1/TRACKED of the rows is missing. Null keys aren't counted."""
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(xxhash64(`{key}`), {TRACKED}, {4 * TRACKED})").alias("top")).first()["top"]
    return {x["item"]: x["count"] for x in top or []}


def lean_join(left: DataFrame, right: DataFrame, key: str, parts: int = 32, factor: float = 0.01, how: str = "inner") -> DataFrame:
    """Block join with a grid by key: only keys whose replication exceeds 1 on either axis are salted, everything else joins as it is.

    Frequencies come from one sketch a side, without a shuffle; whatever they are, the result is that of the plain join. The grid has at most 2 x TRACKED rows and is
    broadcast; where no key needs it, the plain join runs.
    """
    nl, nr = frequent_keys(left, key), frequent_keys(right, key)
    copies = lambda n: max(min(int(n * factor), parts), 1)
    # a row of the left is copied by the rows of its own key on the right and the other way round
    grid = [(h, copies(nl.get(h, 0)), copies(nr.get(h, 0))) for h in sorted({*nl, *nr})]
    if how != "inner":
        grid = [(h, a * b, 1) if how == "left" else (h, 1, a * b) for h, a, b in grid]
    grid = [x for x in grid if x[1:] != (1, 1)]
    if not grid:
        return left.join(right, key, how)
    g = F.broadcast(left.sparkSession.createDataFrame(grid, "__h bigint, __cl int, __cr int").coalesce(1))

    def sized(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        j = df.withColumn("__h", F.when(F.col(key).isNotNull(), F.xxhash64(key))).join(g, "__h", "left")
        one, two = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        j = j.withColumn(own_name, F.when(one > 1, F.pmod(row_hash(df), one)).otherwise(0).cast("int"))
        return j.withColumn(other_name, F.explode(F.sequence(F.lit(0), two - 1))).drop("__h", "__cl", "__cr")

    return sized(left, "__cl", "__cr", "__i", "__j").join(sized(right, "__cr", "__cl", "__j", "__i"), [key, "__i", "__j"], how).drop("__i", "__j")


def broadcast_join(left: DataFrame, right: DataFrame, key: str, limit: int = 1_000_000, limit_bytes: int = 64 << 20, how: str = "inner") -> DataFrame:
    """Map-side join if the right side has at most ``limit`` rows and ``limit_bytes`` bytes (as JSON), which are measured first on no more than limit + 1 rows; a shuffled join beyond. Unmatched keys drop out, duplicate keys all join."""
    head = right.limit(limit + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
    n = head.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    small = n["rows"] <= limit and n["bytes"] <= limit_bytes
    return left.join(F.broadcast(right) if small else right, key, how)


def cogroup_sizes(left: DataFrame, right: DataFrame, key: str, value_l: str, value_r: str) -> DataFrame:
    """(key, n_left, n_right, sum_left, sum_right) of every key of either side: the cogroup as states rather than lists, which have no bound."""
    a, b = key_states(left, key, value_l), key_states(right, key, value_r)
    a, b = a.select("key", F.col("n").alias("n_left"), F.col("total").alias("sum_left")), b.select("key", F.col("n").alias("n_right"), F.col("total").alias("sum_right"))
    return a.join(b, "key", "full")


def cogroup(left: DataFrame, right: DataFrame, key: str, value_l: str, value_r: str, most: int = 100_000) -> DataFrame:
    """(key, cell, lefts, rights): the values of either side by key as sorted lists, each value in one cell.

    A key with up to ``most`` rows is one cell; a larger one is cut by hash into as many cells as keep each at about that size, so no list grows with the data. Null keys are left out, null values stay
    out of the lists. Rows that repeat in key and value share a cell.
    """
    rows = left.select(F.col(key).alias("key"), F.col(value_l).alias("v"), F.lit(None).cast(dict(right.dtypes)[value_r]).alias("w"), F.lit(0).alias("side"))
    rows = rows.unionByName(right.select(F.col(key).alias("key"), F.lit(None).cast(dict(left.dtypes)[value_l]).alias("v"), F.col(value_r).alias("w"), F.lit(1).alias("side"))).where("key is not null")
    large = key_states(rows, "key").where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("cells"))
    rows = rows.join(large, "key", "left").withColumn("cell", F.pmod(F.xxhash64("v", "w", "side"), F.coalesce("cells", F.lit(1))).cast("int"))
    return rows.groupBy("key", "cell").agg(F.array_sort(F.collect_list("v")).alias("lefts"), F.array_sort(F.collect_list("w")).alias("rights"))


def bloom_size(n: int, error: float) -> tuple[int, int]:
    """(bits, probes) of a Bloom filter for n keys at the given rate of false positives; bits in whole words of 64."""
    bits = max(64, -(-math.ceil(-n * math.log(error) / math.log(2) ** 2) // 64) * 64)
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def _places(key: Column, bits: int, probes: int) -> list[Column]:
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    # shifted down, so that no sum leaves 64 bits
    return [F.pmod(F.shiftright(a, 8) + k * F.shiftright(b, 8), F.lit(bits)) for k in range(probes)]


def bloom_filter(df: DataFrame, key: str, expected: int, error: float = 0.01) -> DataFrame:
    """One row (words): the bits of a Bloom filter of the keys as an array of longs. Its size depends on ``expected`` alone, 1.2 MB for a million keys at 0.01. Bits are set map-side and merged by word; null keys set none."""
    bits, probes = bloom_size(expected, error)
    at = df.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits, probes))).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    every = words.unionByName(df.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits")))
    set_ = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return set_.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def might_contain(words: Column, key: Column, expected: int, error: float = 0.01) -> Column:
    """Whether the filter may hold the key: never false for a key in it, true for about ``error`` of the others, false for null."""
    bits, probes = bloom_size(expected, error)
    hit = F.lit(True)
    for at in _places(key, bits, probes):
        hit = hit & (F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return key.isNotNull() & hit


def bloom_join(left: DataFrame, right: DataFrame, key: str, expected: int, error: float = 0.01) -> DataFrame:
    """Inner join in which left rows whose key can't be on the right stop before the shuffle. Exact whatever ``expected`` says; too low a number only lets more rows through."""
    words = bloom_filter(right, key, expected, error).scalar()
    return left.where(might_contain(words, F.col(key), expected, error)).join(right, key)
