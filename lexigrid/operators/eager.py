"""Per-key results when a few keys hold most rows: aggregate first, join compact states, then roll up.

Every task folds its own rows into one state per key before anything is shuffled, so a key that holds a third of the rows
costs each task one state like any other key. Joins see states only; what a join of the rows would give is worked out from
them: counts multiply, a sum of one side is multiplied by the other side's count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, value: str | None = None, group: str | None = None) -> DataFrame:
    """(key[, grp], n[, total]): rows and the sum of ``value`` for each non-null key (and non-null ``group`` within it); null values add nothing, a key of only nulls has a null total.

    Exact; partial aggregation runs before the shuffle. Columns other than those named are not read.
    """
    by = ["key", "grp"] if group else ["key"]
    src = df.select(F.col(key).alias("key"), *([F.col(group).alias("grp")] if group else []), (F.col(value) if value else F.lit(None)).cast("decimal(38,0)").alias("value")).dropna(subset=by)
    return src.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *([F.sum("value").alias("total")] if value else []))


def join_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, [grp,] left_rows, right_rows, join_rows[, left_sum, right_sum]) of the inner join that lies behind the key states of both sides: counts multiply, a side's sum is multiplied by the other side's count. Products are decimals, so they don't overflow."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    x = a.withColumnsRenamed({"n": "left_rows", "total": "a_sum"})
    y = b.withColumnsRenamed({"n": "right_rows", "total": "b_sum"})
    sums = [(F.col("a_sum") * big("right_rows")).cast("decimal(38,0)").alias("left_sum")] * ("a_sum" in x.columns) + [(F.col("b_sum") * big("left_rows")).cast("decimal(38,0)").alias("right_sum")] * ("b_sum" in y.columns)
    return x.join(y, "key").select("key", *(c for c in x.columns if c == "grp"), "left_rows", "right_rows", (big("left_rows") * big("right_rows")).alias("join_rows"), *sums)


def eager_join(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """Per key of the inner join of both inputs: join rows and the sums of either side's value over the join rows.

    (key, left_rows, right_rows, join_rows, left_sum, right_sum); no join row is ever built. Null keys join nothing.
    """
    return join_states(key_states(left, key, left_value), key_states(right, key, right_value))


def roll_up(states: DataFrame, by: Column, name: str) -> DataFrame:
    """Key states of a coarser key: states add up."""
    return states.groupBy(by.alias(name)).agg(F.sum("join_rows").alias("join_rows"), F.sum("left_sum").alias("left_sum"), F.sum("right_sum").alias("right_sum"), F.count(F.lit(1)).alias("keys"))


def field_states(fields: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(field_name, key, n) of several fields, keys as plain decimal strings. Each field is read as a single column."""
    out = None
    for name, (df, key) in fields.items():
        part = key_states(df, key).select(F.lit(name).alias("field_name"), F.col("key").cast("string").alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def hot_keys(fields: dict[str, tuple[DataFrame, str]], share: tuple[int, int] = (1, 50)) -> DataFrame:
    """(field_name, hot_key, n, field_rows): keys with at least share[0]/share[1] of the rows in which their field isn't null.

    An eager join on the field's name of the rows by key with all rows of the field: the left states are those of (field, key), the right ones (field) are rolled up from them, as states add up, so the
    rows are read once. Of the join's n x N rows a hot key has at least the share of N x N. The right side has one row a field and may be broadcast. A share of 1/50 leaves at most 50 keys of a field, whatever its size. An empty field has none.
    """
    states = field_states(fields).select(F.col("key").alias("grp"), F.col("field_name").alias("key"), "n")
    j = join_states(states, F.broadcast(states.groupBy("key").agg(F.sum("n").alias("n"))))
    whole = F.col("right_rows").cast("decimal(19,0)")
    hot = j.where(F.col("join_rows") / whole * share[1] >= whole * share[0])
    return hot.select(F.col("key").alias("field_name"), F.col("grp").alias("hot_key"), F.col("left_rows").alias("n"), F.col("right_rows").alias("field_rows"))
