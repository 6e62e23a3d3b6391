"""Corpus operators: word counts, dictionaries, encoding, filters, splits, set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.written import written


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def numbered(df: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: numbers from ``first`` in the given order, without one global window: rows are range-partitioned and sorted, each partition numbers its own, and the sizes of the earlier
    partitions (one number a partition) are added. Partition numbers hold for one run only, so the numbered rows are written before they are read twice."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id())
    s = written(s.withColumn("__part", F.shiftright("__mono", 33)).withColumn("__at", F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))).drop("__mono"), "numbered")
    sizes = s.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return s.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + first).drop("__part", "__at", "__before")


def ranked(freq: DataFrame, reserved: list[str], first: int) -> DataFrame:
    """(word, id, freq): reserved words from 0, the rest from ``first`` by descending count, ties by word."""
    f = freq.where(~F.col("word").isin(reserved)) if reserved else freq
    rows = numbered(f.select("word", "freq"), [F.desc("freq"), F.asc("word")], "id", first).select("word", "id", "freq")
    if not reserved:
        return rows
    head = freq.sparkSession.createDataFrame([(w, i) for i, w in enumerate(reserved)], "word string, id bigint")
    return head.join(freq, "word", "left").select("word", "id", F.coalesce("freq", F.lit(0)).alias("freq")).unionByName(rows)


#: So many entries of a table, those that rank first, are looked up where the rows are.
HEAD = 1 << 16


def looked_up(df: DataFrame, items: str, entries: DataFrame, key: str, value: str, rank: str, head: int = HEAD) -> DataFrame:
    """``df`` with ``found``: the value of each element of the array ``items``, in order; null for elements without an entry, an empty array for a null one.

    The ``head`` entries of lowest rank go to the tasks, so a word that stands in every row never becomes a join key. Only elements that they lack are joined with the rest of the table, one row for each
    of them and row of ``df``: behind the most frequent words of a ranked dictionary none has many rows. Where the head is all of the table, nothing is shuffled. Keys of entries are unique.
    """
    kinds = dict(entries.dtypes)
    first = entries.where(F.col(key).isNotNull()).orderBy(rank, key).limit(head).select(key, value).toArrow()
    keys, values = (first[c].combine_chunks() for c in (key, value))
    rest_kind = f"array<struct<at:int,item:{kinds[key]}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            at = pc.index_in(flat.cast(keys.type), value_set=keys)
            found = pa.ListArray.from_arrays(pa.array(offsets), values.take(at))
            missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False)) if len(keys) == head else np.zeros(0, dtype=np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)[missing]
            rest = pa.StructArray.from_arrays([pa.array((missing - offsets[row]).astype(np.int32)), flat.take(pa.array(missing))], ["at", "item"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, offsets).astype(np.int32)), rest)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], found, rest], names=[*names, "found", "rest"])

    names = [c for c in df.columns if c != items]
    own = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != items)
    told = df.select(items, *names).mapInArrow(run, f"{own}, found array<{kinds[value]}>, rest {rest_kind}")
    if len(keys) < head:
        return told.drop("rest")
    # rows are numbered once, in a written table, as both branches below must see the same numbers
    told = written(told.withColumn("row", F.monotonically_increasing_id()), "looked-up")
    tail = told.where(F.size("rest") > 0).select("row", F.inline("rest")).join(entries.select(F.col(key).alias("item"), F.col(value).alias("v")), "item")
    tail = tail.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("more"))
    joined = told.join(tail, "row", "left").withColumn("found", F.when(F.col("more").isNull(), F.col("found")).otherwise(F.transform("found", lambda x, i: F.coalesce(x, F.try_element_at("more", i)))))
    return joined.select(*names, "found")


def encode(docs: DataFrame, dictionary: DataFrame, doc_id: str, toks: Column, unknown: int = 0, head: int = HEAD) -> DataFrame:
    """(doc_id, ids): token ids in order, unknown words by the given id; an empty list where there is no token (null, empty or blank text). One row for each row of ``docs``."""
    t = looked_up(docs.select(doc_id, toks.alias("items")), "items", dictionary, "word", "id", "id", head)
    return t.select(doc_id, F.transform("found", lambda x: F.coalesce(x, F.lit(unknown))).alias("ids"))


def decode(encoded: DataFrame, dictionary: DataFrame, doc_id: str, head: int = HEAD) -> DataFrame:
    """(doc_id, text): the words of the ids, blanks between; ids that the dictionary lacks are left out. An empty or null list gives the empty text."""
    t = looked_up(encoded.select(doc_id, F.col("ids").alias("items")), "items", dictionary, "id", "word", "id", head)
    return t.select(doc_id, F.array_join("found", " ").alias("text"))


def decode_rules(rules: DataFrame, dictionary: DataFrame, rule_id: str, toks: Column, head: int = HEAD) -> DataFrame:
    """(rule_id, text): rule sides of word ids with the slot # as it is and #k as # and the word of id k; tokens without a word are left out."""
    t = rules.select(rule_id, toks.alias("toks")).withColumn("items", F.transform("toks", lambda x: F.regexp_extract(x, r"^#?(\d+)$", 1).try_cast("bigint")))
    f = looked_up(t, "items", dictionary, "id", "word", "id", head)
    word = lambda x, i: F.when(x == "#", x).when(F.startswith(x, F.lit("#")), F.concat(F.lit("# "), F.get("found", i))).otherwise(F.get("found", i))
    return f.select(rule_id, F.array_join(F.transform("toks", word), " ").alias("text"))


def length_verdict(src: Column, tgt: Column | None, most: int, ratio: float | None = None) -> Column:
    """Why a pair (or, without a target, a text) is no use: "empty", "long" (more than ``most`` tokens a side), "ratio" (one side more than ``ratio`` times the other); null for a sound one. A null side is an empty one."""
    sides = [F.coalesce(F.size(x), F.lit(0)) for x in (src, tgt) if x is not None]
    lo, hi = (F.least(*sides), F.greatest(*sides)) if tgt is not None else (sides[0], sides[0])
    out = F.when(lo < 1, "empty").when(hi > most, "long")
    return out.when(hi > lo * ratio, "ratio") if ratio else out


def within_length(df: DataFrame, src: Column, tgt: Column, most: int) -> DataFrame:
    """Rows whose sides both have between 1 and ``most`` tokens."""
    return df.where(length_verdict(src, tgt, most).isNull())


def clean(df: DataFrame, src: Column, tgt: Column, most: int = 100, ratio: float = 9.0) -> tuple[DataFrame, DataFrame]:
    """(sound rows, the others with ``verdict``)"""
    told = df.withColumn("verdict", length_verdict(src, tgt, most, ratio))
    return told.where("verdict is null").drop("verdict"), told.where("verdict is not null")


def _die(key: str) -> Column:
    """A number from 0 to 65535 that any engine can work out of a key: the first four digits of its MD5."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 4), 16, 10).cast("int")


def hold_out(df: DataFrame, key: str, share: int = 10) -> DataFrame:
    """Every row with the part it belongs to, by a hash of its key: the same row always falls into the same part."""
    return df.withColumn("part", F.when(F.pmod(_die(key), F.lit(100)) < share, "test").otherwise("train"))


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows without replacement (all, if there are fewer): those whose keys have the smallest hashes, so the same ones each time."""
    return df.withColumn("__h", F.md5(F.col(key).cast("string").cast("binary"))).orderBy("__h", key).limit(n).drop("__h")


def split_by_size(df: DataFrame, order: str, size: Column, most: int) -> DataFrame:
    """(order, bucket): consecutive rows in buckets of about ``most`` in total size. The running sum is taken within range partitions and shifted by the sums of those before."""
    s = df.select(F.col(order).alias("order"), size.cast("bigint").alias("size")).repartitionByRange("order").withColumn("part", F.spark_partition_id())
    s = written(s, "split")
    inner = F.sum("size").over(W.partitionBy("part").orderBy("order").rowsBetween(W.unboundedPreceding, 0))
    sums = s.groupBy("part").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    run = s.withColumn("run", inner).join(F.broadcast(before), "part")
    return run.select(F.col("order").alias(order), F.floor((F.col("run") + F.col("before") - 1) / most).cast("bigint").alias("bucket"))


def type_token_line(docs: DataFrame, types: Column, toks: Column) -> DataFrame:
    """(slope, intercept) of ln(types) over ln(tokens)."""
    return docs.agg(F.regr_slope(F.ln(types), F.ln(toks)).alias("slope"), F.regr_intercept(F.ln(types), F.ln(toks)).alias("intercept"))


def except_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every left row, repeated ones too, whose key isn't on the right."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def truecase(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lower, cased): the most frequent casing of each word, ties by the casing."""
    w = docs.select(F.explode(T.tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy(F.lower("word").alias("lower")).agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("cased"))


def truecased(docs: DataFrame, model: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, text): the first word of each line in its most frequent casing, the others as they are; words that the model lacks stay. Null texts stay null."""
    lines = docs.select(doc_id, F.posexplode_outer(T.lines(text)).alias("at", "line"))
    lines = lines.withColumn("first", F.regexp_extract("line", T.TOKEN, 0))
    j = looked_up(lines.select(doc_id, "at", "line", "first", F.array(F.lower("first")).alias("items")), "items", model.withColumn("rank", F.length("lower")), "lower", "cased", "rank")
    new = F.when(F.get("found", F.lit(0)).isNotNull(), F.concat(F.expr("substring_index(line, first, 1)"), F.get("found", F.lit(0)), F.expr("substring(line, length(substring_index(line, first, 1)) + length(first) + 1)"))).otherwise(F.col("line"))
    j = j.select(doc_id, "at", F.when(F.col("first") == "", F.col("line")).otherwise(new).alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    return j.groupBy(doc_id).agg(F.when(F.count("line") > 0, whole).alias("text"))


def dev_blocks(src: DataFrame, ref: DataFrame, line_no: str, text: str) -> DataFrame:
    """Blocks of a source line, the mark of no tree, and its reference line."""
    r = ref.select(line_no, F.col(text).alias("ref"))
    return src.join(r, line_no).select(line_no, F.concat_ws("\n", F.col(text), F.lit("notree"), F.col("ref"), F.lit("========")).alias("block"))
