"""Trees of dependency heads (one head a word, -1 for the root) by column expressions, and their text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def children(heads: Column | str, word: Column | str) -> Column:
    """Places that hang on a word."""
    h = F.col(heads) if isinstance(heads, str) else heads
    w = F.col(word) if isinstance(word, str) else word
    return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: F.get(h, k) == w)


def path_to_root(heads: str, word: str, longest: int = 64) -> Column:
    """Places from a word up to its root, the word first; ends after ``longest`` steps in a graph that isn't a tree."""
    step = F.reduce(F.sequence(F.lit(1), F.lit(longest)), F.array(F.col(word).cast("int")), lambda path, _: F.when(F.get(heads, F.element_at(path, -1)) >= 0, F.concat(path, F.array(F.get(heads, F.element_at(path, -1))))).otherwise(path))
    return step


def subtree(df: DataFrame, keys: list[str], heads: str) -> DataFrame:
    """(keys, word, yield): for each word all places whose path to the root leads over it, in order."""
    t = df.select(*keys, heads, F.explode(F.sequence(F.lit(0), F.size(heads) - 1)).alias("k"))
    t = t.select(*keys, "k", F.explode(path_to_root(heads, "k")).alias("word"))
    return t.groupBy(*keys, "word").agg(F.array_sort(F.collect_set("k")).alias("yield"))


def span_heads(heads: str, start: str, end: str) -> Column:
    """Places of a span whose head lies outside; the head of a phrase where it is one place."""
    return F.expr(f"filter(sequence({start}, {end}), k -> {heads}[k] < {start} or {heads}[k] > {end})")


def from_mst(text: Column) -> Column:
    """(at, token, tag, label, head) of the four tab-separated lines of a sentence: words, tags, labels, heads from 1 with 0 for the root."""
    f = F.transform(F.split(text, "\n"), lambda x: F.split(x, "\t"))
    return F.transform(f[0], lambda w, i: F.struct(i.cast("int").alias("at"), w.alias("token"), F.get(f[1], i).alias("tag"), F.get(f[2], i).alias("label"), (F.get(f[3], i).try_cast("int") - 1).alias("head")))


def from_stanford(text: Column) -> Column:
    """(label, head, word), places from 0 and -1 for the root, of ``label(head-3, word-1)`` lines; others are left out."""
    shape = r"^([^(]+)\(.*-(\d+)'*, .*-(\d+)'*\)$"
    part = lambda x, k: F.regexp_extract(x, shape, k)
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(shape)), lambda x: F.struct(part(x, 1).alias("label"), (part(x, 2).cast("int") - 1).alias("head"), (part(x, 3).cast("int") - 1).alias("word")))
