"""Where models lie, and their text forms: language models by order, phrase and rule tables, dictionaries; written, and read again as typed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import language_model as L
from lexigrid.sources.tables import write_text


@dataclass(frozen=True)
class Layout:
    """Names of what lies below a root folder."""

    root: str

    def corpus(self) -> str:
        return f"{self.root}/dCorpus"

    def dictionary(self, name: str) -> str:
        return f"{self.root}/dict/{name}.idMap"

    def language_model(self, kind: str) -> str:
        if kind not in ("gt", "gsb", "kn", "mkn"):
            raise ValueError(f"no model {kind}")
        return f"{self.root}/{kind}"

    def classes(self, side: str, iteration: int) -> str:
        return f"{self.root}/mkcls/{side}/it{iteration:03d}"

    def phrases(self) -> str:
        return f"{self.root}/phrase"

    def rules(self) -> str:
        return f"{self.root}/rule"

    def counts_of_counts(self) -> str:
        return f"{self.root}/GTPath"


def write_language_model(table: DataFrame, path: str, codec: str = "gzip") -> None:
    """A folder for each order (n=1, n=2, ...) with lines of log probability, gram and, where there is one, weight, tabs between."""
    L.arpa(table).withColumnRenamed("line", "value").write.mode("overwrite").partitionBy("n").option("compression", codec).text(path)


def read_language_model(spark: SparkSession, path: str) -> DataFrame:
    """(n, gram, logp, bow) as written."""
    f = F.split("value", "\t", -1)
    return spark.read.text(path).select(F.col("n").cast("int").alias("n"), f[1].alias("gram"), f[0].try_cast("double").alias("logp"), F.get(f, F.lit(2)).try_cast("double").alias("bow"))


def table_lines(table: DataFrame, keys: list[str], scores: list[str], extra: list[str] = ()) -> DataFrame:
    """(value): ``src ||| tgt ||| scores [||| more]`` lines; the separator within a text is escaped."""
    text = [T.escape_reserved(F.coalesce(k, F.lit(""))) for k in [*keys]]
    numbers = F.concat_ws(" ", *(F.format_string("%.6g", F.col(c).cast("double")) for c in scores))
    return table.select(F.concat_ws(T.RESERVED, *text, numbers, *(T.escape_reserved(F.coalesce(c, F.lit(""))) for c in extra)).alias("value"))


def write_table(table: DataFrame, path: str, keys: list[str], scores: list[str], extra: list[str] = (), parts: int = 0, codec: str = "gzip") -> None:
    """Phrase or rule table as text, in ``parts`` files where that is wanted."""
    lines = table_lines(table, keys, scores, extra)
    write_text(lines.repartition(parts) if parts else lines, path, codec)


def read_table(spark: SparkSession, path: str, keys: list[str], scores: list[str], extra: list[str] = ()) -> DataFrame:
    """Typed columns of a table's lines; lines of another number of fields or scores are left out."""
    f = F.split("value", r" \|\|\| ", -1)
    n = F.split(f[len(keys)], " ")
    rows = spark.read.text(path).where((F.size(f) == len(keys) + 1 + len(extra)) & (F.size(n) == len(scores)))
    return rows.select(*(f[k].alias(c) for k, c in enumerate(keys)), *(n[k].cast("double").alias(c) for k, c in enumerate(scores)), *(f[len(keys) + 1 + k].alias(c) for k, c in enumerate(extra)))


def write_dictionary(dictionary: DataFrame, path: str, codec: str = "none") -> None:
    """``word id`` lines in the order of ids: range partitions, sorted within, so that the files by name (see files.merged) are in order as a whole without one task that sorts all."""
    lines = dictionary.repartitionByRange("id").sortWithinPartitions("id").select(F.concat_ws(" ", "word", F.col("id").cast("string")).alias("value"))
    write_text(lines, path, codec)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, id)"""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("word"), F.regexp_extract("value", r"^(.*) (\d+)$", 2).cast("bigint").alias("id"))
