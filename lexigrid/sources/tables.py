"""Readers and sinks. Schemas are explicit; nothing is inferred from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def at_least(df: DataFrame, parts: int) -> DataFrame:
    """A scan in at least so many partitions, as text readers take a minimum: few files that can't be split are dealt out once; a scan with enough splits isn't moved."""
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def table(spark: SparkSession, root: str, name: str, parts: int = 0) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a folder), in at least ``parts`` partitions. Whoever reads few of its columns gets only these from storage."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return at_least(df, parts) if parts else df


def text_lines(spark: SparkSession, path: str, parts: int = 0) -> DataFrame:
    """Non-empty lines of text files, or of every part file of a folder, in at least ``parts`` partitions."""
    lines = spark.read.text(path)
    return (at_least(lines, parts) if parts else lines).where(F.length("value") > 0)


def _bitext(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    toks = lambda i: F.filter(F.split(F.trim(F.coalesce(F.get(f, F.lit(i)), F.lit(""))), r"\s+"), lambda x: x != "")
    sound = lambda c, shape: ~F.exists(c, lambda x: ~x.rlike(shape))
    reason = F.when(F.size(f) < 3, "fields").when(~sound(toks(2), r"^\d{1,9}-\d{1,9}$"), "links").when((F.size(f) >= 5) & ~sound(toks(3), r"^-?\d{1,9}$"), "heads")
    return spark.read.text(path).select(
        "value",
        reason.alias("reason"),
        toks(0).alias("src"),
        toks(1).alias("tgt"),
        F.transform(toks(2), lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).try_cast("int").alias("s"), F.split_part(x, F.lit("-"), F.lit(2)).try_cast("int").alias("t"))).alias("links"),
        F.when(F.size(f) >= 5, F.transform(toks(3), lambda x: x.try_cast("int"))).alias("heads"),
        F.when(F.size(f) >= 5, toks(4)).alias("pos"),
    )


def bitext_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Aligned bitext with three or five tab-separated fields as typed columns.

    Rows of fewer than three fields or with links or heads that aren't numbers are left out, see ``bitext_rejects``; heads and tags are null in three-field rows.
    """
    return _bitext(spark, path).where("reason is null").drop("value", "reason")


def bitext_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(value, reason): the rows that ``bitext_tsv`` leaves out; reason is fields, links or heads."""
    return _bitext(spark, path).where("reason is not null").select("value", "reason")


def write_text(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """Single string column to compressed text, replacing what stands there."""
    df.write.mode("overwrite").option("compression", codec).text(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: str, sep: str = "|") -> DataFrame:
    """Delimited text to Parquet under a given schema."""
    spark.read.schema(schema).option("sep", sep).csv(src).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)

