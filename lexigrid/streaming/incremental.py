"""The same operators over streams: counts add up, so each micro-batch only adds to what stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrid.functions import text as T
from lexigrid.operators import bulk_parse


def ngram_counts(stream: DataFrame, high: int, text: str = "text") -> DataFrame:
    """(n, gram, c) of all lines so far; write it in update or complete mode."""
    w = stream.select(F.explode(T.lines(text)).alias("line")).where(F.length("line") > 0).select(T.wrap(T.tokens("line")).alias("w"))
    g = w.select(F.explode(T.ngrams("w", 1, high)).alias("g"))
    return g.groupBy(F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("c"))


def windowed_terms(stream: DataFrame, text: str, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, word, c) by windows of event time; rows later than ``late`` drop out with their window's state."""
    w = stream.withWatermark(time, late).select(F.col(time).alias("at"), F.explode(T.tokens(text)).alias("word"))
    return w.groupBy(F.window("at", width).alias("w"), "word").agg(F.count(F.lit(1)).alias("c")).select(F.col("w.start").alias("start"), "word", "c")


def load_lines(stream: DataFrame, loaded: str, refused: str, checkpoint: str, raw: str = "raw", id_col: str = "line_id") -> StreamingQuery:
    """Phrase lines as they arrive, sound ones to one Parquet folder and the rest with its reasons to another, each micro-batch parsed once."""

    def both(batch: DataFrame, number: int) -> None:
        rows = bulk_parse.parse_lines(batch, raw, id_col).persist()
        try:
            rows.where("reason is null").drop("reason", "detail").write.mode("overwrite").parquet(f"{loaded}/batch={number}")
            rows.where("reason is not null").select(id_col, "reason", "detail").write.mode("overwrite").parquet(f"{refused}/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
