from collections import Counter

from lexigrid.operators import language_model as L
from lexigrid.streaming import incremental as I


def test_counts_as_in_one_batch(spark, tmp_path):
    schema = "text string"
    for k, t in enumerate(["a b\na c", "a b", "c\n\nb a"]):
        spark.createDataFrame([(t,)], schema).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = I.ngram_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("grams").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in" / "*"))
    rows = lambda df: Counter((r.n, r.gram, r.c) for r in df.collect())
    assert rows(spark.table("grams")) == rows(L.ngram_counts(L.sentences(batch), 2))


def test_lines_go_to_two_places(spark, tmp_path):
    good = "a ||| x ||| 0-0 ||| 3 |||  |||  |||  ||| 7 ||| 9"
    spark.createDataFrame([(1, good), (2, "x"), (3, None)], "line_id long, raw string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, raw string").parquet(str(tmp_path / "in"))
    I.load_lines(stream, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.line_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "no")).collect()) == ["column_count", "null_line"]
