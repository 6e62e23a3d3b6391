import sys

import pytest
from pyspark.sql import functions as F

from lexigrid import config
from lexigrid.functions import text as T
from lexigrid.sources import files, models, tables


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2", "lz4", "snappy"])
def test_codecs(spark, tmp_path, codec):
    lines = spark.createDataFrame([("é a",), ("b",)], "value string")
    path = str(tmp_path / codec)
    try:
        tables.write_text(lines, path, codec)
    except Exception as e:  # noqa: BLE001
        if codec in ("lz4", "snappy") and "native" in str(e).lower():
            pytest.skip("no native codec here")
        raise
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["b", "é a"]
    tables.write_text(lines.limit(1), path, codec)
    assert spark.read.text(path).count() == 1


def test_language_model_is_read_as_written(spark, tmp_path):
    rows = [(1, "a", -0.5, -0.25), (1, "<s>", 0.0, 0.0), (2, "a b", -1.5, None), (2, "a c", None, None)]
    df = spark.createDataFrame(rows, "n int, gram string, logp double, bow double")
    path = models.Layout(str(tmp_path)).language_model("kn")
    models.write_language_model(df, path)
    assert sorted(map(tuple, models.read_language_model(spark, path).collect()), key=str) == sorted(rows, key=str)
    assert models.Layout("r").classes("src", 3) == "r/mkcls/src/it003"
    with pytest.raises(ValueError):
        models.Layout("r").language_model("x")


def test_phrase_table_is_read_as_written(spark, tmp_path):
    rows = [("a b", "x", 0.5, 0.25, "1.0000 fixed\t0\t-1", "NN"), ("c ||| d", "y", 1.0, 0.125, "", "X")]
    df = spark.createDataFrame(rows, "src string, tgt string, phi double, lex double, syntax string, tags string")
    cols = (["src", "tgt"], ["phi", "lex"], ["syntax", "tags"])
    models.write_table(df, str(tmp_path / "t"), *cols, parts=3)
    got = sorted(map(tuple, models.read_table(spark, str(tmp_path / "t"), *cols).collect()))
    assert got == sorted([rows[0], ("c" + T.REPLACED + "d", *rows[1][1:])])


def test_dictionary_as_one_ordered_file(spark, tmp_path):
    d = spark.range(500).select(F.concat(F.lit("w "), "id").alias("word"), "id").repartition(5)
    models.write_dictionary(d, str(tmp_path / "dict"))
    files.merged(spark, str(tmp_path / "dict"), str(tmp_path / "one.txt"))
    assert (tmp_path / "one.txt").read_text().splitlines() == [f"w {k} {k}" for k in range(500)]
    assert {(r.word, r.id) for r in models.read_dictionary(spark, str(tmp_path / "dict")).collect()} == {(f"w {k}", k) for k in range(500)}
    lines = files.ordered_lines(spark, str(tmp_path / "dict"))
    assert [r.value for r in lines.orderBy("file", "at").collect()] == [f"w {k} {k}" for k in range(500)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("12345")
    (tmp_path / "a" / "_SUCCESS").write_text("")
    assert files.size(spark, str(tmp_path / "a")) == 5 and [n for _, n in files.listed(spark, str(tmp_path / "a"))] == [5]
    files.copied(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert files.exists(spark, str(tmp_path / "b" / "x"))
    files.require(spark, [str(tmp_path / "b")], [str(tmp_path / "c")])
    with pytest.raises(FileNotFoundError):
        files.require(spark, [str(tmp_path / "c")])
    with pytest.raises(FileExistsError):
        files.require(spark, [], [str(tmp_path / "b")])
    assert files.deleted(spark, str(tmp_path / "b")) and not files.deleted(spark, str(tmp_path / "b"))


def test_external_programs(spark):
    lines = spark.createDataFrame([("b",), ("a",), (None,), ("é",)], "value string").repartition(2)
    echo = [sys.executable, "-c", "import sys\nfor x in sys.stdin: print(x.strip() + '!')"]
    assert sorted(r.value for r in files.piped(lines, echo).collect()) == ["a!", "b!", "é!"]
    with pytest.raises(Exception, match="ended with 3"):
        files.piped(lines, [sys.executable, "-c", "import sys; sys.stdin.read(); sys.exit(3)"]).collect()
    done = files.fan_out(spark, ["x", "y", "z"], lambda t: t * 2)
    assert sorted(map(tuple, done.collect())) == [("x", "xx"), ("y", "yy"), ("z", "zz")]
    assert files.fan_out(spark, [], str).count() == 0


CONF = """
// settings
mt { inputDir = "in # not a comment", optType = ${ExtractType.Rule}
  maxSpan = 7
  allowConsecutive = true   # a comment
  constrainedType = Relaxed }
lm.N = 3
lm { KN = true
  GSB = false }
wam { trainSeq = "1*2*" }
other { x { y : 1 } }
"""


def test_settings():
    s = config.loaded(CONF)
    assert s.mt.inputDir == "in # not a comment" and s.mt.optType is config.Extract.Rule and s.mt.constrainedType is config.Constraint.Relaxed
    assert s.mt.limits()["max_span"] == 7 and s.mt.limits()["consecutive"] and s.lm.kinds() == ["kn"] and s.lm.N == 3 and s.wam.trainSeq == "1*2*"
    assert config.loaded("").mt.limits() == {"max_c": 5, "max_e": 5, "extend": True}
    assert "mt.optType = Rule" in s.shown()
    for bad in ("mt { maxc = x }", "mt { optType = Tree }", "mt {", "}", "lm { KN = perhaps }"):
        with pytest.raises(ValueError):
            config.loaded(bad)
    smooth = config.loaded("mt { allowSmoothing = true, allowKN = true }").mt
    assert smooth.smoothing() == "kn" and config.Translation().smoothing() == "none"


def test_rows_left_out_have_a_reason(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("x\tX\t0-0\nx\tX\nx\tX\t0:0\nx\tX\t0-0\ta\tN\n\nx\tX\t\n")
    assert sorted(r.reason for r in tables.bitext_rejects(spark, str(tmp_path / "b.tsv")).collect()) == ["fields", "fields", "heads", "links"]
    assert sorted(len(r.links) for r in tables.bitext_tsv(spark, str(tmp_path / "b.tsv")).collect()) == [0, 1]
