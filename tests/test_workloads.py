from lexigrid import config
from lexigrid.plans import workloads as W
from lexigrid.sources import models, tables

BITEXT = ["x y\tX Y\t0-0 1-1\t1 -1\tN V", "x z\tX Z\t0-0 1-1\t1 -1\tN V", "x y z\tX Y Z\t0-0 1-1 2-2\t1 -1 1\tN V N", "x\tX\t0-0", "broken"] * 3


def test_language_models_from_file_to_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a b\na c\n\na b a\n")
    s = config.loaded(f'lm {{ lmInputFileName = "{tmp_path}/in.txt", lmRootDir = "{tmp_path}/lm", N = 3, GT = true, KN = true, MKN = true }}')
    done = W.language_models(spark, s)
    assert set(done) == {"gt", "gsb", "kn", "mkn", "dictionary"}
    kn = models.read_language_model(spark, done["kn"])
    assert {r.n for r in kn.collect()} == {1, 2, 3} and kn.where("gram = 'a b'").count() == 1
    assert {r.word: r.id for r in models.read_dictionary(spark, done["dictionary"]).collect()} == {"<s>": 0, "</s>": 1, "unk": 2, "a": 3, "b": 4, "c": 5}


def test_tables_by_mode(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("\n".join(BITEXT))
    conf = f'mt {{ inputDir = "{tmp_path}/b.tsv", rootDir = "{tmp_path}/out", %s }}'
    cols = (["src", "tgt"], ["phi_rev", "lex_rev", "phi", "lex", "penalty"])
    plain = {(r.src, r.tgt): r for r in models.read_table(spark, W.translation(spark, config.loaded(conf % "maxc = 2, maxe = 2")), *cols).collect()}
    assert plain["x y", "X Y"].phi == 1.0 and plain["x", "X"].lex == 1.0 and ("x y z", "X Y Z") not in plain
    syntax = models.read_table(spark, W.translation(spark, config.loaded(conf % "withSyntaxInfo = true, allowSmoothing = true, allowKN = true")), *cols, ["syntax", "tags"]).collect()
    assert {(r.src, r.tags) for r in syntax} >= {("x", "N"), ("x y", "V")} and all("fixed" in r.syntax or "other" in r.syntax or "Floating" in r.syntax for r in syntax)
    rules = models.read_table(spark, W.translation(spark, config.loaded(conf % "optType = Rule, direction = E2C")), ["lhs", "rhs"], ["f1", "f2", "f3", "f4", "penalty", "rarity"]).collect()
    assert {(r.lhs, r.rhs) for r in rules} >= {("X", "x"), ("X #1 Z", "x # z")}


def test_alignment_from_two_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "part-0").write_text("a b\nb a\n")
    (tmp_path / "s" / "part-1").write_text("a\nlong long long long\n\n")
    (tmp_path / "t.txt").write_text("x y\ny x\nx\nq\nr\nmore\n")
    s = config.loaded(f'wam {{ source = "{tmp_path}/s", target = "{tmp_path}/t.txt", alignedRoot = "{tmp_path}/w", maxSentLen = 3, trainSeq = "H**", symalmethod = "intersect" }}')
    rows = tables.bitext_tsv(spark, W.alignment(spark, s)).collect()
    assert sorted((r.src, r.tgt) for r in rows) == [(["a"], ["x"]), (["a", "b"], ["x", "y"]), (["b", "a"], ["y", "x"])]
    assert [(x.s, x.t) for r in rows if r.src == ["b", "a"] for x in r.links] == [(0, 0), (1, 1)]
