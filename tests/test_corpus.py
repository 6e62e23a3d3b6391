import pytest

from lexigrid.functions import text as T
from lexigrid.operators import corpus as C
from lexigrid.operators import translation as X
from lexigrid.sources import tables


def test_dictionary_ranks_over_many_partitions(spark):
    words = [(f"w{k:03}", 1000 // (k + 1)) for k in range(500)] + [("<s>", 9)]
    df = spark.createDataFrame(words, "word string, freq long").repartition(7)
    got = {r.word: r.id for r in C.ranked(df, ["<s>", "</s>"], 2).collect()}
    want = {w: i for i, (w, _) in enumerate(sorted(words[:-1], key=lambda x: (-x[1], x[0])), 2)} | {"<s>": 0, "</s>": 1}
    assert got == want


def test_lexicon_golden(spark):
    rows = [(1, ["x", "y"], ["X", "Y"], [(0, 0), (1, 1)]), (2, ["x", "z"], ["X", "Z"], [(0, 0)])]
    b = spark.createDataFrame(rows, f"row_id long, src array<string>, tgt array<string>, links array<{T.LINK}>")
    got = {(r.s, r.t): (r.c, r.p) for r in X.conditional(X.word_pairs(b), "s").collect()}
    assert got == {("x", "X"): (2, 1.0), ("y", "Y"): (1, 1.0), ("z", "<NULL>"): (1, 1.0), ("<NULL>", "Z"): (1, 1.0)}


def test_orientation_golden(spark):
    p = spark.createDataFrame([("a", "b", 1, 0, 0, 0, 1, 0)], "src string, tgt string, m int, s int, o int, t int, n int, p int")
    assert list(X.reorder_probs(p).collect()[0])[2:] == [0.5, 0.25, 0.25, 0.25, 0.5, 0.25]


def test_sources(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("x y\tX Y\t0-0 1-1\t-1 0\tNN VB\nx\tX\t0-0\nbroken\n\n")
    rows = tables.bitext_tsv(spark, str(tmp_path / "b.tsv")).collect()
    assert [(r.src, r.tgt, [tuple(x) for x in r.links], r.heads, r.pos) for r in rows] == [(["x", "y"], ["X", "Y"], [(0, 0), (1, 1)], [-1, 0], ["NN", "VB"]), (["x"], ["X"], [(0, 0)], None, None)]
    lines = tables.text_lines(spark, str(tmp_path / "b.tsv"))
    assert lines.count() == 3
    tables.write_text(lines, str(tmp_path / "gz"))
    assert spark.read.text(str(tmp_path / "gz")).count() == 3
    (tmp_path / "p.csv").write_text("Ann|3\nBob|\n")
    assert tables.csv_to_parquet(spark, str(tmp_path / "p.csv"), str(tmp_path / "pq"), "name string, age int").count() == 2


def test_rows_without_tokens_are_encoded_and_decoded(spark):
    docs = spark.createDataFrame([(1, "b a zz b"), (2, ""), (3, None), (4, "  ")], "doc_id long, text string")
    dic = spark.createDataFrame([("a", 3), ("b", 4)], "word string, id long")
    ids = C.encode(docs, dic, "doc_id", T.tokens("text"))
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: [4, 3, 0, 4], 2: [], 3: [], 4: []}
    assert {r.doc_id: r.text for r in C.decode(ids, dic, "doc_id").collect()} == {1: "b a b", 2: "", 3: "", 4: ""}


def test_documents_are_encoded_and_decoded(spark, tmp_path):
    from lexigrid.plans import registry

    spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.ids for r in registry.queries()["dict_encode_docs"](spark, str(tmp_path)).collect()} == {1: "3 4 3", 2: "", 3: ""}
    assert {r.doc_id: r.text for r in registry.queries()["dict_decode_docs"](spark, str(tmp_path)).collect()} == {1: "b a b", 2: "", 3: ""}


def test_words_beyond_the_head_are_joined(spark):
    docs = spark.createDataFrame([(1, "b a zz c b"), (1, "c"), (2, ""), (3, None)], "doc_id long, text string")
    dic = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "word string, id long")
    for head in (1, 2, 3, 9):
        ids = C.encode(docs, dic, "doc_id", T.tokens("text"), head=head)
        assert sorted((r.doc_id, r.ids) for r in ids.collect()) == [(1, [4, 3, 0, 5, 4]), (1, [5]), (2, []), (3, [])]
        assert sorted((r.doc_id, r.text) for r in C.decode(ids, dic, "doc_id", head=head).collect()) == [(1, "b a c b"), (1, "c"), (2, ""), (3, "")]


def test_shared_folder(spark):
    from lexigrid.functions import written as Wr

    class Session:
        def __init__(self, **kw):
            self.conf = self
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key, default)

    assert Wr.shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    with pytest.raises(ValueError):
        Wr.shared_dir(Session(**{"spark.master": "spark://host:7077"}))
    assert Wr.shared_dir(Session(**{"spark.master": "local[4]"}))
    assert Wr.written(spark.range(3), "t").count() == 3
