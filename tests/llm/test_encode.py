import random

import pytest

from lexigrid.llm import encode as E



def transducer(**kw):
    with open(E.VOCABULARY, "rb") as f:
        return E.BytePairTransducer(E.read_ranks(f.read()), **kw)


tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def judge():
    t = tokenizers.Tokenizer.from_file(E.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def texts():
    rng = random.Random(8)
    pool = [chr(c) for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF] + list("abcé 的了\n\t'") * 150
    out = ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(1500)]
    return [*out, "<|endoftext|>", " \n ", "a" * 9000, "ab" * 4000, " " * 5000, "=" * 5000, "的" * 4000, "".join(rng.choices("abcde", k=12_000)), "👍🏽 don't I'LL"]


def test_ids_and_round_trip(judge):
    t = transducer()
    for x in texts():
        ids = t.encode(x)
        assert ids == judge(x)
        assert "".join(t.decode(ids)) == x


def test_full_tables_start_anew(judge):
    t = transducer(max_states=40, max_pieces=5)
    for x in texts()[:200]:
        assert t.encode(x) == judge(x)


def test_broken_bytes_decode_to_the_replacement():
    t = transducer()
    assert "".join(t.decode([t.ranks[b"\xe7"]])) == "�"


def test_frame(spark, judge):
    rows = [(1, "a text", "i"), (2, "", "i"), (3, None, "i"), (None, " ", "i"), (1, "a text", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in E.encoded(df, "text", "doc_id").collect()), key=str)
    assert got == sorted([(1, judge("a text")), (2, []), (3, []), (None, judge(" ")), (1, judge("a text"))], key=str)
    assert E.encoded(df.limit(0), "text", "doc_id").count() == 0
    back = {r.doc_id: r.text for r in E.decoded(E.encoded(df, "text", "doc_id")).collect()}
    assert back == {1: "a text", 2: "", 3: "", None: " "}


def test_another_vocabulary(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = E.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    with open(path, "rb") as f:
        judge = tiktoken.Encoding("own", pat_str=E.PIECES, mergeable_ranks=E.read_ranks(f.read()), special_tokens={})
    rows = [(k, x) for k, x in enumerate(["El niño", "决议 草案", "Проект принят", "x " * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in E.encoded(df, "text", "doc_id", path).collect()} == {k: judge.encode_ordinary(x) for k, x in rows}


def test_pairs_that_stay_apart():
    t, rng = transducer(), random.Random(12)
    tokens = sorted(t.bytes_of)
    common = [t.ranks[x] for x in (b"a", b"e", b" t", b"he", b"ing", b" the", b"er", b"s", b"ed", b"\xc3", b"\xa9", b"  ", b"==") if x in t.ranks]
    for _ in range(20_000):
        a, b = (rng.choice(common if rng.random() < 0.5 else tokens) for _ in "ab")
        assert t._apart(a, b) == (t.merge(t.bytes_of[a] + t.bytes_of[b]) == [a, b])
