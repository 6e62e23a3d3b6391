from itertools import product

import pytest

from lexigrid.functions import text as T
from lexigrid.operators import alignment as A
from lexigrid.operators import kernels as K
from lexigrid.operators import translation as X

ROWS = [(1, ["a", "b"], ["x", "y"]), (2, ["a"], ["x"]), (3, ["b", "a"], ["y", "x"]), (4, ["a", "b"], ["x", "y"]), (5, ["c", "a", "b"], ["z", "x", "y"])]


@pytest.fixture(scope="module")
def bitext(spark):
    return spark.createDataFrame([(*r, [(0, 0)]) for r in ROWS], f"row_id long, src array<string>, tgt array<string>, links array<{T.LINK}>")


def table(df):
    return {(r.s, r.t): r.p for r in df.collect()}


def test_hidden_markov_model_against_all_alignments(bitext):
    words = {(s, t) for _, a, b in ROWS for s in a for t in b}
    t, longest = {x: 1 / 3 for x in words}, 3
    g = {d: 1 / 5 for d in range(-2, 3)}
    for _ in range(2):
        c, e = {}, {}
        for _, a, b in ROWS:
            ways = []
            for way in product(range(len(a)), repeat=len(b)):
                w = t.get((a[way[0]], b[0]), 0) / len(a)
                for k in range(1, len(b)):
                    norm = sum(g.get(i - way[k - 1], 0) for i in range(len(a)))
                    w *= g.get(way[k] - way[k - 1], 0) / norm * t.get((a[way[k]], b[k]), 0)
                ways.append((way, w))
            every = sum(w for _, w in ways)
            for way, w in ways:
                for k, i in enumerate(way):
                    c[a[i], b[k]] = c.get((a[i], b[k]), 0) + w / every
                    if k:
                        e[i - way[k - 1]] = e.get(i - way[k - 1], 0) + w / every
        t = {x: v / sum(u for y, u in c.items() if y[0] == x[0]) for x, v in c.items()}
        g = {d: v / sum(e.values()) for d, v in e.items()}
    words_, jumps = A.hmm(bitext, 2)
    assert table(words_) == pytest.approx({k: v for k, v in t.items() if v > 0}, abs=1e-9)
    assert {r.d: r.p for r in jumps.collect()} == pytest.approx(g, abs=1e-9)
    assert longest == 3


def test_schedule_links_and_symmetry(bitext):
    t = A.trained(bitext, "1****2*H*")
    assert sum(table(t)[k] for k in table(t) if k[0] == "a") == pytest.approx(1)
    assert table(t)["a", "x"] > 0.9
    ibm1 = A.ibm1(bitext, 8)
    p = {k: round(v, 9) for k, v in table(ibm1).items()}
    links = {(r.row_id, r.j): r.i for r in A.best_links(bitext, ibm1).collect()}
    best = {(k, j): max(range(len(a) + 1), key=lambda i: (p[([X.NULL, *a])[i], y], -i)) - 1 for k, a, b in ROWS for j, y in enumerate(b)}
    assert links == {k: i for k, i in best.items() if i >= 0}
    got = {r.row_id: r.align for r in A.aligned(bitext, "H****", "intersect").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(set(v.split()) <= {f"{i}-{j}" for i in range(3) for j in range(3)} for v in got.values())
    with pytest.raises(ValueError):
        A.trained(bitext, "1*4*")
    with pytest.raises(ValueError):
        X.symmetrised(bitext, "grown")


def test_modes(spark):
    rows = [(1, [(0, 0), (1, 1)], [(0, 0), (1, 0)]), (2, None, [(1, 1)])]
    df = spark.createDataFrame(rows, f"row_id long, forward array<{T.LINK}>, backward array<{T.LINK}>")
    one = lambda m: {r.row_id: r.align for r in X.symmetrised(df, m).collect()}
    assert one("intersect") == {1: "0-0", 2: ""} and one("union") == {1: "0-0 1-0 1-1", 2: "1-1"}
    assert one("srctotgt") == {1: "0-0 1-1", 2: ""} and one("tgttosrc") == {1: "0-0 1-0", 2: "1-1"}


def test_span_syntax():
    heads = [1, -1, 1, 2]  # the second word is the root
    assert K.span_syntax(heads, 0, 3) == ("fixed", 0, 1)
    assert K.span_syntax(heads, 0, 0) == ("fixed", 0, 0)
    assert K.span_syntax(heads, 2, 2) == ("fixed", 0, 2) and K.span_syntax(heads, 1, 2)[:2] == ("fixed", 1)
    flat = [3, 3, 3, -1, 3]
    assert K.span_syntax(flat, 0, 1) == ("leftFloating", 1, 3) and K.span_syntax(flat, 0, 1, "relaxed") == ("leftFloating", 0, 3)
    assert K.span_syntax([-1, 0, 0], 1, 2, "any") == ("rightFloating", 0, 0)
    assert K.syntax_text(heads, 1, 3) == "fixed\t0\t-1 0 1"
    assert K.head_tag(heads, ["A", "B", "C", "D"], 0, 3) == "B" and K.head_tag(flat, list("abcde"), 0, 1) == "X" and K.head_tag(flat, list("abcde"), 0, 1, "any", True) == "d"


def test_rule_syntax():
    links = {(0, 0), (1, 1), (2, 2)}
    cases = list(K.rule_cases(["a", "b", "c"], ["x", "y", "z"], links, max_slots=1))
    r = next(x for x in cases if x.lhs == "a # c")
    assert (r.rhs, r.align, r.inverse, r.slots) == ("x #1 z", "0-0 2-2", "0-0 2-2", ((1, 1, 1, 1),))
    assert K.rule_syntax([1, -1, 1], r) == "fixed\t0\t1 -1 1" and K.rule_tags([1, -1, 1], ["A", "B", "C"], r) == "B;B"
    assert {x[:3] for x in cases} == K.rules(["a", "b", "c"], ["x", "y", "z"], links, max_slots=1)


def test_classes_end(spark):
    from lexigrid.operators import corpus as C

    s = spark.createDataFrame([(x.split(),) for x in ["the cat sat", "a dog ran", "the dog sat", "a cat ran"] * 5], "tokens array<string>")
    freq = s.selectExpr("explode(tokens) as word").groupBy("word").count().withColumnRenamed("count", "freq")
    first = A.first_classes(C.ranked(freq, [], 1), 3)
    bi = A.bigrams(s)
    value = lambda c: sum(r.value for r in A.likelihood_parts(A.class_bigrams(bi, c), c).collect())
    done = A.exchanged(bi, first, 3, 6)
    assert done.count() == 6 and value(done) >= value(first)
