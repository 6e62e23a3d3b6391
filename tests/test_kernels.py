import random

import pytest

from lexigrid.operators import kernels as K


def links(s):
    return {tuple(map(int, x.split("-"))) for x in s.split()}


@pytest.mark.parametrize("rows, cols, ls, n", [(3, 3, "0-0 1-1 2-2", 6), (4, 4, "0-0 1-0 0-1 1-2 2-2 3-3", 3), (7, 5, "0-0 5-0 6-0 1-1 2-2 3-3 4-4", 10), (3, 2, "0-0 2-1", 5)])
def test_golden_counts(rows, cols, ls, n):
    spans = list(K.phrase_spans(rows, cols, links(ls), 5, 5))
    assert len(spans) == len(set(spans)) == n
    if n == 6:
        assert {K.orientation(x, rows, cols, links(ls)) for x in spans} == {("m", "n")}


def brute(rows, cols, ls, m, extend):
    out = set()
    for sc in range(rows):
        for ec in range(sc, min(rows, sc + m)):
            for se in range(cols):
                for ee in range(se, min(cols, se + m)):
                    inside = [(s, t) for s, t in ls if sc <= s <= ec and se <= t <= ee]
                    cross = any((sc <= s <= ec) != (se <= t <= ee) for s, t in ls)
                    ends = all(any(k == x[i] for x in inside) for k, i in ((sc, 0), (ec, 0), (se, 1), (ee, 1)))
                    if inside and not cross and (extend or ends):
                        out.add((sc, ec, se, ee))
    return out


@pytest.mark.parametrize("extend", [True, False])
def test_against_every_rectangle(extend):
    rng = random.Random(4)
    for _ in range(300):
        rows, cols = rng.randint(1, 6), rng.randint(1, 6)
        ls = {(rng.randrange(rows), rng.randrange(cols)) for _ in range(rng.randint(0, 7))}
        m = rng.randint(1, 6)
        assert set(K.phrase_spans(rows, cols, ls, m, m, extend)) == brute(rows, cols, ls, m, extend)


def test_symmetrisation():
    f, b = links("0-0 1-1"), links("0-0 1-0")
    assert K.grow_diag(f, b, final="") == [(0, 0), (1, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(200):
        a, c = ({(rng.randrange(5), rng.randrange(5)) for _ in range(5)} for _ in range(2))
        for final in ("", "and", "or"):
            got = set(K.grow_diag(a, c, final=final))
            assert a & c <= got <= a | c


def test_rules_are_consistent():
    got = K.rules("a b c".split(), "x y z".split(), links("0-0 1-1 2-2"))
    assert ("a # c", "x #1 z", "0-0 2-2") in got and ("# b #", "#1 y #2", "1-1") in got
    assert not any("# #" in lhs for lhs, _, _ in got)


def test_null_words_spans_and_schedule():
    assert K.null_words(3, 2, links("0-0 2-1")) == ([1], [])
    assert K.span_kind([-1, 0, 0, 1], 2, 3) == "none"
    assert K.span_kind([-1, 0, 0], 1, 2) == "floating"
    assert K.span_kind([-1, 0, 1], 1, 2) == "fixed"
    assert K.schedule("1*H*3*4") == [("1", 2), ("H", 2), ("3", 2), ("4", 1)]
    with pytest.raises(ValueError):
        K.schedule("X")
