import math

import pytest

from lexigrid.operators import language_model as L


@pytest.fixture(scope="module")
def counts(spark):
    return L.ngram_counts(L.sentences(spark.createDataFrame([("a b\na c\n\n",), (None,), ("",)], "text string")), 2)


def table(df):
    return {r.gram: r for r in df.collect()}


def test_golden(counts):
    assert {r.n: (r.types, r.tokens) for r in L.type_counts(counts).collect()} == {1: (5, 8), 2: (5, 6)}
    assert table(L.backoff_unigrams(counts))["a"].logp == pytest.approx(math.log10(2 / 5))
    assert table(L.backoff_unigrams(counts, "standard"))["a"].logp == pytest.approx(math.log10(2 / 8))
    assert table(L.backoff_ngrams(counts, 2))["a b"].logp == pytest.approx(math.log10(1 / 2))
    d = {r.n: r for r in L.discounts(counts).collect()}[2]
    s = {r.n: r for r in L.discounts(counts, "standard").collect()}[2]
    assert (d.d, d.d1, d.d2, d.d3) == pytest.approx((4 / 6, 2 / 3, -1 / 3, -1 / 3))
    assert (s.d1, s.d2, s.d3) == pytest.approx((2 / 3, 0, 1 / 3))
    assert table(L.interpolated(counts, 2)[2])["a b"].p == pytest.approx(0.433333, abs=1e-6)
    assert table(L.interpolated(counts, 2, variant="standard")[2])["a b"].p == pytest.approx(0.3)
    assert table(L.kneser_ney(counts, 2))["a"].bow == pytest.approx(math.log10(2 / 3))
    assert table(L.good_turing(counts.where("n = 2")))["a b"].logp == pytest.approx(-math.log10(6))
    assert table(L.good_turing(counts.where("n = 2"), "standard"))["a b"].logp == pytest.approx(math.log10(0.25) - math.log10(6))


def test_empty(spark):
    c = L.ngram_counts(L.sentences(spark.createDataFrame([], "text string")), 3)
    assert L.stupid_backoff(c, 3).count() == L.kneser_ney(c, 3).count() == L.good_turing(c).count() == 0


def test_standard_distribution_sums_to_one(spark):
    text = "\n".join(["a b c a b", "b c a", "c c b a", "a b b"] * 3)
    c = L.ngram_counts(L.sentences(spark.createDataFrame([(text,)], "text string")), 2)
    p = L.interpolated(c, 2, variant="standard")
    uni = {r.gram: r.p for r in p[1].collect()}
    assert sum(uni.values()) == pytest.approx(1)
