import random
from collections import Counter

import numpy as np
import pytest

from lexigrid.llm import together as T


def test_popcounts_with_weights_of_either_sign():
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 64, 3000), rng.integers(0, 5, 3000), rng.integers(-900, 2**40, 3000)
    want = np.zeros((64, 64), dtype=np.int64)
    np.add.at(want, (a, b), w)
    assert (T.dense_counts(a, b, w) == want).all()


def test_against_counters(spark):
    rng = random.Random(2)
    pick = lambda x: rng.choice(["hot"] * 3 + ["warm"] + [f"{x}{rng.randrange(200)}"] * 4 + ["", None])
    rows = [(pick("a"), pick("b"), rng.choice([1, 2, 50, 0, None]), "z") for _ in range(6000)]
    rows += rows[:50] + [("x" * 50_000, "hot", 40)] and [(*r[:3], "z") for r in rows[:50]] + [("x" * 50_000, "hot", 40, "z")]
    s, ta, tb = Counter(), Counter(), Counter()
    for a, b, w, _ in rows:
        if None not in (a, b, w):
            s[a, b] += w
            ta[a] += w
            tb[b] += w
    total = sum(s.values())
    df = spark.createDataFrame(rows, "p string, q string, n long, code_a string").repartition(3)
    got = {(r.a, r.b): (r.s, r.total_a, r.total_b) for r in T.pair_counts(df, "p", "q", "n", 0).collect()}
    assert got == {k: (v, ta[k[0]], tb[k[1]]) for k, v in s.items()}
    lifted = {(r.a, r.b): r.lift for r in T.lift(df, "p", "q", "n", 30, 2).collect()}
    assert set(lifted) == {k for k, v in s.items() if v >= 30 and v * total >= 2 * ta[k[0]] * tb[k[1]]}
    assert all(x == pytest.approx(s[k] * total / ta[k[0]] / tb[k[1]]) for k, x in lifted.items())
    assert T.lift(df.limit(0), "p", "q", "n").count() == 0


def test_every_pair_has_counts_and_lift(spark):
    rows = [("hot", "top", 5), ("hot", "top", -5), ("hot", "b", 2), ("a", "top", -3), ("a", "b", 0), ("c", "d", 90), ("none", "nil", 0)] + [(f"x{k}", f"y{k}", 1) for k in range(300)]
    df = spark.createDataFrame(rows, "p string, q string, n long").repartition(3)
    want = {k: sum(n for p, q, n in rows if (p, q) == k) for k in {r[:2] for r in rows}}
    assert {(r.a, r.b): r.s for r in T.pair_counts(df, "p", "q", "n").collect()} == want
    got = {(r.a, r.b): (r.s, r.lift) for r in T.lift(df, "p", "q", "n").collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["none", "nil"][1] is None and got["x7", "y7"][1] == pytest.approx(sum(r[2] for r in rows))


def test_query_of_every_pair(spark, tmp_path):
    from lexigrid.llm.queries import QUERIES

    rows = [(1, "a", "b", 3), (2, "a", "c", 40), (3, "d", "b", 1), (4, None, "b", 9)]
    spark.createDataFrame(rows, "row_id long, phrasec string, phrasee string, countpair long").write.parquet(str(tmp_path / "phrase_combinete.parquet"))
    assert {(r.phrasec, r.phrasee): (r.s, r.total_a, r.total_b) for r in QUERIES["p3_pairs"](spark, str(tmp_path)).collect()} == {("a", "b"): (3, 43, 4), ("a", "c"): (40, 43, 40), ("d", "b"): (1, 1, 4)}
