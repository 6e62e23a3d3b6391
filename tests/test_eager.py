from collections import Counter

from lexigrid.operators import eager


def test_states_join_and_hot_keys(spark):
    rows = [("hot", i) for i in range(400)] + [(f"k{i % 50}", i) for i in range(300)] + [(None, 1)] * 30 + [("nulls", None)] * 3 + [("", 5)]
    left = spark.createDataFrame([(k, v, "x") for k, v in rows], "key string, n long, total string")
    right = spark.createDataFrame([("hot", 2), ("hot", 3), ("k1", None), (None, 9)], "key string, v long")
    want = Counter(k for k, _ in rows if k is not None)
    assert {r.key: r.n for r in eager.key_states(left, "key", "n").collect()} == want
    assert {r.key: r.total for r in eager.key_states(left, "key", "n").collect()}["nulls"] is None
    got = {r.key: (r.join_rows, r.left_sum, r.right_sum) for r in eager.eager_join(left, right, "key", "n", "v").collect()}
    assert got == {"hot": (800, 2 * sum(range(400)), 400 * 5), "k1": (6, sum(i for i in range(300) if i % 50 == 1), None)}
    total = sum(want.values())
    hot = {(r.field_name, r.hot_key) for r in eager.hot_keys({"f": (left, "key"), "g": (right, "key")}).collect()}
    assert hot == {("f", k) for k, n in want.items() if n * 50 >= total} | {("g", "hot"), ("g", "k1")}
    assert eager.hot_keys({"f": (left.limit(0), "key")}).count() == 0
    assert eager.eager_join(left.limit(0), right, "key", "n", "v").count() == 0


def test_integer_keys_as_text(spark):
    df = spark.createDataFrame([(-3,), (2**62,), (0,), (None,)], "k long")
    assert {r.hot_key for r in eager.hot_keys({"x": (df, "k")}).collect()} == {"-3", str(2**62), "0"}
