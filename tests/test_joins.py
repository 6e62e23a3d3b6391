from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import joins as J


@pytest.fixture(scope="module")
def sides(spark):
    left = [(1, i) for i in range(900)] + [(k, k) for k in range(40)] + [(None, 7)] * 3
    right = [(1, -i) for i in range(210)] + [(k, -k) for k in range(20, 60)] + [(None, 8)]
    return spark.createDataFrame(left, "k long, a long"), spark.createDataFrame(right, "k long, b long")


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("name", ["block", "lean"])
def test_equal_to_plain_join(sides, how, name):
    a, b = sides
    j = J.block_join(a, b, "k", 3, 2, how) if name == "block" else J.lean_join(a, b, "k", 4, how=how)
    rows = lambda df: Counter((r.k, r.a, r.b) for r in df.select("k", "a", "b").collect())
    assert rows(j) == rows(a.join(b, "k", how))


def test_policies(spark, sides):
    a, b = sides
    n = spark.createDataFrame([(1000, 50), (10, 10)], "l long, r long")
    assert [tuple(r) for r in n.select(J.replication(n.r, 4), J.replication(n.l, 4)).collect()] == [(1, 4), (1, 1)]
    assert J.broadcast_join(a, b, "k", limit=10).count() == J.broadcast_join(a, b, "k").count() == a.join(b, "k").count()
    assert J.lean_join(a.limit(0), b, "k").count() == 0


def test_bloom_join_and_filter(spark, sides):
    a, b = sides
    rows = lambda df: Counter((r.k, r.a, r.b) for r in df.select("k", "a", "b").collect())
    for expected in (1, 1000):
        assert rows(J.bloom_join(a, b, "k", expected)) == rows(a.join(b, "k"))
    words = J.bloom_filter(b, "k", 41, 0.01).scalar()
    far = spark.range(1000, 11000)
    assert far.where(J.might_contain(words, F.col("id"), 41, 0.01)).count() < 300
    assert b.where("k is not null").where(~J.might_contain(words, F.col("k"), 41, 0.01)).count() == 0
    assert J.bloom_join(a, b.limit(0), "k", 10).count() == 0


def test_cogroup_cuts_large_keys(spark, sides):
    a, b = sides
    got = J.cogroup(a, b, "k", "a", "b", most=100).collect()
    assert sum(r.key == 1 for r in got) > 5 and max(len(r.lefts) + len(r.rights) for r in got) < 250
    assert sorted(x for r in got if r.key == 1 for x in r.lefts) == sorted([*range(900), 1])
    assert sorted(x for r in got if r.key == 1 for x in r.rights) == sorted(-i for i in range(210))
    assert {r.key for r in got} == set(range(60))


def test_no_task_gets_most_of_a_hot_key(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(2000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = J.lean_join(left, right, "k", 32)
        sizes = [r["count"] for r in j.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == left.join(right, "k").count()
        assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_broadcast_is_by_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 100_000).alias("w"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(J.broadcast_join(spark.range(5), wide, "id"))
    assert "broadcast" not in plan(J.broadcast_join(spark.range(5), wide, "id", limit_bytes=1000))
