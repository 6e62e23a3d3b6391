import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import seen_before as S


def test_chain_grows_within_its_bound():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 60_000)
    chain = S.Chain(capacity=256, error=0.01)
    for part in np.array_split(keys, 30):
        chain.add(part)
    assert len(chain.layers) > 5 and all(x.used <= x.capacity for x in chain.layers)
    assert chain.has(keys).all()
    other = rng.integers(-(2**63), 2**63 - 1, 100_000)
    assert chain.has(other).mean() <= chain.bound() < 0.02
    assert 0.2 < np.bitwise_count(chain.layers[0].words).sum() / chain.layers[0].bits < 0.55


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    ids = [7] * 2000 + [rng.randrange(-3000, 3000) for _ in range(4000)] + [None] * 50 + [0, 2**63 - 1, -(2**63), 2**63 - 1]
    rng.shuffle(ids)
    return [(i, x, 1, "k") for i, x in enumerate(ids, 1)]


@pytest.mark.parametrize("error", [0.001, 0.3])
def test_against_a_set(spark, rows, error):
    old = {5, 6, -2**63}
    seen, want = set(old), set()
    for order, key, _, _ in rows:
        if key is not None:
            if key in seen:
                want.add(order)
            seen.add(key)
    df = spark.createDataFrame(rows, "rec_id long, id long, kind int, said string").repartition(7)
    history = spark.createDataFrame([(x,) for x in [*old, None, 5]], "id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    told = S.checked(S.answers(df, "id", "rec_id", history, buckets=16, capacity=64, error=error), history, "id")
    got = told.collect()
    rate = S.wrong_rate(told).collect()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.order for r in got if r.seen} == want
    assert all(r.said for r in got if r.seen)
    assert len(got) == sum(k is not None for _, k, _, _ in rows)
    assert rate.wrong == rate.said_seen - len(want) and rate.wrong_rate <= rate.bound * 1.5
    assert error < 0.1 or rate.wrong > 0


def test_empty_and_ties(spark):
    df = spark.createDataFrame([], "rec_id long, id long")
    assert S.answers(df, "id", "rec_id").count() == 0
    assert S.wrong_rate(S.checked(S.answers(df, "id", "rec_id"))).collect()[0].asDict() == {"records": 0, "said_seen": 0, "batch_settled": 0, "wrong": 0, "wrong_rate": 0.0, "bound": 0.0}
    assert S.remembered(df, "id").count() == 0
    ties = spark.createDataFrame([(1, 4), (1, 4), (None, 4), (2, None)], "rec_id long, id long")
    assert sorted(r.said for r in S.answers(ties, "id", "rec_id").collect()) == [False, True]


def test_only_repeats_of_hot_keys_are_settled_in_their_batch(spark):
    rows = [(k, 7 if k % 4 == 0 else 100 + k % 400) for k in range(4000)]
    df = spark.createDataFrame(rows, "rec_id long, id long").coalesce(1).sortWithinPartitions("rec_id")
    got = {r.order: (r.said, r.settled) for r in S.answers(df, "id", "rec_id").collect()}
    first = {key: k for k, key in reversed(rows)}
    assert {k: v[0] for k, v in got.items()} == {k: k != first[key] for k, key in rows}
    assert {key for k, key in rows if got[k][1]} == {7}
    rate = S.wrong_rate(S.checked(S.answers(df, "id", "rec_id"))).collect()[0]
    assert rate.batch_settled == 999 and rate.said_seen == sum(v[0] for v in got.values()) and rate.wrong == 0


def test_chains_go_from_run_to_run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "rec_id long, id long, kind int, said string")
    half = len(rows) // 2
    whole = {r.order: r.said for r in S.answers(df, "id", "rec_id", buckets=8, capacity=64).collect()}
    one, two = df.where(df.rec_id <= half), df.where(df.rec_id > half)
    S.remembered(one, "id", buckets=8, capacity=64).write.parquet(str(tmp_path / "chains"))
    chains = spark.read.parquet(str(tmp_path / "chains"))
    assert {r.order: r.said for r in S.answers(two, "id", "rec_id", chains=chains, buckets=8).collect()} == {k: v for k, v in whole.items() if k > half}
    again = S.remembered(two, "id", chains, buckets=8)
    assert {r.said for r in S.answers(df, "id", "rec_id", chains=again, buckets=8).collect()} == {True}
    parts = [bytes(r.state) for r in chains.where("bucket = 3").orderBy("part").collect()]
    chain = S.Chain.load(parts)
    assert len(chain) == sum(x.used for x in chain.layers) > 64 and b"".join(chain.dump(1000)) == b"".join(parts)


def test_the_chain_decides(spark, rows, monkeypatch):
    df = spark.createDataFrame([r for r in rows if r[1] is not None], "rec_id long, id long, kind int, said string").coalesce(1).sortWithinPartitions("rec_id")
    batch = pa.RecordBatch.from_pandas(df.selectExpr("0 as bucket", "2 as kind", "id as key", "rec_id as `order`", "cast(null as binary) as state").toPandas(), schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("order", pa.int64()), ("state", pa.binary())]))
    told = lambda: [x for b in S._through(64, 1e-7, False)([batch.slice(k, 100) for k in range(0, batch.num_rows, 100)]) for x in b.column(2).to_pylist()]
    honest = told()
    monkeypatch.setattr(S.Chain, "has", lambda self, keys: np.ones(len(keys), dtype=bool))
    assert sum(told()) > sum(honest)


def test_batches_may_come_otherwise(spark, rows):
    want = None
    for parts, size in ((1, 50), (5, 333), (9, 10_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        df = spark.createDataFrame(rows, "rec_id long, id long, kind int, said string").repartition(parts, "kind", "rec_id")
        got = sorted((r.order, r.said) for r in S.answers(df, "id", "rec_id", buckets=4).collect())
        assert want is None or got == want
        want = got
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) == sum(r[1] is not None for r in rows)
