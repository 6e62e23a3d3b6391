import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lexigrid.llm import term_stats, top_n


def test_terms_against_sets(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(["the", "a", "b", "", "é", *map(str, range(90))], k=rng.randint(1, 9))), rng.choice([0, 1, 5, None]), "t") for _ in range(3000)]
    rows += rows[:9] + [(None, 3, "t"), ("", 2, "t"), ("x " * 30_000 + "x", 1, "t")]
    occ, rec, n = Counter(), Counter(), 0
    for text, num, _ in rows:
        if text is not None and num is not None:
            n += 1
            terms = text.split(" ")
            for t in terms:
                occ[t] += num
            rec.update(set(terms))
    df = spark.createDataFrame(rows, "words string, num long, term string").repartition(5)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_stats.marked(df, "words", "num").collect()}
    mark = lambda t: {(True, True): "both", (True, False): "rare", (False, True): "common", (False, False): None}[occ[t] <= 5, rec[t] * 50 >= n]
    assert got == {t: (occ[t], rec[t], mark(t)) for t in occ}
    assert term_stats.marked(df.limit(0), "words", "num").count() == 0


def test_top_against_sorting(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["", "é", None, *map(str, range(60))]), rng.choice([1, 2, 2, 9, None]), rng.choice(["x", "y", "\U0001f600", "｡", None]), "b") for i in range(5000)]
    rows += [(9000, "hot", 9, "x", "b")] * 2
    groups = defaultdict(list)
    for i, g, s, t, _ in rows:
        if None not in (g, s, t):
            groups[g].append((-s, t, i))
    for parts, n in ((1, 3), (9, 3), (4, 1)):
        df = spark.createDataFrame(rows, "id long, g string, score long, e string, bound string").repartition(parts)
        got = defaultdict(list)
        for r in top_n.top_n(df, "g", "score", "e", "id", n).orderBy("place").collect():
            got[r.grp].append((-r.score, r.tie, r.id))
        assert got == {g: sorted(v)[:n] for g, v in groups.items()}
    assert top_n.top_n(df.limit(0), "g", "score", "e", "id").count() == 0


def test_records_over_several_rows_and_tasks(spark):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices("abcdefg", k=rng.randint(1, 4))), rng.choice([None, *range(150)])) for _ in range(2000)]
    occ, sets = Counter(), defaultdict(set)
    for k, (text, record) in enumerate(rows):
        for t in text.split(" "):
            occ[t] += 1
            sets[t].add(("row", k) if record is None else record)
    df = spark.createDataFrame(rows, "words string, rec long").repartition(6)
    for most in (2, 500_000):
        got = {r.term: (r.occurrences, r.records) for r in term_stats.term_counts(df, "words", record="rec", most=most).collect()}
        assert got == {t: (occ[t], len(sets[t])) for t in occ}


def test_counters_outlive_blocks():
    c = term_stats.Counters()
    one = np.ones(3, dtype=np.int64)
    c.add(pa.array(["a b a", "b", "a"]), one, np.array([1, 1, 2]))
    c.add(pa.array(["a", "c a", "b"]), one, np.array([2, 3, 3]))
    got = {t: tuple(x) for t, *x in zip(*(k.to_pylist() for k in c.states().columns))}
    assert got == {"a": (5, 3), "b": (3, 2), "c": (1, 1)}
    c.forget(3)
    c.add(pa.array(["a b", "a", "z"]), one, np.array([3, 4, 4]))
    assert {t: tuple(x) for t, *x in zip(*(k.to_pylist() for k in c.states().columns))} == {"a": (2, 1), "b": (1, 0), "c": (0, 0), "z": (1, 1)}


def test_rows_below_the_bounds_are_not_moved(spark):
    df = spark.range(40_000, numPartitions=8).selectExpr("cast(id % 20 as string) as g", "hash(id) % 1000 as s", "'x' as t", "id")
    bounds = top_n.group_bounds(df, "g", "s", 3)
    assert bounds.count() == 20 and top_n.group_bounds(df, "g", "s", 3, most=5).count() == 5
    want = {(r.grp, r.id) for r in top_n.top_n(df, "g", "s", "t", "id", 3).collect()}
    assert want == {(r.grp, r.id) for r in top_n.top_n(df, "g", "s", "t", "id", 3, most=1).collect()} and len(want) == 60
    tied = spark.range(30_000, numPartitions=6).selectExpr("'hot' as g", "1 as s", "'x' as t", "id")
    assert sorted(r.id for r in top_n.top_n(tied, "g", "s", "t", "id", 3).collect()) == [0, 1, 2]
