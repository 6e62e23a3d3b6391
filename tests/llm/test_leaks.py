import random

from lexigrid.llm import leaks as L


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_bit_vectors_against_the_table():
    rng = random.Random(9)
    for _ in range(400):
        p, t = (rng.choices("abc", k=rng.randint(a, 14)) for a in (1, 0))
        assert L.closest(p, t) == min(distance(p, t), len(p))


def test_against_brute_force(spark):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(5, 40))), "x") for k in range(25)] + [(90, None, "x"), (91, "", "x"), (None, "w1 " * 20, "x")]
    docs = []
    for i in range(120):
        t = rng.choices(words, k=rng.randint(0, 30))
        w = items[rng.randrange(25)][1].split(" ")
        a = rng.randrange(len(w))
        part = w[a : a + rng.choice([11, 12, 13, 30])]
        if rng.random() < 0.4 and len(part) > 3:
            part[rng.randrange(len(part))] = "edited"
        at = rng.randrange(len(t) + 1)
        docs.append((i, rng.choice([" ", ", ", "\n_", " ||| "]).join(t[:at] + [x.upper() if rng.random() < 0.3 else x for x in part] + t[at:]), 1))
    docs += [(500, None, 1), (501, "", 1), (502, "w1 " * 20_000 + docs[0][1], 1), (None, docs[0][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    exact = set()
    for errors in (0, 1, 2):
        want = set()
        for di, dt, _ in docs:
            for ii, it, _ in items:
                if None in (di, ii, dt, it):
                    continue
                a, b = L.words(dt), L.words(it)
                if di == 502:
                    a = a[-200:]
                if any(distance(b[k : k + 12], a) <= errors for k in range(len(b) - 11)):
                    want.add((di, ii))
        for block in (10**6, 60):
            rows = L.leaked(d, i, 12, errors, block_words=block).collect()
            got = [(r.doc_id, r.item_id) for r in rows]
            assert len(got) == len(set(got)) and set(got) == want
            exact = exact if errors else want
            assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == exact
    assert L.leaked(d.limit(0), i).count() == L.leaked(d, i.limit(0)).count() == 0


def test_recall_of_edited_windows(spark):
    rng = random.Random(11)
    items = spark.createDataFrame([(k, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.choice([10, 20, 45])))) for k in range(60)], "item_id long, text string")
    got = {r.edits: (r.planted, r.found) for r in L.recall(items, 20, 2).collect()}
    n = got[0][0]
    assert 0 < n < 60 and got == {0: (n, n), 1: (n, n), 2: (n, n), 3: (n, 0), 4: (n, 0)}
