import random
import unicodedata
from itertools import combinations

import pytest

from lexigrid.llm import same_look as S


@pytest.fixture(scope="module")
def look(spark):
    return S.Transducer(S.mapping(spark))


@pytest.mark.parametrize("text, form", [("ｔｅｘｔ", "text"), ("é", "é"), ("e­́", "é"), ("a​b", "ab"), ("a b　c", "a b c"), ("раpеr", "papep"[:4] + "r"), ("Νο", "No"), ("海", "海"), ("⼭", "山"), ("ё", "ë"), ("", ""), ("Ab", "Ab"), ("é", "é"), ("a  b ", "a  b "), ("각", "각"), ("﻿", "")])
def test_forms(look, text, form):
    assert look(text) == form


@pytest.mark.parametrize("text, form", [("ハンド", "八ンド"), ("カ゛", "力 ゙"), ("👩\u200d👧", "👩\u200d👧"), ("❤\ufe0f", "❤\ufe0f"), ("a\ufe0f", "a"), ("क\u200dष", "क\u200dष"), ("αɑꓐІΙ", "aɑBII"), ("тест", "тecт"), ("Ա", "Ա"), ("е\u0301", "é")])
def test_marks_and_joiners(look, text, form):
    assert look(text) == form


def test_the_table_is_large_and_checked(spark):
    m = S.mapping(spark)
    assert len(m.letters) > 300 and set("ꓐᎪΑАіοοσ") <= set(m.letters) and len(m.moved) > 5000
    with pytest.raises(ValueError):
        S.checked_letters({"ж": "ъ", "ъ": "ж"})
    with pytest.raises(ValueError):
        S.checked_letters({"ж": "ｅ"})


def test_form_is_stable_and_follows_the_rule_by_cluster(look):
    rng = random.Random(6)
    pool = [chr(c) for c in range(0x20, 0x2100) if unicodedata.category(chr(c)) not in ("Cn", "Cs")] + list("ｅé́​­海⼭ аё") * 40
    t = look
    for _ in range(1500):
        x = "".join(rng.choices(pool, k=12))
        assert t(t(x)) == t(x)
    assert all(t(chr(c)) == chr(c) for c in range(0x20, 0x7F))


def test_pairs_against_brute_force(spark, look):
    rng = random.Random(7)
    base = ["paper one", "é", "海 路", "x", "é", ""]
    hide = [lambda s: s, lambda s: s.replace("e", "ｅ"), lambda s: unicodedata.normalize("NFD", s), lambda s: s.replace(" ", " "), lambda s: s[:1] + "​" + s[1:], lambda s: s.replace("海", "海"), str.upper]
    rows = [(i, rng.choice(hide)(rng.choice(base)), "f") for i in range(150)] + [(i, "paper one", "f") for i in range(200, 420)] + [(900, None, "f"), (None, "x", "f"), (901, "а" * 20_000, "f"), (902, "a" * 20_000, "f")]
    df = spark.createDataFrame(rows, "row_id long, words string, form string").repartition(5)
    form = {x: look(x) for _, x, _ in rows if x is not None}
    keep = [(i, x) for i, x, _ in rows if i is not None and x is not None]
    want = {(min(i, j), max(i, j)) for (i, x), (j, y) in combinations(keep, 2) if x != y and form[x] == form[y]}
    for large, salts in ((256, 64), (3, 4)):
        S.LARGE, S.SALTS = large, salts
        got = [(r.field_name, r.id_a, r.id_b) for r in S.look_alikes({"n_gram.words": (df, "words", "row_id")}).collect()]
        assert len(got) == len(set(got)) and set(got) == {("n_gram.words", a, b) for a, b in want}
    S.LARGE, S.SALTS = 256, 64
    classes = [(r.id, r.class_id) for r in S.look_classes({"f": (df, "words", "row_id")}).collect()]
    members = {i for pair in want for i in pair}
    least = {}
    for i, x in keep:
        if i in members:
            least[form[x]] = min(i, least.get(form[x], i))
    assert len(classes) == len(members) and dict(classes) == {i: least[form[x]] for i, x in keep if i in members}
    assert S.look_alikes({"e": (df.limit(0), "words", "row_id")}).count() == 0
