from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.operators import bulk_parse as B

GOOD = "a b ||| x ||| 0-0 1-0 ||| 3 ||| NP 1 ||| NN |||  ||| 7 ||| 9"


def bad_with(k, text):
    f = GOOD.split(" ||| ")
    f[k] = text
    return " ||| ".join(f)


CASES = [
    (None, "null_line"), ("", "column_count"), ("   ", "column_count"), (GOOD + " ||| 1", "column_count"), (GOOD.replace(" ||| 9", " |||9"), "column_count"), (bad_with(4, '"x'), "quoting"),
    (bad_with(0, '"a" b"'), "quoting"), (bad_with(0, " "), "phrasec"), (bad_with(0, "a\tb"), "phrasec"), (bad_with(1, "x�"), "phrasee"), (bad_with(1, '""'), "phrasee"), (bad_with(2, "0-1"), "alignstr"),
    (bad_with(2, ""), "alignstr"), (bad_with(2, "0-0  1-0"), "alignstr"), (bad_with(2, "٠-0"), "alignstr"), (bad_with(2, "99999999999999999999-0"), "alignstr"), (bad_with(3, "0"), "countpair"), (bad_with(3, "07"), "countpair"),
    (bad_with(7, "9223372036854775808"), "totalcountc"), (bad_with(8, "-1"), "totalcounte"), (GOOD, None), (bad_with(3, "9223372036854775807"), None), (bad_with(4, '"p ||| ""q"""'), None), (bad_with(3, '"3"'), None),
    (bad_with(4, 'say "x"'), None), (bad_with(2, "00-0"), None), (bad_with(0, "a " + "b" * 100_000), None), (bad_with(4, ""), None),
]


@pytest.mark.parametrize("line, reason", CASES)
def test_reasons(line, reason):
    assert B.diagnose(line)[1] == reason


def test_unquoted_value():
    assert B.diagnose(bad_with(4, '"p ||| ""q"""'))[0][4] == 'p ||| "q"'


pieces = st.lists(st.sampled_from(['"', '""', "a", " ", " ||| ", "|||", "0-0", "1", "9", "\t", "�", "1-0", "x y"]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(pieces, st.just(GOOD), st.builds(bad_with, st.integers(0, 8), pieces), st.none()), max_size=8))
def test_bulk_never_loads_what_strict_refuses(lines):
    raw = pa.array(lines, pa.string())
    strict = [B.diagnose(x) for x in lines]
    at, cols, single, bad = B.parse_block(raw)
    assert all(strict[k][1] is None for k in at)
    assert [list(x) for x in zip(*(c.to_pylist() for c in cols))] == [strict[k][0] for k in at]
    assert sorted([*at, *(k for k, _ in single), *(k for k, _, _ in bad)]) == list(range(len(lines)))


def test_frame(spark):
    lines = [x for x, _ in CASES] * 20
    df = spark.createDataFrame([(i, x, "n", 1) for i, x in enumerate(lines)], "line_id long, raw string, reason string, detail int")
    rows = B.parse_lines(df, block=64).collect()
    assert {r.line_id: r.reason for r in rows} == {i: CASES[i % len(CASES)][1] for i in range(len(lines))}
    assert len(rows) == len(lines)
    assert B.loaded(df).count() == sum(r is None for _, r in CASES) * 20
    assert {r.line_id for r in B.rejects(df).collect()} == {i for i in range(len(lines)) if CASES[i % len(CASES)][1]}
    assert B.parse_lines(df.limit(0)).count() == 0


def test_most_lines_load_in_bulk():
    quoted = [bad_with(4, '"p ||| ""q"""'), bad_with(0, '"a b"'), bad_with(8, '"9"'), bad_with(5, '"|||"')]
    lines = [bad_with(2, "0-9") if k % 25 == 7 else None if k == 300 else quoted[k % 4] if k % 9 == 0 else GOOD for k in range(1024)]
    at, cols, single, bad = B.parse_block(pa.array(lines))
    loaded = {k: list(v) for k, v in zip(at, zip(*(c.to_pylist() for c in cols)))}
    assert not single and len(loaded) == len(lines) - len(bad)
    assert all(loaded.get(k) == B.diagnose(x)[0] for k, x in enumerate(lines))


def test_share_loaded_in_bulk_on_the_table():
    path = Path("/root/testdata/sf0.01/phrase_lines.parquet")
    if not path.exists():
        pytest.skip("no test data here")
    raw = pq.read_table(path, columns=["raw"])["raw"].combine_chunks()
    at, _, single, bad = B.parse_block(raw)
    assert len(at) >= 0.85 * len(raw) and len(at) >= 0.99 * (len(raw) - len(bad)) and len(at) + len(single) + len(bad) == len(raw)


def test_ranges_are_halved():
    lines = [GOOD] * 64
    lines[5] = lines[40] = "x"
    good, rest = [], []
    B.bisect(B.Block(pa.array(lines)), 0, 64, good, rest)
    assert rest == [5, 40] and sum(hi - lo for lo, hi in good) == 62 and len(good) > 2


@pytest.mark.parametrize("line", [x for x, _ in CASES] + [GOOD.replace(" ||| x", ' ||| "x ||| y'), GOOD + ' ||| "z"', "a ||| " + bad_with(0, '"a b"'), bad_with(4, '"p" |||'), bad_with(4, '"p\n"'), bad_with(6, '"') + "\n"])
def test_quoted_lines_in_bulk(line):
    values, reason, _ = B.diagnose(line)
    at, cols, single, bad = B.parse_block(pa.array([line], pa.string()))
    if reason:
        assert bad[0][1] == reason and not single and not len(at)
    elif single:
        assert single[0][1] == values
    else:
        assert [c.to_pylist()[0] for c in cols] == values
