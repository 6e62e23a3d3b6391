"""Delimited phrase lines: load what is sound, set apart what is not, with the reason.

Record blocks are parsed column-wise by Arrow kernels, quoted fields included; one pass also tells for each line whether these
kernels stand for it. A block that isn't sound as a whole is halved again and again: sound parts are loaded in bulk, and the single lines
that remain go through a strict parser that either loads the line (unusual but sound forms) or names the first fault.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = " ||| "
TEXT_FIELDS = ("phrasec", "phrasee", "alignstr", "syntaxinfo", "postaginfo", "posframeinfo")
COUNT_FIELDS = ("countpair", "totalcountc", "totalcounte")
#: The order of the nine fields in a line.
FIELDS = ("phrasec", "phrasee", "alignstr", "countpair", "syntaxinfo", "postaginfo", "posframeinfo", "totalcountc", "totalcounte")
REASONS = ("null_line", "column_count", "quoting", "phrasec", "phrasee", "alignstr", "countpair", "totalcountc", "totalcounte")
MAX_LONG = 2**63 - 1

_bad_phrase = re.compile("[\x00-\x1f\x7f-\x9f�]")
_links = re.compile(r"[0-9]+-[0-9]+(?: [0-9]+-[0-9]+)*")
_count = re.compile(r"[1-9][0-9]{0,18}")
# A line of nine fields, each quoted or not. A plain field may come out too long where the fields are too many, see _quoted_fields.
_nine = r"(?s)^" + r" \|\|\| ".join(rf'(?P<f{k}>"(?:[^"]|"")*"|(?:[^"].*?)??)' for k in range(len(FIELDS))) + r"\z"


def split_line(raw: str) -> list[str]:
    """Fields of a line, unquoted. Raises ValueError on broken quoting."""
    out, pos, end = [], 0, len(raw)
    while True:
        if raw.startswith('"', pos):
            at, parts = pos + 1, []
            while True:
                q = raw.find('"', at)
                if q < 0:
                    raise ValueError(f"field {len(out) + 1}: the quote isn't closed")
                if raw.startswith('"', q + 1):
                    parts.append(raw[at : q + 1])
                    at = q + 2
                elif q + 1 == end or raw.startswith(SEP, q + 1):
                    parts.append(raw[at:q])
                    break
                else:
                    raise ValueError(f"field {len(out) + 1}: a single quote within quotes")
            out.append("".join(parts))
            pos = q + 1
        else:
            nxt = raw.find(SEP, pos)
            stop = end if nxt < 0 else nxt
            out.append(raw[pos:stop])
            pos = stop
        if pos == end:
            return out
        pos += len(SEP)


def diagnose(raw: str | None) -> tuple[list | None, str | None, str | None]:
    """(values, None, None) of a sound line, or (None, reason, detail) with the first fault found."""
    if raw is None:
        return None, "null_line", "the line is null"
    try:
        f = split_line(raw)
    except ValueError as e:
        return None, "quoting", str(e)
    if len(f) != len(FIELDS):
        return None, "column_count", f"{len(f)} fields"
    for name, text in zip(FIELDS[:2], f):
        if not text.strip():
            return None, name, "blank"
        if m := _bad_phrase.search(text):
            return None, name, f"character U+{ord(m[0]):04X}"
    if not _links.fullmatch(f[2]):
        return None, "alignstr", "not a list of links"
    rows, cols = (len(x.split(" ")) for x in f[:2])
    for link in f[2].split(" "):
        i, j = link.split("-")
        # more digits than any index could have are out of range as well
        if len(i.lstrip("0")) > 9 or len(j.lstrip("0")) > 9 or int(i) >= rows or int(j) >= cols:
            return None, "alignstr", "an index is out of range"
    for k in (3, 7, 8):
        if not _count.fullmatch(f[k]) or int(f[k]) > MAX_LONG:
            return None, FIELDS[k], "not a positive 64-bit integer"
        f[k] = int(f[k])
    return f, None, None


def _quoted_fields(raw: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The fields of lines with quoted fields, unquoted, line after line, and which lines have nine sound ones."""
    m = pc.extract_regex(raw, _nine)
    ok = m.is_valid().to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pa.concat_arrays([pc.struct_field(m, k) for k in range(len(FIELDS))]), "")
    quoted = pc.starts_with(flat, '"')
    # a plain field ends at the first separator after its start, which may overlap with the next one
    followed = np.arange(len(flat)) < len(flat) - len(raw)
    long = pc.or_(pc.match_substring(flat, SEP), pc.and_(pc.ends_with(flat, SEP[:-1]), pa.array(followed)))
    ok &= ~pc.and_not(long, quoted).to_numpy(zero_copy_only=False).reshape(len(FIELDS), len(raw)).any(axis=0)
    bare = pc.replace_substring(pc.utf8_slice_codeunits(flat, 1, -1), '""', '"')
    by_line = np.arange(len(flat)).reshape(len(FIELDS), len(raw)).T.ravel()
    return pc.if_else(quoted, bare, flat).take(pa.array(by_line)), ok


def _plain_fields(raw: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same of lines without quoted fields; a line that has not nine is left out of the fields as nine empty ones."""
    parts = pc.split_pattern(raw, SEP)
    ok = pc.equal(pc.list_value_length(parts), len(FIELDS)).to_numpy(zero_copy_only=False)
    if ok.all():
        return parts.flatten(), ok
    sound = parts.filter(pa.array(ok)).flatten()
    at = np.full((len(raw), len(FIELDS)), len(sound))
    at[ok] = np.arange(len(sound)).reshape(-1, len(FIELDS))
    return pa.concat_arrays([sound, pa.array([""], sound.type)]).take(pa.array(at.ravel())), ok


def _fields(raw: pa.Array) -> tuple[pa.Array, np.ndarray]:
    quoted = pc.or_(pc.starts_with(raw, '"'), pc.match_substring(raw, SEP + '"'))
    q = quoted.to_numpy(zero_copy_only=False)
    if not q.any():
        return _plain_fields(raw)
    if q.all():
        return _quoted_fields(raw)
    (one, ok_one), (two, ok_two) = _plain_fields(raw.filter(pc.invert(quoted))), _quoted_fields(raw.filter(quoted))
    line = np.empty(len(raw), dtype=np.int64)
    line[~q], line[q] = np.arange((~q).sum()), np.arange(q.sum()) + (~q).sum()
    n = len(FIELDS)
    return pa.concat_arrays([one, two]).take(pa.array((line[:, None] * n + np.arange(n)).ravel())), np.concatenate([ok_one, ok_two])[line]


class Block:
    """A block of lines after one columnar pass: its typed columns, and for each line whether the bulk path stands for it."""

    def __init__(self, raw: pa.Array):
        size, n = len(raw), len(FIELDS)
        flat, ok = _fields(pc.fill_null(raw, ""))
        by_field = np.arange(size * n).reshape(size, n).T
        pick = lambda *k: flat.take(pa.array(by_field[list(k)].ravel()))
        mask = lambda x, k=1: x.to_numpy(zero_copy_only=False).reshape(k, size).all(axis=0)
        texts, links, counts = pick(0, 1), pick(2), pick(3, 7, 8)
        ok &= raw.is_valid().to_numpy(zero_copy_only=False)
        ok &= mask(pc.invert(pc.match_substring_regex(texts, r"[\x00-\x1f\x7f-\x{9f}\x{fffd}]")), 2) & mask(pc.not_equal(pc.utf8_trim_whitespace(texts), ""), 2)
        # longer numbers may be sound as well (an index with zeros before it, counts near the bound): these are single lines
        ok &= mask(pc.match_substring_regex(links, r"^[0-9]{1,9}-[0-9]{1,9}( [0-9]{1,9}-[0-9]{1,9})*\z"))
        ok &= mask(pc.match_substring_regex(counts, r"^[1-9][0-9]{0,17}\z"), 3)
        no = pa.array(~ok)
        links = pc.if_else(no, "0-0", links)
        n_links = pc.count_substring(links, "-").to_numpy()
        ij = pc.split_pattern(pc.replace_substring(links, "-", " "), " ").flatten().cast(pa.int64()).to_numpy().reshape(-1, 2)
        terms = (pc.count_substring(texts, " ").to_numpy() + 1).reshape(2, size)
        within = (ij < np.repeat(terms.T, n_links, axis=0)).all(axis=1)
        ok &= np.logical_and.reduceat(within, np.cumsum(n_links) - n_links) if size else True
        counts = pc.if_else(pa.array(np.tile(~ok, 3)), "1", counts).cast(pa.int64())
        c = [counts.slice(k * size, size) for k in range(3)]
        self.sound, self.refused = ok, np.concatenate([[0], np.cumsum(~ok)])
        self.columns = [texts.slice(0, size), texts.slice(size, size), links, c[0], pick(4), pick(5), pick(6), c[1], c[2]]

    def stands(self, lo: int, hi: int) -> bool:
        return self.refused[hi] == self.refused[lo]


def bisect(block: Block, lo: int, hi: int, good: list[tuple[int, int]], rest: list[int]) -> None:
    """Halves a range of lines until the bulk path stands for a part as a whole, (lo, hi) of ``good``, or a single line of ``rest`` is left, which the strict parser has to judge."""
    if lo >= hi:
        return
    if block.stands(lo, hi):
        good.append((lo, hi))
    elif hi - lo == 1:
        rest.append(lo)
    else:
        mid = (lo + hi) // 2
        bisect(block, lo, mid, good, rest)
        bisect(block, mid, hi, good, rest)


def parse_block(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array], list[tuple[int, list]], list[tuple[int, str, str]]]:
    """(rows loaded in bulk, their nine typed columns, (row, values) of lines that the strict parser loads, (row, reason, detail) of the others)."""
    block, good, rest, single, bad = Block(raw), [], [], [], []
    bisect(block, 0, len(raw), good, rest)
    for k, line in zip(rest, raw.take(pa.array(rest, pa.int64())).to_pylist()):
        values, reason, detail = diagnose(line)
        if reason:
            bad.append((k, reason, detail))
        else:
            single.append((k, values))
    at = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(lo, hi) for lo, hi in good)])
    cols = block.columns if len(at) == len(raw) else [c.take(pa.array(at)) for c in block.columns]
    return at, cols, single, bad


def _types(ids: list[tuple[str, str]]) -> str:
    own = [(f, "bigint" if f in COUNT_FIELDS else "string") for f in FIELDS]
    return ", ".join(f"`{n}` {t}" for n, t in [*ids, *own, ("reason", "string"), ("detail", "string")])


def parse_lines(df: DataFrame, raw: str = "raw", id_col: str = "line_id", emit: str = "both", block: int = 8192) -> DataFrame:
    """One row per line: its id, the nine typed fields (null where the line is refused), ``reason`` and ``detail`` (null where it is loaded).

    emit: "loaded", "rejects" or "both". Lines keep their multiplicity; a null line is refused as null_line, an empty one by its column count. Other columns
    of ``df``, whatever their names, are not read. Nothing is shuffled: each task works through its own split in blocks of bounded size.
    """
    src = df.select(F.col(id_col).alias("__id"), F.col(raw).cast("string").alias("__raw"))
    kind = dict(src.dtypes)["__id"]
    kinds = [pa.int64() if f in COUNT_FIELDS else pa.string() for f in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                ids, lines = b.column(0), b.column(1)
                if pa.types.is_large_string(lines.type):
                    lines = lines.cast(pa.string())
                bulk, columns, single, bad = parse_block(lines)
                if (len(bulk) or single) and emit != "rejects":
                    at = np.concatenate([bulk, np.array([k for k, _ in single], dtype=np.int64)])
                    cols = [pa.concat_arrays([columns[k], pa.array([v[k] for _, v in single], kinds[k])]) for k in range(len(FIELDS))]
                    none = pa.nulls(len(at), pa.string())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *cols, none, none], names=[id_col, *FIELDS, "reason", "detail"])
                if bad and emit != "loaded":
                    at = [x[0] for x in bad]
                    cols = [pa.nulls(len(at), pa.int64() if f in COUNT_FIELDS else pa.string()) for f in FIELDS]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *cols, pa.array([x[1] for x in bad]), pa.array([x[2] for x in bad])], names=[id_col, *FIELDS, "reason", "detail"])

    return src.mapInArrow(run, _types([(id_col, kind)]))


def rejects(df: DataFrame, **kw) -> DataFrame:
    return parse_lines(df, emit="rejects", **kw)


def loaded(df: DataFrame, **kw) -> DataFrame:
    return parse_lines(df, emit="loaded", **kw).drop("reason", "detail")
