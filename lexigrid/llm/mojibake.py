"""Garbled text from a wrong character encoding: found passage by passage and restored by round trips that lower a garbling cost."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequencies of the Russian letters, in a hundred thousand.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10970, 8450, 8010, 7350, 6700, 6260, 5470, 4730, 4540, 4400, 3490, 3210, 2980, 2810, 2620, 2010, 1900, 1740, 1700, 1650, 1590, 1440, 1210, 970, 940, 730, 640, 480, 360, 320, 260, 40, 40)))
# Characters of rightly decoded European text.
PLAIN_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßāăąćčďđēęěğīıłńňōőřśşšťūůűźżžșț"
PLAIN_SIGNS = "«»“”‘’–—…¿¡°€£§½±•→№·©®™„×"
ODD_SIGNS = "¢¤¥¦¨ª¬¯²³´µ¶¸¹º¼¾÷†‡‰˜ˆ‚‹›ƒ"
#: What a stretch of text must gain to count as garbled.
LEAST = 1.5
#: Blocks of other scripts (start, end): letters of one of them are likely beside their like and unlikely alone or beside other letters.
SCRIPTS = ((0x370, 0x400), (0x530, 0x590), (0x590, 0x600), (0x600, 0x780), *((n, n + 0x80) for n in range(0x900, 0x1000, 0x80)), (0x1000, 0x10A0), (0x10A0, 0x1100), (0x1200, 0x13A0), (0x1780, 0x1800), (0x3041, 0x3100), (0xAC00, 0xD7A4))


def _char_cost(c: str) -> float:
    n, low = ord(c), c.lower()
    if n < 0x80:
        return 0.0 if n >= 32 or c in "\t\n\r" else 3.0
    if n < 0xA0:
        return 5.0
    if low in RUSSIAN:
        return 0.25 + 0.22 * math.log2(0.12 * 1e5 / RUSSIAN[low])
    if c in PLAIN_LETTERS:
        return 0.6
    if low in PLAIN_LETTERS:
        return 1.0
    if c in PLAIN_SIGNS or c == "\xa0":
        return 0.8
    if c in ODD_SIGNS or n == 0xAD:
        return 1.6
    if 0x4E00 <= n <= 0x9FFF:  # by the levels of the national sets, of which the first has the common characters
        for encoding, rare, one, two in (("gb2312", 0xD8, 0.6, 2.0), ("big5", 0xC9, 0.7, 2.4), ("shift_jis", 0x98, 1.2, 2.4)):
            try:
                first = c.encode(encoding)[0] < rare
            except UnicodeEncodeError:
                continue
            if first or encoding == "gb2312":
                return one if first else two
        return 2.4
    if 0x3000 <= n <= 0x3002 or 0x3008 <= n <= 0x3011 or 0xFF01 <= n <= 0xFF1F:
        return 0.5
    if 0x3041 <= n <= 0x30FF:
        return 1.5
    if 0x100 <= n < 0x180 or 0x1E00 <= n < 0x1F00:
        return 0.8
    if 0x1F300 <= n <= 0x1FAFF:
        return 0.8
    if low in "іїєґў":
        return 1.4
    if 0x400 <= n <= 0x52F:
        return 2.2
    if n == 0xFFFD:
        return 4.0
    if n in (0x964, 0x965):
        return 0.8
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co"):
        return 5.0
    if kind[0] == "M":
        return 3.5
    if kind[0] == "L":
        return 2.0 if n < 0x2B0 or n >= 0x2C00 or any(a <= n < b for a, b in SCRIPTS) else 3.5
    return 2.4


KANA = next(k for k, (a, _) in enumerate(SCRIPTS, 1) if a == 0x3041)


class _Known(dict):
    """Results of a function of one character, kept."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, c: str):
        self[c] = x = self.f(c)
        return x


def _script(c: str) -> int:
    """Number of the block of another script, from 1; 0 for Latin, Cyrillic, ideographs, signs and unassigned code points."""
    n = ord(c)
    if n in (0x964, 0x965):  # shared by scripts
        return 0
    return next((k for k, (a, b) in enumerate(SCRIPTS, 1) if a <= n < b and unicodedata.category(c) not in ("Cn", "Co")), 0)


_costs, _scripts = _Known(_char_cost), _Known(_script)


def base_cost(c: str) -> float:
    return _costs[c]


_ALONE = frozenset("àÀóÓáÁéÉèÈíÍ")
_inner_odd = frozenset("«»“”–—…¿¡°€£§½±•→№·©®™„×" + ODD_SIGNS)


def cost(s: str, before: str = " ", after: str = " ") -> float:
    """How unlikely s is as rightly decoded text between the two characters."""
    total, prev, n = 0.0, before, len(s)
    for k, c in enumerate(s):
        if c >= "\x80":
            nxt = s[k + 1] if k + 1 < n else after
            own = _scripts[c]
            if own:
                total += 0.5 if _scripts[prev] == own or _scripts[nxt] == own else _costs[c]
                if prev < "ɐ" and prev.isalpha() or nxt < "ɐ" and nxt.isalpha():
                    total += 1.0
                if c >= "가" and ("一" <= prev <= "鿿" or "一" <= nxt <= "鿿"):
                    total += 1.2
                prev = c
                continue
            total += _costs[c]
            if c in _inner_odd:
                if prev.isalpha() and nxt.isalpha():
                    total += 1.2
            elif c.isupper() and prev.islower():
                total += 1.5
            elif c < "ɐ" and c.isalpha():
                if not prev.isalnum() and not nxt.isalnum() and c not in _ALONE:
                    total += 1.2
                if "Ѐ" <= prev < "԰" or "Ѐ" <= nxt < "԰":
                    total += 1.5
            elif "一" <= c <= "鿿":
                if prev < "\u0250" and prev.isalpha() or nxt < "\u0250" and nxt.isalpha():
                    total += 1.5
            elif "Ѐ" <= c < "԰" and (prev < "ɐ" and prev.isalpha() or nxt < "ɐ" and nxt.isalpha()):
                total += 1.5
        elif prev >= "\x80" and c.isupper() and prev.islower():
            total += 1.5
        prev = c
    return total


def _table(encoding: str) -> dict[str, int]:
    """Character to byte; a byte that the encoding leaves open stands for the control character of its number, as decoders of web text have it."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if encoding == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


SINGLE = ("cp1252", "latin-1", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "cp1250", "mac_cyrillic", "iso8859_5", "iso8859_15")
TABLES = {e: _table(e) for e in SINGLE}
#: (encoding it was decoded with, encoding it should have been decoded with).
PAIRS = (
    ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "utf-8"), ("gbk", "utf-8"), ("big5hkscs", "utf-8"), ("cp1250", "utf-8"), ("iso8859_15", "utf-8"), ("iso8859_5", "utf-8"), ("mac_cyrillic", "utf-8"), ("shift_jis", "utf-8"), ("euc_kr", "utf-8"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8_r"), ("koi8_r", "cp866"), ("mac_cyrillic", "cp1251"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp437", "cp1251"), ("cp850", "cp1251"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1252", "gbk"), ("cp1252", "big5"), ("big5hkscs", "gbk"), ("gbk", "big5"), ("shift_jis", "gbk"), ("euc_kr", "gbk"),
)


def _alphabet(encoding: str) -> frozenset | None:
    return frozenset(TABLES[encoding]) if encoding in TABLES else None


_reach = {e: _alphabet(e) for e, _ in PAIRS}
_swap: dict[tuple[str, str], dict[str, str]] = {}
for _w, _r in PAIRS:
    if _w in TABLES and _r in TABLES:
        _back = {b: c for c, b in reversed(TABLES[_r].items())}
        _swap[_w, _r] = {c: _back[b] for c, b in TABLES[_w].items()}


def _to_bytes(s: str, encoding: str) -> bytes | None:
    t = TABLES.get(encoding)
    try:
        return bytes([t[c] for c in s]) if t else s.encode(encoding)
    except (KeyError, UnicodeEncodeError):
        return None


def round_trip(s: str, wrong: str, right: str, open_start: bool = False, open_end: bool = False) -> str | None:
    """s put back into bytes and strictly decoded as it should have been; None if either isn't possible. At an open end (next to U+FFFD) a character may lack bytes."""
    m = _swap.get((wrong, right))
    if m is not None:
        try:
            return "".join([m[c] for c in s])
        except KeyError:
            return None
    data = _to_bytes(s, wrong)
    if data is None:
        return None
    for skip in range(3 if open_start else 1):
        for cut in range(min(4 if open_end else 1, len(data) - skip)):
            try:
                return data[skip : len(data) - cut].decode(right)
            except UnicodeDecodeError:
                pass
    return None


_short_cost, _short_trip = lru_cache(1 << 17)(cost), lru_cache(1 << 17)(round_trip)


def known_cost(s: str, before: str, after: str) -> float:
    return _short_cost(s, before, after) if len(s) < 4 else cost(s, before, after)


def known_trip(s: str, wrong: str, right: str, open_start: bool, open_end: bool) -> str | None:
    """round_trip, of which the results for short runs are kept."""
    return (_short_trip if len(s) < 4 else round_trip)(s, wrong, right, open_start, open_end)


_run = re.compile(r"[^\x00-\x7f�]+")
_calm = frozenset(PLAIN_SIGNS + PLAIN_LETTERS + PLAIN_LETTERS.upper() + "".join(RUSSIAN) + "".join(RUSSIAN).upper())
# Places where calm characters stand as they don't in rightly decoded text: capitals within words, signs right after letters, runs of Cyrillic capitals, Cyrillic letters next to small Latin ones (save those of the same shape), dashes where Spanish words have ó and ñ (not any dash between letters, which is common).
_uneasy = re.compile(
    r"[a-zà-ÿ][À-ÖØ-ÞŒŠŽŸ]|[À-Þ][a-zà-ÿ]*[À-Þ]|[À-ô][\xa0-»¿×÷‚-‡‰€™]|[A-Za-z][‚„†‡‰]|[A-Za-z][€™“”»](?=[A-Za-zà-ÿ])|[ÂÃÐÑ][^\x00-\x7f]|[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|[a-z][¡-©«-¯±-¹¼-¿×÷]"
    r"|[a-zà-ÿ][А-ЯЁбвгджзий-нпст-фц-яё]|[БГДЖЗИЙЛПФЦ-Ябвгджзий-нпст-фц-яё][a-zà-ÿ]|ci—n\b|[a-z]–[ao]s?\b"
)
# A text of calm characters without one of these has no such place.
_needed = frozenset(chr(n) for a, b in ((0xA0, 0xE0), (0x400, 0x460), (0x2013, 0x2015), (0x201A, 0x2022)) for n in range(a, b)) | frozenset("×÷ŒŠŽŸ‰€™“”")
_utf8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
# Letters of other scripts where they don't stand as in rightly decoded text: alone, beside Latin letters, Hangul beside ideographs.
_blocks = ["".join(f"\\U{n:08x}" + ("-" if n == a else "") for n in (a, b - 1)) for a, b in SCRIPTS]
_foreign = re.compile(f"[{''.join(_blocks)}]")
_lonely = re.compile("|".join(f"(?<![{x}])[{x}](?![{x}])" for x in _blocks) + f"|[A-Za-z\u00c0-\u024f][{''.join(_blocks)}]|[{''.join(_blocks)}][A-Za-z\u00c0-\u024f]|[가-힣][一-鿿]|[一-鿿][가-힣]")
UTF8_PAIRS = tuple(w for w, r in PAIRS if r == "utf-8")
OTHER_PAIRS = tuple(x for x in PAIRS if x[1] != "utf-8")
_CYRILLIC = {(w, r) for w, r in PAIRS if r in ("cp1251", "koi8_r", "cp866", "iso8859_5")}


def _odd(c: str) -> bool:
    return c >= "\x80" and c not in _calm and c != "\xa0" and not _scripts[c] and _costs[c] > 0.6


_odd_known = _Known(_odd)
_even: set[str] = set()


def suspicious(text: str) -> bool:
    """Whether the text holds anything that a round trip could better; a cheap test that is true for every text with a character out of the ordinary, a letter of another script out of its words or a place of _uneasy."""
    chars = frozenset(text)
    new = chars - _even
    if new:
        odd = any(_odd_known[c] for c in new)
        _even.update(c for c in new if not _odd_known[c])
        if odd:
            return True
    return not _needed.isdisjoint(chars) and _uneasy.search(text) is not None or _foreign.search(text) is not None and _lonely.search(text) is not None


def _part(s: str, encoding: str) -> str | None:
    """s with the stretches that are whole UTF-8 characters decoded, if they are most of it and what is left is calm."""
    data = _to_bytes(s, encoding)
    if data is None or len(data) != len(s):
        return None
    out, at, hit = [], 0, 0
    for m in _utf8.finditer(data):
        try:
            t = m[0].decode("utf-8")
        except UnicodeDecodeError:
            return None
        out += [s[at : m.start()], t]
        at, hit = m.end(), hit + len(m[0])
    rest = "".join(out[::2]) + s[at:]
    return "".join(out) + s[at:] if 2 * hit > len(s) and all(c in _calm for c in rest) else None


def _one_script(s: str) -> bool:
    """Whether nothing in it is out of all question, and letters of other scripts, if there are any, are all of one script (Japanese is one with ideographs)."""
    if any(_costs[c] >= 3.5 and not _scripts[c] for c in s if c >= "\u0250"):
        return False
    if not _foreign.search(s):
        return True
    return len({_scripts[c] or ("一" <= c <= "鿿") * KANA or -1 for c in s if c.isalnum() and c >= "\x80" or _scripts[c]}) < 2


def _multi_byte(text: str, runs: list, now: list[float]) -> list[tuple[int, int, str]]:
    """Each run decoded as UTF-8 from the legacy encoding that lowers its cost most. Whole characters of several bytes are evidence by themselves, save for short runs under encodings full of
    letters; these count in full where the same encoding explains other runs of the text, and that encoding is preferred."""
    tried: list[tuple[int, int, list]] = []
    total: dict[str, float] = {}
    light: list[tuple[int, int, float]] = []
    for (a, b), c in zip(runs, now):
        if c < 1.5:
            light.append((a, b, c))
            continue
        s, before, after = text[a:b], text[a - 1] if a else " ", text[b] if b < len(text) else " "
        ways = []
        for e in UTF8_PAIRS:
            reach = _reach[e]
            if reach is not None and s[0] not in reach and s[-1] not in reach:
                continue
            t = round_trip(s, e, "utf-8", before == "�", after == "�") or (_part(s, e) if reach is not None and len(s) > 2 else None)
            if t and _one_script(t):
                g = c - cost(t, before, after)
                less = 1.5 if (e == "cp1251" and len(s) < 4 or reach is None and len(s) < 3) and "�" not in (before, after) else 0.0
                if g > 0.9:
                    ways.append((e, t, g, less))
                    if g - less > 0.9:
                        total[e] = total.get(e, 0.0) + g - less
        if ways:
            tried.append((a, b, ways))
    main = max(total, key=total.get, default=None)
    out = []
    for a, b, ways in tried:
        best, top = None, 0.9
        for e, t, g, less in ways:
            g = g + 0.5 if e == main and total[e] >= 4 else g - less
            if g > top:
                best, top = t, g
        if best is not None:
            out.append((a, b, best))
    if main is not None and total[main] >= 4:
        # what the main encoding explains as well, though the run alone would be no case
        taken = {a for a, _, _ in out}
        for a, b, c in light + [(a, b, 0.0) for a, b, _ in tried if a not in taken]:
            s, before, after = text[a:b], text[a - 1] if a else " ", text[b] if b < len(text) else " "
            t = round_trip(s, main, "utf-8", before == "�", after == "�")
            if t and _one_script(t) and (c or known_cost(s, before, after)) - cost(t, before, after) > 0.2:
                out.append((a, b, t))
        out.sort()
    return out


def _stretches(gains: list[float], gaps: list[int]) -> list[tuple[int, int, float]]:
    """(first run, last run, gain) of stretches of runs with the largest sums of gains; gaps between runs cost a little."""
    taken, lo, total, top, top_at = [], 0, 0.0, 0.0, -1
    for k, g in enumerate(gains):
        total = max(0.0, total - 0.02 * min(gaps[k], 40)) if total > 0 else 0.0
        if total <= 0:
            if top >= LEAST:
                taken.append((lo, top_at, top))
            lo, total, top, top_at = k, 0.0, 0.0, -1
        total += g
        if total > top:
            top, top_at = total, k
        elif top - total > 6:
            if top >= LEAST:
                taken.append((lo, top_at, top))
            lo, total, top, top_at = k + 1, 0.0, 0.0, -1
    if top >= LEAST:
        taken.append((lo, top_at, top))
    return taken


def _same_width(text: str, runs: list, now: list[float]) -> list[tuple[int, int, str]]:
    """The pair of encodings that lowers the cost most over stretches of runs, applied to those stretches."""
    gaps = [runs[k][0] - runs[k - 1][1] if k else 0 for k in range(len(runs))]
    parts = [(text[a:b], text[a - 1] if a else " ", text[b] if b < len(text) else " ", c) for (a, b), c in zip(runs, now)]
    chars = frozenset("".join(x[0] for x in parts))
    best: list[tuple[int, int, str]] = []
    best_gain = 0.0
    for wrong, right in OTHER_PAIRS:
        reach, swap = _reach[wrong], _swap.get((wrong, right))
        if reach is not None and reach.isdisjoint(chars):
            continue
        turned: list[str | None] = []
        gains: list[float] = []
        hope = False
        for s, before, after, c in parts:
            t = None
            if swap is None or s[0] in swap and s[-1] in swap:
                t = known_trip(s, wrong, right, before == "�", after == "�")
            turned.append(t)
            if t is None:
                gains.append(-3.0)
            else:
                g = c - known_cost(t, before, after)
                hope = hope or g > 0
                gains.append(g)
        if not hope:
            continue
        taken = [x for x in _stretches(gains, gaps) if _enough(runs, turned, x, wrong, right)]
        gain = sum(x[2] for x in taken)
        if gain > best_gain:
            best, best_gain = [(*runs[k], turned[k]) for lo, hi, _ in taken for k in range(lo, hi + 1) if turned[k] is not None], gain
    return best


def _enough(runs: list, turned: list, stretch: tuple, wrong: str, right: str) -> bool:
    """Single bytes fit any encoding, so the gain must hold over more text."""
    lo, hi, gain = stretch
    n = sum(runs[k][1] - runs[k][0] for k in range(lo, hi + 1) if turned[k] is not None)
    if right in ("gbk", "big5"):
        return gain >= 3.0 and n >= 3
    if (wrong, right) in _CYRILLIC:
        return gain >= 4.0 and n >= 6
    if right == "cp1252" and wrong in ("cp1251", "koi8_r") and any(runs[k][1] - runs[k][0] > 2 for k in range(lo, hi + 1) if turned[k] is not None):
        return False  # accented letters stand alone or in twos; longer Cyrillic runs in Latin text are endings and names
    return gain >= 1.9


def _priced(text: str) -> tuple[list[tuple[int, int]], list[float]]:
    """Runs of non-ASCII characters and their costs."""
    runs = [(m.start(), m.end()) for m in _run.finditer(text)]
    return runs, [known_cost(text[a:b], text[a - 1] if a else " ", text[b] if b < len(text) else " ") for a, b in runs]


def _applied(text: str, changes: list[tuple[int, int, str]], depths: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The changed text, and for each changed passage (start, end, depth) how many layers were undone there; earlier passages keep theirs."""
    out, spans, at, shift, old = [], [], 0, 0, 0
    for a, b, new in changes:
        out += [text[at:a], new]
        while old < len(depths) and depths[old][1] <= a:
            x, y, d = depths[old]
            spans.append((x + shift, y + shift, d))
            old += 1
        depth = 0
        while old < len(depths) and depths[old][0] < b:
            depth = max(depth, depths[old][2])
            old += 1
        spans.append((a + shift, a + shift + len(new), depth + 1))
        shift += len(new) - (b - a)
        at = b
    return "".join(out) + text[at:], spans + [(x + shift, y + shift, d) for x, y, d in depths[old:]]


def repair(text: str | None) -> tuple[str | None, str | None, int]:
    """(kind, the text with what could be restored, nested layers undone).

    kind: "restored" if a round trip lowered the cost of some passage, "partly" if U+FFFD or bytes of several layers are left beside it, "lost" if there is nothing but U+FFFD, which no
    round trip brings back, null for a text that isn't garbled. Every pass lowers the cost of the whole text, so passes end by themselves.
    """
    if not text or text.isascii():
        return None, text, 0
    now, depths, price = text, [], None
    while suspicious(now):
        runs, costs = _priced(now)
        if price is not None and sum(costs) >= price:
            now, depths = before
            break
        price = sum(costs)
        changes = _multi_byte(now, runs, costs) or _same_width(now, runs, costs)
        if not changes:
            break
        before = now, depths
        now, depths = _applied(now, changes, depths)
    layers = max((d for _, _, d in depths), default=0)
    lost = "�" in now
    return ("partly" if lost else "restored") if layers else "lost" if lost else None, now, layers


def _repair(found_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind, now, layers = repair(t)
                if kind or not found_only:
                    rows.append((i, kind, now, layers))
            if rows:
                i, g, n, k = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(g, pa.string()), pa.array(n, pa.string()), pa.array(k, pa.int32())], names=["doc_id", "kind", "restored", "layers"])

    return run


def repaired(df: DataFrame, text: str = "text", doc_id: str = "doc_id", found_only: bool = False) -> DataFrame:
    """(doc_id, kind, restored, layers) for each row, or only for garbled ones; see ``repair`` for kinds. Null and empty texts aren't garbled and come back as they are; rows keep their multiplicity.

    The text is re-encoded under each candidate encoding, strictly decoded as it was meant, stretch by stretch, and again for nested layers, as long as the cost drops.
    Whole texts, one narrow stage, other columns aren't read. ASCII texts never reach Python when only garbled rows are asked for.
    """
    src = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if found_only:
        src = src.where(F.octet_length("text") > F.length("text"))
    return src.mapInArrow(_repair(found_only), "doc_id bigint, kind string, restored string, layers int")


def garble(text: str, wrong: str, right: str) -> str | None:
    """``text`` stored under ``right`` and read as ``wrong``, as readers of web text do it: open bytes become control characters. None where that isn't possible."""
    try:
        data = text.encode(right)
        if wrong not in TABLES:
            return data.decode(wrong)
    except UnicodeError:
        return None
    chars = _chars[wrong]
    return "".join([chars[b] for b in data])


_chars = {e: {b: c for c, b in reversed(t.items())} for e, t in TABLES.items()}
#: Garblings for which ``accuracy`` measures the restoration.
MEASURED = (("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"))


def accuracy(df: DataFrame, text: str = "text", doc_id: str = "doc_id", by: str = "lang") -> DataFrame:
    """(by, wrong, meant, n, found, restored): sound texts with other than ASCII characters are garbled on purpose, each under one of MEASURED by its id, and repaired: how many are found, and how many come back character by character.

    Texts that count as garbled as they are stand outside this, as there is no original to compare with. A null group is a group of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, g in zip(*(c.to_pylist() for c in b.columns)):
                wrong, right = MEASURED[i % len(MEASURED)]
                bad = garble(t, wrong, right)
                if bad is not None and bad != t and repair(t)[0] is None:
                    kind, now, _ = repair(bad)
                    rows.append((g, wrong, right, kind is not None, now == t))
            if rows:
                g, w, r, f, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(w), pa.array(r), pa.array(f), pa.array(x)], names=["by", "wrong", "meant", "found", "same"])

    src = df.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t"), F.col(by).cast("string").alias("g")).where("i is not null and octet_length(t) > length(t)")
    rows = src.mapInArrow(run, "by string, wrong string, meant string, found boolean, same boolean")
    n = lambda c: F.count(F.when(F.col(c), 1))
    return rows.groupBy("by", "wrong", "meant").agg(F.count(F.lit(1)).alias("n"), n("found").alias("found"), n("same").alias("restored"))
