"""Per-sentence algorithms on plain lists; no Spark here."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

Link = tuple[int, int]


def touches(i: int, j: int, rows: int, cols: int, links: set[Link]) -> bool:
    """Whether (i, j) is linked; the corners before the first and after the last pair count as linked."""
    return (i, j) in links or (i, j) == (-1, -1) or (i >= rows and j >= cols)


def orientation(span: tuple[int, int, int, int], rows: int, cols: int, links: set[Link]) -> tuple[str, str]:
    """m (monotone), s (swap) or o before the phrase; n, t or p after it."""
    sc, ec, se, ee = span
    at = lambda i, j: touches(i, j, rows, cols, links)
    a, b = at(sc - 1, se - 1), at(ec + 1, se - 1)
    c, d = at(sc - 1, ee + 1), at(ec + 1, ee + 1)
    return ("m" if a and not b else "s" if b and not a else "o"), ("t" if c and not d else "n" if d and not c else "p")


def phrase_spans(rows: int, cols: int, links: set[Link], max_c: int, max_e: int, extend: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """Consistent (start, end) source and target spans: no link leaves the rectangle, at least one lies in it. With ``extend`` either side may have unaligned words at its ends; otherwise all four end words are aligned."""
    by_e: list[list[int]] = [[] for _ in range(cols)]
    lo_e, hi_e = [cols] * rows, [-1] * rows
    for s, t in links:
        by_e[t].append(s)
        lo_e[s], hi_e[s] = min(lo_e[s], t), max(hi_e[s], t)
    for se in range(cols):
        low, high = rows, -1
        for ee in range(se, min(cols, se + max_e)):
            if by_e[ee]:
                low, high = min(low, *by_e[ee]), max(high, *by_e[ee])
            if high < 0 or high - low >= max_c:
                continue
            if not extend and not (by_e[se] and by_e[ee]):
                continue
            if any(hi_e[s] >= 0 and (lo_e[s] < se or hi_e[s] > ee) for s in range(low, high + 1)):
                continue
            sc = low
            while True:
                ec = high
                while ec - sc < max_c:
                    yield sc, ec, se, ee
                    ec += 1
                    if not extend or ec >= rows or hi_e[ec] >= 0:
                        break
                sc -= 1
                if not extend or sc < 0 or hi_e[sc] >= 0:
                    break


def inner_links(span: tuple[int, int, int, int], links: set[Link]) -> list[Link]:
    sc, ec, se, ee = span
    return sorted((s - sc, t - se) for s, t in links if sc <= s <= ec and se <= t <= ee)


def null_words(rows: int, cols: int, links: set[Link]) -> tuple[list[int], list[int]]:
    """Unaligned positions of either side whose neighbours are both aligned (an end counts as aligned)."""
    out = []
    for n, k in ((rows, 0), (cols, 1)):
        has = {x[k] for x in links}
        out.append([i for i in range(n) if i not in has and (i == 0 or i - 1 in has) and (i == n - 1 or i + 1 in has)])
    return out[0], out[1]


class Rule(NamedTuple):
    lhs: str
    rhs: str
    align: str
    inverse: str
    whole: tuple[int, int, int, int]
    slots: tuple[tuple[int, int, int, int], ...]


def rule_cases(src: list[str], tgt: list[str], links: set[Link], max_span: int = 10, max_slots: int = 2, max_symbols: int = 5, min_words: int = 1, consecutive: bool = False, all_unaligned: bool = False) -> Iterator[Rule]:
    """Hierarchical rules (lhs with #, rhs with #k, links of the terminals from either side): initial phrases with up to max_slots smaller phrases taken out.

    Slots don't overlap, don't touch on the source side unless ``consecutive``, leave at least min_words terminals a side and at most max_symbols symbols, and at
    least one aligned terminal unless ``all_unaligned``. A rule comes once for each place it is found at.
    """
    rows, cols = len(src), len(tgt)
    spans = sorted(set(phrase_spans(rows, cols, links, max_span, max_span, False)))
    aligned = {s for s, _ in links}
    for whole in spans:
        sc, ec, se, ee = whole
        inside = [x for x in spans if x != whole and sc <= x[0] and x[1] <= ec and se <= x[2] and x[3] <= ee]
        for k in range(max_slots + 1):
            for slots in combinations(inside, k):
                if any(a[1] + (0 if consecutive else 1) >= b[0] for a, b in zip(slots, slots[1:])):
                    continue
                by_e = sorted(slots, key=lambda x: x[2])
                if any(a[3] >= b[2] for a, b in zip(by_e, by_e[1:])):
                    continue
                left = [i for i in range(sc, ec + 1) if not any(a <= i <= b for a, b, _, _ in slots)]
                right = [j for j in range(se, ee + 1) if not any(a <= j <= b for _, _, a, b in slots)]
                if len(left) < min_words or len(right) < min_words or len(left) + k > max_symbols or len(right) + k > max_symbols:
                    continue
                if not all_unaligned and not any(i in aligned for i in left):
                    continue
                lhs, at_s = _render(src, sc, ec, [(a, b, "#") for a, b, _, _ in slots])
                rhs, at_t = _render(tgt, se, ee, [(x[2], x[3], f"#{slots.index(x) + 1}") for x in by_e])
                al = sorted((at_s[s], at_t[t]) for s, t in links if s in at_s and t in at_t)
                yield Rule(lhs, rhs, " ".join(f"{i}-{j}" for i, j in al), " ".join(f"{j}-{i}" for i, j in al), whole, slots)


def rules(src: list[str], tgt: list[str], links: set[Link], **limits) -> set[tuple[str, str, str]]:
    """(lhs, rhs, align) of ``rule_cases``, each once."""
    return {r[:3] for r in rule_cases(src, tgt, links, **limits)}


def _render(words: list[str], start: int, end: int, slots: list[tuple[int, int, str]]) -> tuple[str, dict[int, int]]:
    parts, places, i, where = [], {}, start, {a: (b, mark) for a, b, mark in slots}
    while i <= end:
        if i in where:
            parts.append(where[i][1])
            i = where[i][0] + 1
        else:
            places[i] = len(parts)
            parts.append(words[i])
            i += 1
    return " ".join(parts), places


def grow_diag(forward: set[Link], backward: set[Link], diagonal: bool = True, final: str = "and") -> list[Link]:
    """Symmetrised links: the intersection, grown by neighbouring links of the union that cover a new word, then (final) by union links of uncovered words:
    "and" both words uncovered, "or" either, "" none."""
    both, every = forward & backward, forward | backward
    got = set(both)
    rows, cols = {s for s, _ in got}, {t for _, t in got}
    near = [(-1, 0), (0, -1), (1, 0), (0, 1)] + [(-1, -1), (-1, 1), (1, -1), (1, 1)] * diagonal
    grown = True
    while grown:
        grown = False
        for s, t in sorted(got):
            for ds, dt in near:
                x = (s + ds, t + dt)
                if x in every and x not in got and (x[0] not in rows or x[1] not in cols):
                    got.add(x)
                    rows.add(x[0])
                    cols.add(x[1])
                    grown = True
    if final:
        for side in (forward, backward):
            for s, t in sorted(side):
                free = (s not in rows, t not in cols)
                if (s, t) not in got and (all(free) if final == "and" else any(free)):
                    got.add((s, t))
                    rows.add(s)
                    cols.add(t)
    return sorted(got)


def span_kind(heads: list[int], start: int, end: int) -> str:
    """fixed: one word of the span has its head outside, and outside words hang on that word only. floating: the words with a head outside share it, and nothing outside hangs on the span. none otherwise."""
    kind, flag, _ = span_syntax(heads, start, end, "any")
    return "none" if flag else "floating" if "Floating" in kind else kind


def span_syntax(heads: list[int], start: int, end: int, constraint: str = "wellformed") -> tuple[str, int, int]:
    """(type, flag, head) of a span of a dependency tree. flag is 0 for a well-formed span.

    A fixed span has one word with its head outside, its head. A floating one has a head of its own outside that all such words share: leftFloating if that head stands to the right, rightFloating if it
    stands to the left (the root stands left of all). Well-formed are fixed spans on no word of which but the head anything outside hangs and, unless the constraint is "wellformed", floating ones on which nothing outside
    hangs. Spans that aren't well-formed are typed without these conditions, floating ones as "other" under the constraint "relaxed".
    """
    inside = range(start, end + 1)
    roots = [k for k in inside if not start <= heads[k] <= end]
    over = {heads[k] for k in roots}
    hang = {heads[k] for k in range(len(heads)) if not start <= k <= end and start <= heads[k] <= end}
    side = lambda: ("leftFloating" if min(over) > end else "rightFloating", min(over))
    if len(roots) == 1 and hang <= set(roots):
        return "fixed", 0, roots[0]
    if constraint != "wellformed" and len(over) == 1 and not hang:
        kind, head = side()
        return kind, 0, head
    if len(roots) == 1:
        return "fixed", 1, roots[0]
    if constraint != "relaxed" and len(over) == 1:
        kind, head = side()
        return kind, 1, head
    return "other", 1, -1


def local_heads(heads: list[int], start: int, end: int) -> list[int]:
    """Heads from the span's own start, -1 where they lie outside."""
    return [h - start if start <= h <= end else -1 for h in heads[start : end + 1]]


def syntax_text(heads: list[int], start: int, end: int, constraint: str = "wellformed") -> str:
    kind, flag, _ = span_syntax(heads, start, end, constraint)
    return f"{kind}\t{flag}\t{' '.join(map(str, local_heads(heads, start, end)))}"


def head_tag(heads: list[int], tags: list[str], start: int, end: int, constraint: str = "wellformed", keep_floating: bool = False) -> str:
    """The tag of a fixed span's head (of a floating one's where that is wanted), X otherwise."""
    kind, _, head = span_syntax(heads, start, end, constraint)
    return tags[head] if 0 <= head < len(tags) and (kind == "fixed" or keep_floating and "Floating" in kind) else "X"


def rule_syntax(heads: list[int], rule: Rule, constraint: str = "wellformed") -> str:
    """Type and flag of the rule's target span, and for each symbol of the target side the symbol that it hangs on, -1 outside. A slot hangs where its own root does."""
    _, _, se, ee = rule.whole
    kind, flag, _ = span_syntax(heads, se, ee, constraint)
    holes = sorted((x[2], x[3]) for x in rule.slots)
    symbol, first = {}, []
    k = se
    while k <= ee:
        end = next((b for a, b in holes if a == k), k)
        for j in range(k, end + 1):
            symbol[j] = len(first)
        first.append((k, end))
        k = end + 1
    out = []
    for a, b in first:
        roots = [j for j in range(a, b + 1) if not a <= heads[j] <= b]
        out.append(symbol.get(heads[roots[0]], -1) if roots else -1)
    return f"{kind}\t{flag}\t{' '.join(map(str, out))}"


def rule_tags(heads: list[int], tags: list[str], rule: Rule, constraint: str = "wellformed", separator: str = ";") -> str:
    """Head tags of the rule's target span and of its slots in source order; ``separator`` is ; where all tags are kept apart and a comma for one frame."""
    return separator.join(head_tag(heads, tags, x[2], x[3], constraint) for x in (rule.whole, *rule.slots))


def schedule(text: str) -> list[tuple[str, int]]:
    """Training schedule: ``1*H*3*4`` after an optional ``P`` (continue from given tables), each model followed by as many stars as it has further iterations."""
    out: list[tuple[str, int]] = []
    for c in text.removeprefix("P"):
        if c == "*":
            if not out:
                raise ValueError("a schedule starts with a model")
            out[-1] = (out[-1][0], out[-1][1] + 1)
        elif c in "12H34":
            out.append((c, 1))
        else:
            raise ValueError(f"no model {c}")
    return out
