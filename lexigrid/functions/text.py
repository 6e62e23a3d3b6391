"""Column expressions over text, tokens and alignment links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a longest run of anything but ASCII white space.
TOKEN = r"[^ \t\n\r\f\x0B]+"
RESERVED, REPLACED = " ||| ", " -S:P- "
LINK = "struct<s:int,t:int>"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def terms(text: Column | str) -> Column:
    return F.split(text, " ")


def wrap(toks: Column) -> Column:
    return F.concat(F.array(F.lit("<s>")), toks, F.array(F.lit("</s>")))


def lines(text: Column | str) -> Column:
    return F.split(text, "\n")


def history(gram: Column | str) -> Column:
    """All but the last term; the empty string for a single one."""
    g = F.col(gram) if isinstance(gram, str) else gram
    return F.regexp_replace(g, r"(^|\x20)[^\x20]*$", "")


def shorter(gram: Column | str) -> Column:
    """All but the first term."""
    return F.regexp_replace(gram, r"^[^\x20]*\x20", "")


def last_word(gram: Column | str) -> Column:
    return F.substring_index(gram, " ", -1)


def ngrams(toks: str, low: int, high: int) -> Column:
    """Array of (n, gram) of all orders from low to high within one sentence."""
    none = "cast(array() as array<struct<n:int,gram:string>>)"
    one = f"transform(sequence(1, size({toks}) - n + 1), i -> struct(n as n, array_join(slice({toks}, i, n), ' ') as gram))"
    return F.expr(f"flatten(transform(sequence({low}, {high}), n -> if(size({toks}) >= n, {one}, {none})))")


def links(align: Column | str, rows: Column | None = None, cols: Column | None = None) -> Column:
    """Links of an ``i-j`` list, in order, without repeats; those out of range are dropped where sizes are given."""
    parsed = F.transform(F.filter(F.split(align, " "), lambda x: x.rlike(r"^\d+-\d+$")), lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("int").alias("s"), F.split_part(x, F.lit("-"), F.lit(2)).cast("int").alias("t")))
    if rows is not None:
        parsed = F.filter(parsed, lambda x: (x["s"] < rows) & (x["t"] < cols))
    return F.array_distinct(parsed)


def link_text(ls: Column) -> Column:
    return F.array_join(F.transform(ls, lambda x: F.concat_ws("-", x["s"].cast("string"), x["t"].cast("string"))), " ")


def reverse_links(ls: Column) -> Column:
    return F.transform(ls, lambda x: F.struct(x["t"].alias("s"), x["s"].alias("t")))


def escape_reserved(text: Column | str) -> Column:
    return F.replace(text, F.lit(RESERVED), F.lit(REPLACED))


def union_tags(a: Column, b: Column) -> Column:
    """Blank-separated tags of both, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.split(a, " "), F.split(b, " ")), lambda x: x != "")), " ")


def plain_brackets(tags: Column) -> Column:
    return F.transform(tags, lambda x: F.when(x == "-LRB-", "(").when(x == "-RRB-", ")").otherwise(x))


def is_slot(token: Column) -> Column:
    """Whether a rule token is a non-terminal."""
    return token.rlike(r"^#\d*$")


def swap_slots(tokens_: Column) -> Column:
    """The tags of a rule seen from its other side: a bare slot is the first one there and the other way round."""
    return F.transform(tokens_, lambda x: F.when(x == "#", "#1").when(x == "#1", "#").otherwise(x))


def ratio(a: Column, b: Column) -> Column:
    """log10 a - log10 b."""
    return F.log10(a) - F.log10(b)


def span_text(toks: Column, start: Column | int, end: Column | int) -> Column:
    """The words from place ``start`` to ``end`` (from 0, both included) with blanks between; what lies outside is left out."""
    one = F.lit(start) if isinstance(start, int) else start
    two = F.lit(end) if isinstance(end, int) else end
    return F.array_join(F.slice(toks, F.greatest(one, F.lit(0)) + 1, F.greatest(two - F.greatest(one, F.lit(0)) + 1, F.lit(0))), " ")


def packed_class(word: Column, cls: Column, classes: int) -> Column:
    """A word id and a class from 0 to ``classes`` in one number."""
    return word * (classes + 1) + cls


def unpacked_class(packed: Column, classes: int) -> tuple[Column, Column]:
    return F.floor(packed / (classes + 1)).cast("bigint"), F.pmod(packed, F.lit(classes + 1))


def decimals(a: Column, b: Column, digits: int = 10) -> dict[str, Column]:
    """Sum, difference, product, quotient (to ``digits`` places, null by zero), larger and smaller of two numbers in exact decimals."""
    x, y = a.cast("decimal(18,4)"), b.cast("decimal(18,4)")
    return {"plus": x + y, "minus": x - y, "times": x * y, "over": F.try_divide(x, y).cast(f"decimal(38,{digits})"), "larger": F.greatest(x, y), "smaller": F.least(x, y)}


def token_pattern(toks: dict[str, Column], pattern: str) -> Column:
    """All places where a pattern over tokens holds, as arrays of their attributes' texts. Tokens are rendered as attributes joined by underscores, blanks between, in the order of ``toks``; the pattern is a regular expression over that, as
    ``w[0-9]+_NN w[0-9]+_VB``. Only whole tokens match: it is bounded by blanks or the ends."""
    names = list(toks)
    line = F.array_join(F.transform(F.arrays_zip(*(toks[n].alias(n) for n in names)), lambda x: F.concat_ws("_", *(x[n] for n in names))), " ")
    return F.regexp_extract_all(line, F.lit(f"(?<![^ ])(?:{pattern})(?![^ ])"), F.lit(0))
