"""Text that looks the same in one stored form: a longest-match transducer over grapheme clusters, with a mapping worked out and checked for conflicts beforehand."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts and the letters of the same shape, which hold whatever else the public table of look-alikes says.
CYRILLIC_LIKE = ("АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухһԁԛԝүѵ", "ABESIJKMHOPCTYXGQWYaesijopcyxhdqwyv")
GREEK_LIKE = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj")
OTHER_LIKE = ("օՕսոհᎪᎢᎬᎻᎫᏦᎷᏢᏟᎳᏀᏃᏙカロニエタトハ", "oOunhATEHJKMPCWGZV力口二工夕卜八")
# Code points that show nothing, besides format characters (Cf) and controls.
HIDDEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
HIDDEN_RANGES = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
# Format characters that do show.
SHOWN_FORMAT = (0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD)
# Blocks of code points that can change: all but ideographs, Hangul syllables and private or unassigned planes.
SCANNED = ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x17000), (0x1AFF0, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def is_hidden(c: str) -> bool:
    n = ord(c)
    if n in HIDDEN or any(a <= n <= b for a, b in HIDDEN_RANGES):
        return True
    kind = unicodedata.category(c)
    return kind == "Cf" and n not in SHOWN_FORMAT or kind == "Cc" and c not in "\t\n\r\v\f\x85"


def _fixed() -> dict[str, str]:
    out: dict[str, str] = {}
    for these, like in (CYRILLIC_LIKE, GREEK_LIKE, OTHER_LIKE):
        for a, b in zip(these, like, strict=True):
            out[a] = b
    return out


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def public_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the letter that they look like, by the skeletons of the public table of confusable characters that the session's ICU library carries.

    Letters of one skeleton make a class. It is told by its basic Latin letter of the same case (a class may have one of either, as I and l) or, without any basic Latin letter, by the skeleton if that is a
    letter of a script other than Latin; classes told by rarer Latin letters aren't used. Letters of the script of their class's letter stay as they are.
    """
    letter = lambda n: unicodedata.category(chr(n))[0] == "L" and unicodedata.normalize("NFKC", chr(n)) == chr(n)
    points = [n for a, b in SCANNED for n in range(a, b) if letter(n)]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(map(chr, points))).split("\n")
    basic: dict[str, dict[str, str]] = {}
    for n, s in zip(points, skeletons, strict=True):
        if n < 0x80:
            basic.setdefault(s, {})[unicodedata.category(chr(n))] = chr(n)
    out = {}
    for n, s in zip(points, skeletons):
        c = chr(n)
        if n < 0x80 or len(s) != 1:
            continue
        like = basic[s].get(unicodedata.category(c), next(iter(basic[s].values()))) if s in basic else s
        if like != c and unicodedata.category(like)[0] == "L" and _script(like) != _script(c) and (like < "\x80" or _script(like) != "LATIN"):
            out[c] = like
    return out


def checked_letters(public: dict[str, str]) -> dict[str, str]:
    """The public letters under the fixed ones, one step each: a letter that is another one's like is its own form. Raises ValueError where a look leads round in a circle or two accents of one letter end apart."""
    out = public | _fixed()
    for c in list(out):
        seen = {c}
        while out[c] in out:
            if out[c] in seen:
                raise ValueError(f"the look of {c} leads round in a circle")
            seen.add(out[c])
            out[c] = out[out[c]]
    for c, like in out.items():
        if unicodedata.normalize("NFKD", like) != like or is_hidden(like):
            raise ValueError(f"{c} leads to {like}, which isn't a form")
    return out


_joined = ((0x600, 0xE00), (0x1000, 0x10A0), (0x1780, 0x1850), (0x2600, 0x27C0), (0x1F000, 0x1FB00))


def _joins(base: str) -> bool:
    """Whether joiners behind it show: in scripts whose letters join, and between emoji."""
    return any(a <= ord(base) < b for a, b in _joined)


def cluster_form(cluster: str, letters: dict[str, str]) -> str:
    """The form of one base with what follows it: nothing hidden, compatibility forms resolved, look-alikes replaced under accents of their own scripts (a kana with its voicing mark stays), composed."""
    joins = _joins(cluster[0])
    shown = "".join(c for c in cluster if not is_hidden(c) or joins and c in "\u200c\u200d\ufe0f")
    parts = "".join(" " if unicodedata.category(c) == "Zs" or c == "\t" else c for c in unicodedata.normalize("NFKD", shown) if not is_hidden(c) or joins and c in "\u200c\u200d\ufe0f")
    out = []
    for k, c in enumerate(parts):
        after = parts[k + 1] if k + 1 < len(parts) else " "
        plain = unicodedata.combining(after) == 0 or "\u0300" <= after <= "\u036f"
        out.append(letters.get(c, c) if plain else c)
    return unicodedata.normalize("NFC", "".join(out))


class Mapping:
    """Worked out once on the driver and shipped: the forms of all single characters that aren't their own form, and the characters that belong to the cluster of the one before."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters
        self.moved: dict[str, str] = {}
        self.after: list[int] = []
        for n in (n for a, b in SCANNED for n in range(a, b)):
            c = chr(n)
            kind = unicodedata.category(c)
            if kind in ("Cs", "Cn", "Co"):
                continue
            if kind in ("Mn", "Mc", "Me") or is_hidden(c) or 0x1160 <= n <= 0x11FF:
                self.after.append(n)
            else:
                form = cluster_form(c, letters)
                if form != c:
                    self.moved[c] = form

    def check(self) -> "Mapping":
        """Raises ValueError if a form isn't its own form."""
        t = Transducer(self)
        for c, form in self.moved.items():
            if t(form) != form:
                raise ValueError(f"{c} leads to {form}, which leads on")
        return self


class Transducer:
    """One pass over a text. Clusters (a base, then marks and hidden characters, as many as there are) that may differ from their form are matched by one compiled
    pattern, longest first, everything else is copied. Single characters have their form in the mapping; longer clusters are composed by rule when first met, and kept."""

    def __init__(self, mapping: Mapping, keep: int = 200_000):
        self.mapping, self.keep, self.forms = mapping, keep, dict(mapping.moved)
        self.special = frozenset([*mapping.moved, *map(chr, mapping.after)])
        bag = lambda x: "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _spans(x)) + "]"
        after = bag(mapping.after)
        self.pattern = re.compile(f"[\\s\\S]?{after}+|{bag([ord(c) for c in mapping.moved])}{after}*")

    def form(self, cluster: str) -> str:
        f = self.forms.get(cluster)
        if f is None:
            if len(self.forms) >= self.keep:
                self.forms = dict(self.mapping.moved)
            f = self.forms[cluster] = cluster_form(cluster, self.mapping.letters)
        return f

    def __call__(self, text: str) -> str:
        if self.special.isdisjoint(text):
            return text
        return self.pattern.sub(lambda m: self.form(m[0]), text)


def _spans(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


_mappings: dict[str, Mapping] = {}
_made: list[tuple[int, Transducer]] = []


def mapping(spark: SparkSession) -> Mapping:
    """The mapping of this session's public table; some ten thousand characters."""
    key = spark.version
    if key not in _mappings:
        _mappings[key] = Mapping(checked_letters(public_letters(spark))).check()
    return _mappings[key]


def _kept(shipped) -> Transducer:
    """The worker's transducer. A function of the module, so that what it keeps outlives the task: closures travel with copies of their globals."""
    if not _made or _made[0][0] != shipped.id:
        _made[:] = [(shipped.id, Transducer(shipped.value))]
    return _made[0][1]


def _forms(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _kept(shipped)
        for b in batches:
            text = b.column(1)
            odd = pc.fill_null(pc.invert(pc.match_substring_regex(text, r"^[\x20-\x7e]*$")), False)
            same = [t(x) for x in text.filter(odd).to_pylist()]
            form = pc.replace_with_mask(text, odd, pa.array(same, text.type))
            yield pa.RecordBatch.from_arrays([b.column(0), text, form], names=["id", "text", "form"])

    return run


class _Shipped:
    """A mapping as a broadcast value with a name of its own, by which workers know what they have compiled."""

    def __init__(self, spark: SparkSession):
        self.sent = spark.sparkContext.broadcast(mapping(spark))
        self.id = f"{spark.sparkContext.applicationId}-{spark.version}"

    @property
    def value(self) -> Mapping:
        return self.sent.value


def normalised(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """(id, text, form): each row's text and its one consistent form. A null text has a null form, an empty one an empty form. Case, accents, the order of
    characters and the number of blanks stay. Other columns aren't read; no shuffle."""
    src = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(_forms(_Shipped(df.sparkSession)), "id bigint, text string, form string")


def _met(fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(field_name, form, text, id) of the rows whose form is that of a text that differs from it, by form. Readers that take all four columns share one exchange."""
    rows = None
    for name, (df, text, row_id) in fields.items():
        part = normalised(df, text, row_id).where("id is not null and text is not null").withColumn("field_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    moved = rows.where("text <> form").select("field_name", "form").distinct()
    return rows.join(moved, ["field_name", "form"], "left_semi").select("field_name", "form", "text", "id").repartition("field_name", "form")


def look_alikes(fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(field_name, id_a, id_b), id_a < id_b: pairs of rows of a field whose stored texts differ but have the same form. Null texts and ids pair with nothing.

    A pair holds at least one text that differs from its form, so only rows whose form is that of such a text go on.
    Forms then meet as distinct texts, a few each, and rows are attached to pairs of texts: rows of equal texts never meet. A text with at least
    1/256 of these rows (256 texts at most, which may be broadcast) is spread by a salt, and its pairs are copied to each salt. ``look_classes`` tells the same without pairs.
    """
    met = _met(fields)
    # the smallest id is asked for so that this reader takes all four columns
    texts = met.groupBy("field_name", "form", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("first is not null").drop("first")
    large = texts.where(F.col("n") * LARGE >= texts.agg(F.sum("n")).scalar()).select("field_name", "text", F.lit(True).alias("large"))
    texts = texts.join(F.broadcast(large), ["field_name", "text"], "left").select("field_name", "form", "text", F.when(F.col("large"), SALTS).otherwise(1).alias("salts"))
    one = {k: texts.select("field_name", "form", F.col("text").alias(f"text_{k}"), F.col("salts").alias(f"salts_{k}")) for k in "xy"}
    out = one["x"].join(one["y"], ["field_name", "form"]).where("text_x < text_y")
    for k in "xy":
        out = out.withColumn(f"salt_{k}", F.explode(F.sequence(F.lit(0), F.col(f"salts_{k}") - 1)))
    salted = met.join(F.broadcast(large), ["field_name", "text"], "left").select("field_name", "form", "text", "id", F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    for k in "xy":
        side = salted.select("field_name", "form", F.col("text").alias(f"text_{k}"), F.col("salt").alias(f"salt_{k}"), F.col("id").alias(f"id_{k}"))
        out = out.join(side, ["field_name", "form", f"text_{k}", f"salt_{k}"])
    return out.select("field_name", F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def look_classes(fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(field_name, id, class_id, texts): one row for each row that looks like another one stored otherwise; the class is named by its smallest id, ``texts`` is its number of stored forms. Rows of a class with equal texts pair with its other texts only."""
    met = _met(fields)
    sizes = met.groupBy("field_name", "form", "text").agg(F.min("id").alias("first")).groupBy("field_name", "form").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return met.join(sizes, ["field_name", "form"]).select("field_name", "id", "class_id", "texts")


LARGE, SALTS = 256, 64
