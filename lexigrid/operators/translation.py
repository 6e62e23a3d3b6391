"""Phrase and rule tables from aligned bitext (row_id, src, tgt, links), and their scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import kernels as K
from lexigrid.operators.corpus import numbered

NULL = "<NULL>"
_COLUMNS = [("row_id", "bigint"), ("src", "string"), ("tgt", "string"), ("align", "string"), ("sc", "int"), ("ec", "int"), ("se", "int"), ("ee", "int"), ("prev", "string"), ("next", "string")]


def _sentences(b: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[str], set]]:
    for i, s, t, links in zip(*(c.to_pylist() for c in b.columns[:4])):
        yield i, s, t, {(x["s"], x["t"]) for x in links if 0 <= x["s"] < len(s) and 0 <= x["t"] < len(t)}


def phrases(bitext: DataFrame, max_c: int = 5, max_e: int = 5, extend: bool = True) -> DataFrame:
    """Every phrase occurrence with its place, its links from its own start, and the orientation before and after it. A narrow kernel: sentences stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s, t, links in _sentences(b):
                for span in K.phrase_spans(len(s), len(t), links, max_c, max_e, extend):
                    sc, ec, se, ee = span
                    al = " ".join(f"{x}-{y}" for x, y in K.inner_links(span, links))
                    rows.append((i, " ".join(s[sc : ec + 1]), " ".join(t[se : ee + 1]), al, *span, *K.orientation(span, len(s), len(t), links)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), _COLUMNS)], names=[n for n, _ in _COLUMNS])

    return bitext.select("row_id", "src", "tgt", "links").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _COLUMNS))


def null_phrases(bitext: DataFrame) -> DataFrame:
    """(row_id, src, tgt, align): isolated unaligned words with the null word on the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s, t, links in _sentences(b):
                left, right = K.null_words(len(s), len(t), links)
                rows += [(i, s[k], NULL, "0-0") for k in left] + [(i, NULL, t[k], "0-0") for k in right]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.string()) for x in c[1:])], names=["row_id", "src", "tgt", "align"])

    return bitext.select("row_id", "src", "tgt", "links").mapInArrow(run, "row_id bigint, src string, tgt string, align string")


def phrases_with_syntax(bitext: DataFrame, max_c: int = 5, max_e: int = 5, constraint: str = "wellformed", keep_floating: bool = False) -> DataFrame:
    """The columns of ``phrases`` with ``inverse`` (links from the target side), ``syntax`` (type, flag and heads of the target span) and ``tag`` (its head's), of rows with ``heads`` and ``pos`` of the target words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for (i, s, t, links), heads, tags in zip(_sentences(b), b.column(4).to_pylist(), b.column(5).to_pylist()):
                for span in K.phrase_spans(len(s), len(t), links, max_c, max_e):
                    sc, ec, se, ee = span
                    inner = K.inner_links(span, links)
                    al, inverse = " ".join(f"{x}-{y}" for x, y in inner), " ".join(f"{y}-{x}" for x, y in inner)
                    syntax, tag = K.syntax_text(heads, se, ee, constraint), K.head_tag(heads, tags, se, ee, constraint, keep_floating)
                    rows.append((i, " ".join(s[sc : ec + 1]), " ".join(t[se : ee + 1]), al, *span, *K.orientation(span, len(s), len(t), links), inverse, syntax, tag))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), _MORE)], names=[n for n, _ in _MORE])

    return bitext.select("row_id", "src", "tgt", "links", "heads", "pos").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _MORE))


_MORE = [*_COLUMNS, ("inverse", "string"), ("syntax", "string"), ("tag", "string")]
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def syntax_columns(occurrences: DataFrame) -> DataFrame:
    """(src, tgt, syntax, tags): shares of the syntax strings of a pair, most frequent first (ties by text), as ``share syntax`` joined by semicolons, and its distinct tags in order. A pair's strings are few, as its target side has few words."""
    n = occurrences.groupBy("src", "tgt", "syntax").agg(F.count(F.lit(1)).alias("n"), F.collect_set("tag").alias("tags"))
    per = n.groupBy("src", "tgt").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "syntax"))).alias("x"), F.sum("n").alias("every"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    share = F.transform("x", lambda y: F.format_string("%.4f %s", -y["n"] / F.col("every"), y["syntax"]))
    return per.select("src", "tgt", F.array_join(share, ";").alias("syntax"), F.array_join("tags", " ").alias("tags"))


_RULES = [("row_id", "bigint"), ("src", "string"), ("tgt", "string"), ("align", "string")]
_RULES_MORE = [*_RULES, ("inverse", "string"), ("weight", "double"), ("syntax", "string"), ("tags", "string"), ("frame", "string")]


def rule_occurrences(bitext: DataFrame, **limits) -> DataFrame:
    """(row_id, src, tgt, align) of hierarchical rules, each once a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, s, t, links in _sentences(b) for r in sorted(K.rules(s, t, links, **limits))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), _RULES)], names=[n for n, _ in _RULES])

    return bitext.select("row_id", "src", "tgt", "links").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _RULES))


def rules_with_syntax(bitext: DataFrame, constraint: str = "wellformed", **limits) -> DataFrame:
    """Rules once for each place in a sentence with ``inverse``, ``weight`` (1 over the rules of the same span, for fractional counts), ``syntax``, ``tags`` and ``frame`` of the target side, of rows with ``heads`` and ``pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for (i, s, t, links), heads, pos in zip(_sentences(b), b.column(4).to_pylist(), b.column(5).to_pylist()):
                cases = list(K.rule_cases(s, t, links, **limits))
                of = Counter(r.whole for r in cases)
                rows += [(i, r.lhs, r.rhs, r.align, r.inverse, 1 / of[r.whole], K.rule_syntax(heads, r, constraint), K.rule_tags(heads, pos, r, constraint), K.rule_tags(heads, pos, r, constraint, ",")) for r in cases]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), _RULES_MORE)], names=[n for n, _ in _RULES_MORE])

    return bitext.select("row_id", "src", "tgt", "links", "heads", "pos").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _RULES_MORE))


def best_tags(occurrences: DataFrame, tags: str = "frame") -> DataFrame:
    """(src, tgt, tags): the most frequent one of each pair, ties by text."""
    n = occurrences.groupBy("src", "tgt", tags).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("src", "tgt").agg(F.min_by(tags, F.struct(-F.col("n"), F.col(tags))).alias("tags"))


#: Ways to make one set of links of two.
METHODS = ("union", "intersect", "srctotgt", "tgttosrc", "grow", "grow-diag", "grow-final", "grow-final-and", "grow-diag-final", "grow-diag-final-and")


def symmetrised(both: DataFrame, method: str = "grow-diag-final-and") -> DataFrame:
    """(row_id, align) of rows with forward and backward links by one of METHODS; links sorted, a missing side is an empty one."""
    if method not in METHODS:
        raise ValueError(f"no method {method}")
    diagonal, final = "diag" in method, "and" if method.endswith("and") else "or" if method.endswith("final") else ""
    pick = {"union": lambda f, g: sorted(f | g), "intersect": lambda f, g: sorted(f & g), "srctotgt": lambda f, g: sorted(f), "tgttosrc": lambda f, g: sorted(g)}
    make = pick.get(method, lambda f, g: K.grow_diag(f, g, diagonal, final))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.append(" ".join(f"{s}-{t}" for s, t in make(*({(x["s"], x["t"]) for x in side or []} for side in (f, g)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row_id", "align"])

    return both.select("row_id", "forward", "backward").mapInArrow(run, "row_id bigint, align string")


_ORIENT = [(side, k) for side, ks in (("prev", "mso"), ("next", "tnp")) for k in ks]


def count_by_align(occurrences: DataFrame, oriented: bool = True) -> DataFrame:
    """(src, tgt, align, c[, m, s, o, t, n, p])"""
    six = [F.count(F.when(F.col(side) == k, 1)).alias(k) for side, k in _ORIENT] if oriented else []
    return occurrences.groupBy("src", "tgt", "align").agg(F.count(F.lit(1)).alias("c"), *six)


def best_align(counted: DataFrame, oriented: bool = True) -> DataFrame:
    """(src, tgt, align, c[, six]): the alignment of the highest count (ties: the smallest as text) and sums over all of the pair's alignments."""
    six = [F.sum(k).alias(k) for _, k in _ORIENT] if oriented else []
    return counted.groupBy("src", "tgt").agg(F.min_by("align", F.struct(-F.col("c"), F.col("align"))).alias("align"), F.sum("c").alias("c"), *six)


def with_totals(pairs: DataFrame) -> DataFrame:
    """Adds per side: tc, te (summed counts), dc, de (distinct partners), and partners by count 1, 2, more. The marginals are folded map-side and joined; a frequent phrase is no window of its own."""
    n = lambda c: F.count(F.when(c, 1))
    out = pairs
    for key, x in (("src", "c"), ("tgt", "e")):
        m = pairs.groupBy(key).agg(F.sum("c").alias(f"t{x}"), F.count(F.lit(1)).alias(f"d{x}"), n(F.col("c") == 1).alias(f"{x}1"), n(F.col("c") == 2).alias(f"{x}2"), n(F.col("c") > 2).alias(f"{x}3"))
        out = out.join(m, key)
    return out


def reorder_probs(pairs: DataFrame) -> DataFrame:
    """Orientation shares of either side after adding one to each count."""
    out = []
    for ks in ("mso", "tnp"):
        total = sum((F.col(k) for k in ks), F.lit(3))
        out += [((F.col(k) + 1) / total).alias(k) for k in ks]
    return pairs.select("src", "tgt", *out)


def word_pairs(bitext: DataFrame) -> DataFrame:
    """(s, t, c): linked words; an unaligned word stands with the null word. One scan."""
    linked = F.transform("links", lambda x: F.struct(F.get("src", x["s"]).alias("s"), F.get("tgt", x["t"]).alias("t")))
    free = lambda side, k: F.expr(f"filter(transform({side}, (w, i) -> if(exists(links, x -> x.{k} = i), null, w)), w -> w is not null)")
    null = F.lit(NULL)
    free_s = F.transform(free("src", "s"), lambda w: F.struct(w.alias("s"), null.alias("t")))
    free_t = F.transform(free("tgt", "t"), lambda w: F.struct(null.alias("s"), w.alias("t")))
    return bitext.select(F.explode(F.concat(linked, free_s, free_t)).alias("x")).groupBy("x.s", "x.t").agg(F.count(F.lit(1)).alias("c"))


def conditional(pairs: DataFrame, given: str, count: str = "c", least: float | None = None) -> DataFrame:
    """Adds p, the share of each row in its ``given`` columns' total; shares up to ``least`` are left out."""
    keys = given.split()
    total = pairs.groupBy(*keys).agg(F.sum(count).alias("__total"))
    out = pairs.join(total, keys).withColumn("p", F.col(count) / F.col("__total")).drop("__total")
    return out if least is None else out.where(F.col("p") > least)


def lexical_weight(pairs: DataFrame, lexicon: DataFrame, reverse: bool = False, name: str = "lex") -> DataFrame:
    """(src, tgt, lex): product over target words of the mean p(t|s) of their linked source words; an unlinked word has p(t|null), or 1 where there is none. ``reverse`` swaps the sides."""
    lex = lexicon.select("s", "t", F.col("p").alias("q" if reverse else "p"))
    return _weights(pairs, lex, (1,) if reverse else (0,)).select("src", "tgt", F.col("lex_rev" if reverse else "lex").alias(name))


def _weights(pairs: DataFrame, lex: DataFrame, sides: tuple[int, ...]) -> DataFrame:
    """(src, tgt, lex, lex_rev) from a lexicon (s, t, p = p(t|s), q = p(s|t)): the word pairs of both directions are looked up in one join. A side that isn't asked for has weight 1."""
    w = pairs.select("src", "tgt", F.split("src", " ").alias("a"), F.split("tgt", " ").alias("b"), F.transform(F.filter(F.split("align", " "), lambda x: x != ""), lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("s"), F.split(x, "-")[1].cast("int").alias("t"))).alias("al"))
    words = []
    for side, (to, by) in enumerate((("b", "t"), ("a", "s"))):
        if side not in sides:
            continue
        own, other, get = F.col(to), F.col("a" if side == 0 else "b"), "s" if side == 0 else "t"

        def one(x, at):
            from_ = F.transform(F.filter("al", lambda y: y[by] == at), lambda y: F.get(other, y[get]))
            from_ = F.when(F.size(from_) > 0, from_).otherwise(F.array(F.lit(NULL)))
            return F.transform(from_, lambda z: F.struct(F.lit(side).alias("side"), at.alias("at"), (z if side == 0 else x).alias("s"), (x if side == 0 else z).alias("t")))

        words.append(F.flatten(F.transform(own, one)))
    x = w.select("src", "tgt", F.explode(F.concat(*words)).alias("x")).select("src", "tgt", "x.*")
    j = x.join(lex, ["s", "t"], "left")
    have = {c for c in lex.columns}
    p = F.when(F.col("side") == 0, F.col("p") if "p" in have else F.lit(None)).otherwise(F.col("q") if "q" in have else F.lit(None))
    free = F.when(F.col("side") == 0, F.col("s")).otherwise(F.col("t")) == NULL
    each = j.groupBy("src", "tgt", "side", "at").agg(F.avg(F.coalesce(p, F.when(free, 1.0).otherwise(0.0))).alias("w"))
    return each.groupBy("src", "tgt").agg(F.coalesce(F.product(F.when(F.col("side") == 0, F.col("w"))), F.lit(1.0)).alias("lex"), F.coalesce(F.product(F.when(F.col("side") == 1, F.col("w"))), F.lit(1.0)).alias("lex_rev"))


def lexical_weights(pairs: DataFrame, lex: DataFrame, lex_rev: DataFrame) -> DataFrame:
    """(src, tgt, lex, lex_rev) of both directions, in one pass."""
    both = lex.select("s", "t", "p").join(lex_rev.select("s", "t", F.col("p").alias("q")), ["s", "t"], "full")
    return _weights(pairs, both, (0, 1))


def count_fit(pairs: DataFrame, below: int = 1000) -> DataFrame:
    """One row: the count-weighted log-log line of the counts of counts (a, b) and the sum of r N_r."""
    cc = pairs.groupBy(F.col("c").alias("r")).agg(F.count(F.lit(1)).alias("nr"))
    x, y, r = F.ln(F.col("r").cast("double")), F.ln(F.col("nr").cast("double")), F.col("r").cast("double")
    s = lambda c: F.sum(F.when(F.col("r") < below, r * c).otherwise(0.0))
    g = cc.agg(s(F.lit(1.0)).alias("m"), s(x * y).alias("xy"), s(x).alias("x"), s(y).alias("y"), s(x * x).alias("xx"), F.sum(F.col("r") * F.col("nr")).alias("every"))
    a = F.coalesce(F.try_divide(F.col("m") * F.col("xy") - F.col("x") * F.col("y"), F.col("m") * F.col("xx") - F.col("x") * F.col("x")), F.lit(0.0))
    return g.withColumn("a", a).select("a", F.try_divide(F.col("y") - F.col("a") * F.col("x"), F.col("m")).alias("b"), "every")


def turing_scores(pairs: DataFrame) -> DataFrame:
    """(src, tgt, phi, phi_rev) with r* = (r + 1) E(N_{r+1}) / E(N_r) up to 1000; the total of a group is the sum of its r* plus its share of exp(b), or its plain total beyond 1000."""
    fit = count_fit(pairs)
    a, b, every = (fit.select(k).scalar() for k in ("a", "b", "every"))
    c = F.col("c").cast("double")
    star = pairs.select("src", "tgt", "c", F.when(c > 1000, c).otherwise((c + 1) * F.pow((c + 1) / c, a)).alias("star"))
    out = star
    for key, name in (("src", "phi"), ("tgt", "phi_rev")):
        t = star.groupBy(key).agg(F.sum("c").alias("plain"), F.sum("star").alias("stars"))
        t = t.select(key, F.when(F.col("plain") > 1000, F.col("plain").cast("double")).otherwise(F.col("stars") + F.col("plain") / every * F.exp(b)).alias("total"))
        out = out.join(t, key).withColumn(name, F.col("star") / F.col("total")).drop("total")
    return out.select("src", "tgt", "phi", "phi_rev")


def kneser_ney_scores(pairs: DataFrame, modified: bool = False) -> DataFrame:
    """(src, tgt, phi, phi_rev): discounted relative frequencies, the freed mass spread by the other side's diversity over all distinct pairs."""
    cc = [pairs.agg(F.greatest(F.count(F.when(F.col("c") == k, 1)), F.lit(1)).cast("double")).scalar() for k in range(1, 5)]
    every = pairs.agg(F.count(F.lit(1))).scalar()
    y = cc[0] / (cc[0] + 2 * cc[1])
    d1, d2, d3 = (k - (k + 1) * y * cc[k] / cc[k - 1] for k in (1, 2, 3))
    c = F.col("c")
    out = []
    for x, o, name in (("c", "e", "phi"), ("e", "c", "phi_rev")):
        total, other = F.col(f"t{x}"), F.col(f"d{o}") / every
        if modified:
            d = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
            mass = d1 * F.col(f"{x}1") + d2 * F.col(f"{x}2") + d3 * F.col(f"{x}3")
        else:
            d, mass = y, y * F.col(f"d{x}")
        out.append(((c - d) / total + mass / total * other).alias(name))
    return with_totals(pairs).select("src", "tgt", *out)


def phrase_table(pairs: DataFrame, lex: DataFrame, lex_rev: DataFrame) -> DataFrame:
    """(src, tgt, phi_rev, lex_rev, phi, lex, penalty)"""
    j = with_totals(pairs).join(lexical_weights(pairs, lex, lex_rev), ["src", "tgt"])
    return j.select("src", "tgt", (F.col("c") / F.col("te")).alias("phi_rev"), "lex_rev", (F.col("c") / F.col("tc")).alias("phi"), "lex", F.lit(2.718).alias("penalty"))


def rule_table(rules_: DataFrame, lex: DataFrame, lex_rev: DataFrame, direction: str = "c2e", cutoff: int = 0) -> DataFrame:
    """Scored rules above the cutoff, with -1/count as a further feature; non-terminals don't enter lexical weights."""
    pairs = with_totals(rules_).where(F.col("c") > cutoff)
    slot = lambda k: F.when(F.col(k).rlike(r"^#\d*$"), 1.0)
    j = pairs.join(lexical_weights(pairs, _slots(pairs, lex, slot), _slots(pairs, lex_rev, slot)), ["src", "tgt"])
    score = {"phi_rev": F.col("c") / F.col("te"), "phi": F.col("c") / F.col("tc"), "lex": F.col("lex"), "lex_rev": F.col("lex_rev")}
    order = ("phi_rev", "lex_rev", "phi", "lex") if direction == "c2e" else ("phi", "lex", "phi_rev", "lex_rev")
    a, b = ("src", "tgt") if direction == "c2e" else ("tgt", "src")
    return j.select(F.col(a).alias("lhs"), F.col(b).alias("rhs"), *(score[k].alias(f"f{i}") for i, k in enumerate(order, 1)), F.lit(2.718).alias("penalty"), (-1 / F.col("c")).alias("rarity"))


def _slots(pairs: DataFrame, lex: DataFrame, slot) -> DataFrame:
    """The lexicon without rows of the null word for slots: an unlinked slot then counts 1."""
    return lex.where(slot("s").isNull() & slot("t").isNull())


def reorder_joined(table: DataFrame, probs: DataFrame) -> DataFrame:
    """Phrase scores in the order 2, 3, 0, 1 beside the six orientation shares."""
    return table.select("src", "tgt", F.col("phi").alias("f0"), F.col("lex").alias("f1"), F.col("phi_rev").alias("f2"), F.col("lex_rev").alias("f3")).join(probs, ["src", "tgt"])


def presorted(rows: DataFrame, name: str) -> DataFrame:
    """(name, place): lines ``src ||| tgt ||| text`` of rows (src, tgt, text), numbered from 1 in the order of their pairs, by range partitions."""
    r = rows.select(F.concat_ws(T.RESERVED, "src", "tgt", "text").alias(name), "src", "tgt")
    return numbered(r, ["src", "tgt"], "place").select(name, "place")


def tag_weights(df: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """(keys, tag, weight): a histogram of ``tag weight;tag weight`` strings, summed by key."""
    t = df.where(F.col(tags).isNotNull()).select(*keys, F.explode(F.split(tags, ";")).alias("x"))
    t = t.select(*keys, F.split_part("x", F.lit(" "), F.lit(1)).alias("tag"), F.split_part("x", F.lit(" "), F.lit(2)).cast("bigint").alias("weight"))
    return t.groupBy(*keys, "tag").agg(F.sum("weight").alias("weight"))


def heap_heads(size: Column) -> Column:
    """Heads of a balanced tree over the positions."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.when(k == 0, -1).otherwise(F.floor((k - 1) / 2).cast("int")))


def span_kinds(df: DataFrame, longest: int = 5) -> DataFrame:
    """(row_id, start, end, kind) of all spans up to ``longest`` words over rows with ``heads``, by column expressions alone."""
    spans = df.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("heads") - 1)))
    spans = spans.withColumn("end", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (longest - 1), F.size("heads") - 1))))
    spans = spans.withColumn("roots", F.expr("filter(sequence(start, end), k -> heads[k] < start or heads[k] > end)"))
    spans = spans.withColumn("hang", F.expr("array_distinct(filter(transform(heads, (h, k) -> if((k < start or k > end) and h >= start and h <= end, h, null)), h -> h is not null))"))
    over = F.expr("size(array_distinct(transform(roots, k -> heads[k])))")
    fixed = (F.size("roots") == 1) & (F.size(F.array_except("hang", "roots")) == 0)
    kind = F.when(fixed, "fixed").when((over == 1) & (F.size("hang") == 0), "floating").otherwise("none")
    return spans.select("row_id", "start", "end", kind.alias("kind"))


def chunks(df: DataFrame, tags: str) -> DataFrame:
    """(row_id, start, length, tag): runs of equal tags within a row."""
    starts = F.expr(f"filter(sequence(0, size({tags}) - 1), i -> i = 0 or {tags}[i] <> {tags}[i - 1])")
    s = df.select("row_id", F.col(tags).alias("tags"), starts.alias("starts")).select("row_id", "tags", "starts", F.posexplode("starts").alias("k", "start"))
    end = F.coalesce(F.get("starts", F.col("k") + 1), F.size("tags"))
    return s.select("row_id", "start", (end - F.col("start")).alias("length"), F.get("tags", F.col("start")).alias("tag"))


def dependency_items(text: Column) -> Column:
    """``(i,p,LABEL)`` items as (word, head, label)."""
    part = lambda x, k: F.regexp_extract(x, r"\((-?\d+),(-?\d+),([^)]*)\)", k)
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(-?\d+,-?\d+,[^)]*\)"), F.lit(0)), lambda x: F.struct(part(x, 1).cast("int").alias("word"), part(x, 2).cast("int").alias("head"), part(x, 3).alias("label")))


def dependency_lines(df: DataFrame, text: str) -> DataFrame:
    """(row_id, at, token, tag, head) from one tab-separated line a word."""
    one = df.select("row_id", F.posexplode(F.split(text, "\n")).alias("at", "line")).where("line <> ''")
    f = F.split("line", "\t")
    return one.select("row_id", "at", f[0].alias("token"), f[1].alias("tag"), f[2].cast("int").alias("head"))
