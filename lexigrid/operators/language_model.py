"""n-gram counts and language models: Good-Turing, Stupid Backoff, Kneser-Ney and Modified Kneser-Ney.

Tables have (n, gram, logp, bow). ``variant="reference"`` keeps the formulas of the system this one replaces, ``"standard"`` has the published ones.
Nothing is brought to the driver: discounts, slopes and totals are one row an order, joined by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions import text as T

ALPHA = 0.4
SMOOTH_BELOW = 1000


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty line: its tokens between <s> and </s>."""
    line = docs.select(text).select(F.explode(T.lines(text)).alias("line")).where(F.length("line") > 0)
    return line.select(T.wrap(T.tokens("line")).alias("w"))


def ngram_counts(sents: DataFrame, high: int, low: int = 1) -> DataFrame:
    """(n, gram, c): one pass and one shuffle for all orders; map-side sums first."""
    g = sents.select(F.explode(T.ngrams("w", low, high)).alias("g"))
    return g.groupBy(F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("c"))


def split_history(counts: DataFrame) -> DataFrame:
    return counts.withColumn("hist", T.history("gram")).withColumn("word", T.last_word("gram"))


def type_counts(counts: DataFrame) -> DataFrame:
    """(n, types, tokens)"""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("tokens"))


def count_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n", F.col("c").alias("r")).agg(F.count(F.lit(1)).alias("nr"))


def history_stats(counts: DataFrame) -> DataFrame:
    """(n, hist, total, followers, n1, n2, n3): of histories of orders n >= 2, with followers by count 1, 2 and more. All states add up, so a history with very many followers is folded map-side."""
    bucket = lambda c: F.count(F.when(c, 1))
    h = split_history(counts.where("n > 1"))
    return h.groupBy("n", "hist").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("followers"), bucket(F.col("c") == 1).alias("n1"), bucket(F.col("c") == 2).alias("n2"), bucket(F.col("c") > 2).alias("n3"))


def continuation(counts: DataFrame) -> DataFrame:
    """(word, preceding, p): distinct predecessors of each word over all bigram types."""
    b = split_history(counts.where("n = 2"))
    types = b.agg(F.count(F.lit(1))).scalar()
    per = b.groupBy("word").agg(F.count(F.lit(1)).alias("preceding"))
    return per.select("word", "preceding", (F.col("preceding") / types).alias("p"))


# Stupid Backoff


def backoff_unigrams(counts: DataFrame, variant: str = "reference") -> DataFrame:
    uni = counts.where("n = 1")
    v = uni.agg((F.count(F.lit(1)) if variant == "reference" else F.sum("c")).alias("v"))
    bow = F.when(F.col("gram") == "</s>", 0.0).otherwise(F.log10(F.lit(ALPHA)))
    logp = F.when(F.col("gram") == "<s>", 0.0).otherwise(T.ratio(F.col("c"), v.scalar()))
    rows = uni.select("n", "gram", logp.alias("logp"), bow.alias("bow"))
    unk = v.where("v > 0").select(F.lit(1).alias("n"), F.lit("unk").alias("gram"), (-F.log10("v")).alias("logp"), F.lit(0.0).alias("bow"))
    return rows.unionByName(unk)


def backoff_ngrams(counts: DataFrame, high: int) -> DataFrame:
    """Orders 2 to high: log10 c(hw) - log10 c(h.). Totals by history are folded before they are joined, so a frequent history is no window of its own."""
    h = split_history(counts.where("n > 1"))
    totals = h.groupBy("n", "hist").agg(F.sum("c").alias("total"))
    bow = F.when(F.col("n") < high, F.log10(F.lit(ALPHA)))
    return h.join(totals, ["n", "hist"]).select("n", "gram", T.ratio(F.col("c"), F.col("total")).alias("logp"), bow.alias("bow"))


def stupid_backoff(counts: DataFrame, high: int, variant: str = "reference") -> DataFrame:
    return backoff_unigrams(counts, variant).unionByName(backoff_ngrams(counts, high))


# Good-Turing


def turing_fit(counts: DataFrame, variant: str = "reference", weighted: bool = False) -> DataFrame:
    """(n, slope, total, n1) of the log-log line of each order over r < 1000. Weighted: every point counts r times."""
    x, y = F.ln(F.col("r").cast("double")), F.ln(F.col("nr").cast("double"))
    inside = F.col("r") < SMOOTH_BELOW
    wt = F.col("r").cast("double") if weighted else F.lit(1.0)
    s = lambda c: F.sum(F.when(inside, wt * c).otherwise(0.0))
    m = F.count(F.lit(1)).cast("double") if variant == "reference" and not weighted else s(F.lit(1.0))
    a = count_of_counts(counts).groupBy("n").agg(m.alias("m"), s(x * y).alias("xy"), s(x).alias("x"), s(y).alias("y"), s(x * x).alias("xx"), F.sum(F.col("r") * F.col("nr")).alias("total"), F.sum(F.when(F.col("r") == 1, F.col("nr")).otherwise(0)).alias("n1"))
    cross = F.col("xy") * F.col("y") if variant == "reference" and not weighted else F.col("x") * F.col("y")
    slope = F.try_divide(F.col("m") * F.col("xy") - cross, F.col("m") * F.col("xx") - F.col("x") * F.col("x"))
    return a.select("n", F.coalesce(slope, F.lit(0.0)).alias("slope"), "total", "n1")


def turing_count(r, slope):
    """r* = r (1 + 1/r)^slope up to the bound, r above it."""
    return F.when(r > SMOOTH_BELOW, r.cast("double")).otherwise(r * F.pow(1 + 1 / r.cast("double"), slope))


def good_turing(counts: DataFrame, variant: str = "reference") -> DataFrame:
    fit = turing_fit(counts, variant)
    j = counts.join(F.broadcast(fit), "n")
    return j.select("n", "gram", T.ratio(turing_count(F.col("c"), F.col("slope")), F.col("total")).alias("logp"), F.lit(None).cast("double").alias("bow"))


def turing_direct(counts: DataFrame) -> DataFrame:
    """(n, r, adjusted) by (r + 1) N_{r+1} / N_r, null where no gram occurs r + 1 times."""
    nxt = F.lead(F.struct("r", "nr")).over(W.partitionBy("n").orderBy("r"))
    a = count_of_counts(counts).withColumn("nxt", nxt)
    return a.select("n", "r", F.when(F.col("nxt.r") == F.col("r") + 1, (F.col("r") + 1) * F.col("nxt.nr") / F.col("nr")).alias("adjusted"))


# Kneser-Ney


def discounts(counts: DataFrame, variant: str = "reference") -> DataFrame:
    """(n, d, d1, d2, d3) of each order; an absent count of counts is 1. The reference has 1 - 2Y n_{k+1} / n_k for each of the three, the standard k - (k+1)Y n_{k+1} / n_k."""
    nk = [F.coalesce(F.sum(F.when(F.col("r") == k, F.col("nr"))), F.lit(1)).cast("double").alias(f"m{k}") for k in range(1, 5)]
    m = [F.col(f"m{k}") for k in range(1, 5)]
    y = m[0] / (m[0] + 2 * m[1])
    d = [(1 - 2 * y * m[k] / m[k - 1]) if variant == "reference" else (k - (k + 1) * y * m[k] / m[k - 1]) for k in range(1, 4)]
    return count_of_counts(counts).groupBy("n").agg(*nk).select("n", y.alias("d"), *(x.alias(f"d{k}") for k, x in enumerate(d, 1)))


def adjusted(counts: DataFrame, high: int) -> DataFrame:
    """(n, gram, c) for the published models: below the top order a gram's count is its number of distinct predecessors; grams that nothing precedes (those with <s>) keep theirs. One exchange."""
    own = counts.where(F.col("n") <= high).select("n", "gram", "c", F.lit(0).cast("bigint").alias("before"))
    up = counts.where((F.col("n") > 1) & (F.col("n") <= high)).select((F.col("n") - 1).alias("n"), T.shorter("gram").alias("gram"), F.lit(0).cast("bigint").alias("c"), F.lit(1).cast("bigint").alias("before"))
    g = own.unionByName(up).groupBy("n", "gram").agg(F.sum("c").alias("c"), F.sum("before").alias("before"))
    return g.select("n", "gram", F.when((F.col("n") < high) & (F.col("before") > 0), F.col("before")).otherwise(F.col("c")).alias("c"))


def _discounted(counts: DataFrame, modified: bool, variant: str) -> DataFrame:
    """(n, gram, hist, first, bow) of orders n >= 2: the discounted relative frequency and the weight of the lower order."""
    h = split_history(counts.where("n > 1"))
    stats, dis = history_stats(counts), F.broadcast(discounts(counts, variant))
    j = h.join(stats, ["n", "hist"]).join(dis, "n")
    c, total = F.col("c"), F.col("total").cast("double")
    if not modified:
        d, mass = F.col("d"), F.col("d") * F.col("followers")
    elif variant == "reference":
        d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).when(c == 3, F.col("d3")).otherwise(0.0)
        mass = F.greatest(F.col("d1"), F.lit(0.0)) * F.col("followers")
    else:
        d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        mass = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
    return j.select("n", "gram", "hist", (F.greatest(c - d, F.lit(0.0)) / total).alias("first"), (mass / total).alias("bow"))


def interpolated(counts: DataFrame, high: int, modified: bool = False, variant: str = "reference") -> dict[int, DataFrame]:
    """Order -> (gram, p): P = max(c - D, 0) / c(h) + bow(h) P_lower. The reference's lower order is that of the history with c / types below it all; the standard one has
    distinct predecessors for counts at all lower orders, drops the first word and ends in the continuation unigrams."""
    uni = counts.where("n = 1")
    if variant == "reference":
        p = uni.select("gram", (F.col("c") / uni.agg(F.count(F.lit(1))).scalar()).alias("p"))
    else:
        p = uni.select("gram").join(continuation(counts), F.col("gram") == F.col("word"), "left").select("gram", F.coalesce("p", F.lit(0.0)).alias("p"))
    out, parts = {1: p}, _discounted(counts if variant == "reference" else adjusted(counts, high), modified, variant)
    for n in range(2, high + 1):
        lower = out[n - 1].select(F.col("gram").alias("low"), F.col("p").alias("low_p"))
        at = F.col("hist") if variant == "reference" else T.shorter("gram")
        a = parts.where(F.col("n") == n).withColumn("low", at)
        out[n] = a.join(lower, "low").select("gram", (F.col("first") + F.col("bow") * F.col("low_p")).alias("p"))
    return out


def kneser_ney(counts: DataFrame, high: int, modified: bool = False, variant: str = "reference") -> DataFrame:
    """The whole table. <s> has log probability 0, </s> weight 0; a gram that is no history has weight log10 1; the top order has none; unk has 1 / types
    (of bigrams in the reference, of unigrams in the standard); a table in which a unigram has no weight gets </s> with log10 0.5 in the reference."""
    counts = counts.where(F.col("n") <= high)
    p = interpolated(counts, high, modified, variant)
    weights = _discounted(counts if variant == "reference" else adjusted(counts, high), modified, variant).select(F.col("n").alias("above"), "hist", "bow").dropDuplicates(["above", "hist"])
    parts = []
    for n in range(1, high + 1):
        log = F.when(F.col("p") > 0, F.log10("p"))
        if n == 1:
            log = F.when(F.col("gram") == "<s>", 0.0).otherwise(log)
        if n == high:
            parts.append(p[n].select(F.lit(n).alias("n"), "gram", log.alias("logp"), F.lit(None).cast("double").alias("bow")))
            continue
        w = weights.where(F.col("above") == n + 1).select("hist", F.col("bow").alias("weight"))
        how = "inner" if n == 1 and variant == "reference" else "left"
        bow = F.when(F.col("weight") > 0, F.log10("weight")).otherwise(0.0)
        if n == 1:
            bow = F.when(F.col("gram") == "</s>", 0.0).otherwise(bow)
        parts.append(p[n].join(w, F.col("gram") == F.col("hist"), how).select(F.lit(n).alias("n"), "gram", log.alias("logp"), bow.alias("bow")))
    types = type_counts(counts)
    unk = types.where(F.col("n") == (min(2, high) if variant == "reference" else 1)).select(F.lit(1).alias("n"), F.lit("unk").alias("gram"), (-F.log10("types")).alias("logp"), F.lit(0.0).alias("bow"))
    parts.append(unk)
    if variant == "reference" and high > 1:
        uni = counts.where("n = 1").join(weights.where("above = 2"), F.col("gram") == F.col("hist"), "left_anti").limit(1)
        parts.append(uni.select(F.lit(1).alias("n"), F.lit("</s>").alias("gram"), F.lit(0.5).alias("half")).select("n", "gram", F.log10("half").alias("logp"), F.lit(0.0).alias("bow")))
    return reduce(DataFrame.unionByName, parts)


def arpa(table: DataFrame) -> DataFrame:
    """Rows as text: log probability (empty for a gram of probability 0), gram and, where there is one, the weight, with tabs between."""
    six = lambda c: F.format_string("%.6f", c)
    return table.select("n", F.concat_ws("\t", F.when(F.col("logp").isNotNull(), six("logp")).otherwise(""), "gram", F.when(F.col("bow").isNotNull(), six("bow"))).alias("line"))


# Perplexity


def events(sents: DataFrame, high: int) -> DataFrame:
    """(event, word, h1, h2, ...): every word after the first with its histories of up to high - 1 words; h_k is null where fewer precede it."""
    s = sents.withColumn("sid", F.monotonically_increasing_id())
    e = s.select("sid", "w", F.posexplode("w").alias("at", "word")).where("at > 0")
    hist = [F.when(F.col("at") >= k, F.array_join(F.slice("w", F.col("at") - k + 1, k), " ")).alias(f"h{k}") for k in range(1, high)]
    return e.select("sid", "at", "word", *hist)


def _probe(e: DataFrame, table: DataFrame, high: int) -> DataFrame:
    """The events with p_k (log10 of the k-gram, null where it isn't in the table) and b_k (weight of the history of k words)."""
    for k in range(1, high + 1):
        key = F.col("word") if k == 1 else F.concat_ws(" ", F.col(f"h{k - 1}"), "word")
        key = key if k == 1 else F.when(F.col(f"h{k - 1}").isNotNull(), key)
        t = table.where(F.col("n") == k).select(F.col("gram").alias(f"g{k}"), F.col("logp").alias(f"p{k}"))
        e = e.withColumn("key", key).join(t, F.col("key") == F.col(f"g{k}"), "left").drop(f"g{k}", "key")
        if k < high:
            b = table.where(F.col("n") == k).select(F.col("gram").alias(f"g{k}"), F.col("bow").alias(f"b{k}"))
            e = e.join(b, F.col(f"h{k}") == F.col(f"g{k}"), "left").drop(f"g{k}")
    return e


def backed_off(e: DataFrame, table: DataFrame, high: int, unk: DataFrame) -> DataFrame:
    """(logp) of each event by log10 P(w|h), or the history's weight added to the shorter history's, down to the unknown word."""
    e = _probe(e, table, high)
    score = F.coalesce(F.col("p1"), unk.scalar())
    for k in range(2, high + 1):
        lower = F.coalesce(F.col(f"b{k - 1}"), F.lit(0.0)) + score
        score = F.when(F.col(f"h{k - 1}").isNull(), score).otherwise(F.coalesce(F.col(f"p{k}"), lower))
    return e.select(score.alias("logp"))


def stupid_score(e: DataFrame, table: DataFrame, high: int, unk: DataFrame) -> DataFrame:
    """Like backed_off with 0.4 for each word by which the history is cut."""
    e = _probe(e, table, high)
    score = F.coalesce(F.col("p1"), unk.scalar())
    for k in range(2, high + 1):
        score = F.when(F.col(f"h{k - 1}").isNull(), score).otherwise(F.coalesce(F.col(f"p{k}"), F.log10(F.lit(ALPHA)) + score))
    return e.select(score.alias("logp"))


def turing_score(e: DataFrame, table: DataFrame, high: int, fit: DataFrame) -> DataFrame:
    """log10 P of the longest gram of each event, the mass of unseen grams n1 / total where it isn't in the table."""
    k = F.lit(1)
    key = F.col("word")
    for n in range(2, high + 1):
        key = F.when(F.col(f"h{n - 1}").isNotNull(), F.concat_ws(" ", F.col(f"h{n - 1}"), "word")).otherwise(key)
        k = F.when(F.col(f"h{n - 1}").isNotNull(), n).otherwise(k)
    e = e.select(key.alias("key"), k.alias("order"))
    j = e.join(table.select("n", "gram", "logp"), (F.col("n") == F.col("order")) & (F.col("gram") == F.col("key")), "left").drop("n")
    j = j.join(F.broadcast(fit.select(F.col("n").alias("of"), T.ratio(F.col("n1"), F.col("total")).alias("unseen"))), F.col("order") == F.col("of"), "left")
    return j.select(F.coalesce("logp", "unseen").alias("logp"))


def perplexity(scores: DataFrame) -> DataFrame:
    """(tokens, perplexity): 10 to minus the mean log10 probability."""
    return scores.agg(F.count(F.lit(1)).alias("tokens"), F.pow(F.lit(10.0), -F.avg("logp")).alias("perplexity"))
