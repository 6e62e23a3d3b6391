"""Word alignment: initial tables, IBM models 1 and 2, the hidden Markov model, training schedules, count-table normalisation, word classes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrid.functions.written import written
from lexigrid.operators import kernels as K
from lexigrid.operators.translation import NULL, conditional, symmetrised

FLOOR = 1e-7


def cooccurring(bitext: DataFrame) -> DataFrame:
    """(row_id, j, t, s): every target word with each word of its own sentence's source side and the null word."""
    t = bitext.select("row_id", F.concat(F.array(F.lit(NULL)), "src").alias("src"), F.posexplode("tgt").alias("j", "t"))
    return t.select("row_id", "j", "t", F.explode("src").alias("s"))


def cooccurrence_pairs(bitext: DataFrame) -> DataFrame:
    return cooccurring(bitext).select("s", "t").distinct()


class Frame(NamedTuple):
    """rows (sid, times, rows, cols, j, t, i, s, cell): every target word (place j from 1) with every source word (place i from 1, the null word at 0) of its sentence, sentences that repeat once with their number. hot (s):
    source words of at least 1/64 of the rows, 64 at most, among them the null word; their rows lie in CELLS cells by sentence, all others in cell 0."""

    rows: DataFrame
    hot: DataFrame


CELLS = 16


def frame(bitext: DataFrame, null: bool = True) -> Frame:
    """A model reads the frame in every round, so it is written once."""
    once = bitext.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("times")).select(F.xxhash64("src", "tgt", F.lit(0)).alias("h1"), F.xxhash64("src", "tgt", F.lit(1)).alias("h2"), "times", "src", "tgt")
    t = once.select(F.struct("h1", "h2").alias("sid"), "times", "src", F.size("src").alias("rows"), F.size("tgt").alias("cols"), F.posexplode("tgt").alias("j", "t"))
    source = F.concat(F.array(F.lit(NULL)), "src") if null else F.col("src")
    t = t.select("sid", "times", "rows", "cols", (F.col("j") + 1).alias("j"), "t", F.posexplode(source).alias("i", "s"))
    t = t.withColumn("i", F.col("i") + (0 if null else 1))
    n = t.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    hot = written(n.where(F.col("n") * 64 >= n.agg(F.sum("n")).scalar()).select("s", F.lit(CELLS).alias("cells")).coalesce(1), "hot")
    cell = F.pmod(F.xxhash64("sid"), F.coalesce("cells", F.lit(1))).cast("int")
    return Frame(written(t.join(F.broadcast(hot), "s", "left").withColumn("cell", cell).drop("cells"), "frame"), hot)


def uniform_start(bitext: DataFrame) -> DataFrame:
    """(s, t, p): 1 / distinct target words for every pair that occurs together."""
    return _uniform(cooccurrence_pairs(bitext))


def _uniform(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p", 1 / pairs.agg(F.count_distinct("t")).scalar())


def _shared(weighed: DataFrame) -> DataFrame:
    """Adds ``share``: each target word's unit shared over its sentence's source words by ``w``, times the sentence's number."""
    return weighed.withColumn("share", F.col("times") * F.col("w") / F.sum("w").over(W.partitionBy("sid", "j")))


def _lexical(fr: Frame, table: DataFrame) -> DataFrame:
    """The frame's rows with p(t|s); the table is copied to the cells of hot words."""
    cells = table.join(F.broadcast(fr.hot), "s", "left").select("s", "t", "p", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell"))
    return fr.rows.join(cells, ["s", "t", "cell"]).drop("cell")


def ibm1_step(fr: Frame, table: DataFrame) -> DataFrame:
    """One round of expectation and maximisation. Expected counts: each target word's unit is shared over its sentence's source words by p(t|s)."""
    counts = _shared(_lexical(fr, table).withColumn("w", F.col("p"))).groupBy("s", "t").agg(F.sum("share").alias("c"))
    return conditional(counts, "s").select("s", "t", "p")


def ibm1(bitext: DataFrame, rounds: int, cut_every: int = 5) -> DataFrame:
    """(s, t, p) after so many rounds; lineage is cut by a written table every few rounds."""
    fr = frame(bitext)
    return _ibm1(fr, _uniform(fr.rows.select("s", "t").distinct()), rounds, cut_every)


def _ibm1(fr: Frame, t: DataFrame, rounds: int, cut_every: int = 5) -> DataFrame:
    for k in range(1, rounds + 1):
        t = ibm1_step(fr, t)
        if k % cut_every == 0 and k < rounds:
            t = written(t, "ibm1")
    return t


def ibm2_step(fr: Frame, table: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of model 2: shares go by p(t|s) times the place probability p(i | j, rows, cols). The table of places has no more rows than lengths allow; it is joined by its own size."""
    j = _lexical(fr, table).join(places.select("i", "j", "rows", "cols", F.col("p").alias("at")), ["i", "j", "rows", "cols"])
    shared = written(_shared(j.withColumn("w", F.col("p") * F.col("at"))).select("s", "t", "i", "j", "rows", "cols", "share"), "ibm2")
    t = conditional(shared.groupBy("s", "t").agg(F.sum("share").alias("c")), "s").select("s", "t", "p")
    a = conditional(shared.groupBy("i", "j", "rows", "cols").agg(F.sum("share").alias("c")), "j rows cols").select("i", "j", "rows", "cols", "p")
    return t, a


def ibm2(bitext: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(words (s, t, p), places (i, j, rows, cols, p)) after so many rounds from uniform tables."""
    fr = frame(bitext)
    return _ibm2(fr, _uniform(fr.rows.select("s", "t").distinct()), position_start(bitext), rounds)


def _ibm2(fr: Frame, t: DataFrame, a: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    for _ in range(rounds):
        t, a = ibm2_step(fr, t, a)
    return t, a


def _forward_backward(b: pa.RecordBatch, jumps: dict[int, float]) -> tuple[list, list]:
    """Expected counts of word pairs and of jumps for each sentence of a batch."""
    pairs, steps = [], []
    for times, rows, cols, cells in zip(*(c.to_pylist() for c in b.columns)):
        p = np.zeros((cols, rows))
        names = {}
        for c in cells:
            p[c["j"] - 1, c["i"] - 1] = c["p"]
            names[c["j"] - 1, c["i"] - 1] = (c["s"], c["t"])
        at = np.arange(rows)
        move = np.vectorize(lambda d: jumps.get(d, 0.0), otypes=[float])(at[None, :] - at[:, None])
        move /= np.maximum(move.sum(axis=1, keepdims=True), 1e-300)
        ahead, behind, scale = np.zeros((cols, rows)), np.ones((cols, rows)), np.zeros(cols)
        for j in range(cols):
            x = p[j] * (np.full(rows, 1 / rows) if j == 0 else ahead[j - 1] @ move)
            scale[j] = x.sum()
            if not scale[j]:
                break
            ahead[j] = x / scale[j]
        if not scale.all():
            continue  # no path has a probability
        for j in range(cols - 2, -1, -1):
            behind[j] = move @ (p[j + 1] * behind[j + 1]) / scale[j + 1]
        seen = times * ahead * behind
        pairs += [(*names[k], float(seen[k])) for k in names if seen[k] > 0]
        for j in range(1, cols):
            both = times * ahead[j - 1][:, None] * move * (p[j] * behind[j])[None, :] / scale[j]
            for d in range(1 - rows, rows):
                c = float(np.trace(both, d))
                if c > 0:
                    steps.append((d, c))
    return pairs, steps


def hmm_step(fr: Frame, table: DataFrame, jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of the hidden Markov model over source places without the null word: the first place is uniform, later ones depend on the distance to the last one. Sentences are gathered once with their probabilities
    and run through forward and backward sums in a kernel; the table of distances has at most twice the longest sentence's rows and travels with the tasks."""
    known = {r["d"]: r["p"] for r in jumps.select("d", "p").collect()}
    cells = _lexical(fr, table).groupBy("sid", "times", "rows", "cols").agg(F.collect_list(F.struct("j", "i", "s", "t", "p")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, steps = _forward_backward(b, known)
            s, t, c = zip(*pairs) if pairs else ((), (), ())
            d, e = zip(*steps) if steps else ((), ())
            none = [None] * len(d)
            yield pa.RecordBatch.from_arrays([pa.array([*s, *none], pa.string()), pa.array([*t, *none], pa.string()), pa.array([None] * len(s) + list(d), pa.int32()), pa.array([*c, *e], pa.float64())], names=["s", "t", "d", "c"])

    counts = written(cells.select("times", "rows", "cols", "cells").mapInArrow(run, "s string, t string, d int, c double").groupBy("s", "t", "d").agg(F.sum("c").alias("c")), "hmm")
    return conditional(counts.where("d is null").select("s", "t", "c"), "s").select("s", "t", "p"), normalised_jumps(counts.where("d is not null"))


def jump_distances(longest: int) -> list[int]:
    return list(range(1 - longest, longest))


def normalised_jumps(counts: DataFrame) -> DataFrame:
    """(d, p) of counts (d, c): shares of all jumps."""
    per = counts.groupBy("d").agg(F.sum("c").alias("c"))
    return per.select("d", (F.col("c") / per.agg(F.sum("c")).scalar()).alias("p"))


def normalised_classes(counts: DataFrame) -> DataFrame:
    """(sc, tc, d, p) of distortion counts by source and target class: shares of each pair of classes, those up to 1e-7 left out."""
    return conditional(counts.groupBy("sc", "tc", "d").agg(F.sum("c").alias("c")), "sc tc", least=FLOOR).select("sc", "tc", "d", "p")


def hmm(bitext: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(words (s, t, p), jumps (d, p)) after so many rounds from uniform tables."""
    fr = frame(bitext, False)
    return _hmm(fr, _uniform(fr.rows.select("s", "t").distinct()), uniform_jumps(bitext), rounds)


def uniform_jumps(bitext: DataFrame) -> DataFrame:
    top = bitext.agg(F.max(F.size("src")).alias("m")).where("m is not null")
    return top.select(F.explode(F.sequence(1 - F.col("m"), F.col("m") - 1)).alias("d"), (1 / (2 * F.col("m") - 1)).alias("p"))


def _hmm(fr: Frame, t: DataFrame, jumps: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    for _ in range(rounds):
        t, jumps = hmm_step(fr, t, jumps)
    return t, jumps


def trained(bitext: DataFrame, schedule: str) -> DataFrame:
    """(s, t, p) after a training schedule such as ``1***2**H*``: each model starts from the words of the one before, model 2 from uniform places and the hidden Markov model from uniform jumps.

    The first model runs twice at least, as there is nothing to start from. Models 3 and 4 have count tables here (fertilities, positions, classes) but no expectation.
    """
    t, fresh = None, not schedule.startswith("P")
    for k, (model, rounds) in enumerate(K.schedule(schedule)):
        if model in "34":
            raise ValueError(f"model {model} has no expectation here")
        fr = frame(bitext, model != "H")
        if t is None:
            t = _uniform(fr.rows.select("s", "t").distinct())
            rounds = max(2, rounds) if fresh and model == "1" else rounds
        elif model == "H":
            t = conditional(t.where(F.col("s") != NULL).withColumnRenamed("p", "c"), "s").select("s", "t", "p")
        t = {"1": lambda: _ibm1(fr, t, rounds), "2": lambda: _ibm2(fr, t, position_start(bitext), rounds)[0], "H": lambda: _hmm(fr, t, uniform_jumps(bitext), rounds)[0]}[model]()
        t = written(t, f"trained-{k}")
    return t


def best_links(bitext: DataFrame, table: DataFrame) -> DataFrame:
    """(row_id, j, i): for each target word (place j from 0) the source word (place i from 0) of highest p(t|s), of the first place among equals (to nine digits); words that the null word explains best have no link."""
    fr = bitext.select("row_id", F.concat(F.array(F.lit(NULL)), "src").alias("src"), F.posexplode("tgt").alias("j", "t")).select("row_id", "j", "t", F.posexplode("src").alias("i", "s"))
    best = fr.join(table, ["s", "t"]).groupBy("row_id", "j").agg(F.min_by("i", F.struct(-F.round("p", 9), F.col("i"))).alias("i"))
    return best.where("i > 0").select("row_id", "j", (F.col("i") - 1).alias("i"))


def aligned(bitext: DataFrame, schedule: str = "1***", method: str = "grow-diag-final-and") -> DataFrame:
    """(row_id, align): both directions trained, linked and symmetrised."""
    turned = bitext.select("row_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    one = best_links(bitext, trained(bitext, schedule)).select("row_id", F.col("i").alias("s"), F.col("j").alias("t"), F.lit(0).alias("side"))
    two = best_links(turned, trained(turned, schedule)).select("row_id", F.col("j").alias("s"), F.col("i").alias("t"), F.lit(1).alias("side"))
    side = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct("s", "t")))
    both = one.unionByName(two).groupBy("row_id").agg(side(0).alias("forward"), side(1).alias("backward"))
    return symmetrised(bitext.select("row_id").join(both, "row_id", "left"), method)


def position_start(bitext: DataFrame) -> DataFrame:
    """(i, j, rows, cols, p): 1 / (rows + 1) for every pair of places (0 is the null word) of every pair of lengths."""
    sizes = bitext.select(F.size("src").alias("rows"), F.size("tgt").alias("cols")).distinct()
    i = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), "rows"))).withColumn("j", F.explode(F.sequence(F.lit(1), "cols")))
    return i.select("i", "j", "rows", "cols", (1 / (F.col("rows") + 1)).alias("p"))


def jump_start(bitext: DataFrame) -> DataFrame:
    """(i, k, logp): equal log probability of a step from place i to place k, for places up to the longest source side; i = 0 is the beginning."""
    top = bitext.agg(F.max(F.size("src")).alias("m"))
    i = top.where("m is not null").withColumn("i", F.explode(F.sequence(F.lit(0), "m"))).withColumn("k", F.explode(F.sequence(F.lit(1), "m")))
    return i.select("i", "k", (-F.ln("m")).alias("logp"))


def normalised_pairs(counts: DataFrame) -> DataFrame:
    """t table: counts by (s, t) over the counts by s; probabilities up to 1e-7 are left out."""
    return conditional(counts.groupBy("s", "t").agg(F.sum("c").alias("c")), "s", least=FLOOR).select("s", "t", "p")


def normalised_positions(counts: DataFrame) -> DataFrame:
    """a or d table: f1 given (f2, f3, f4)."""
    return conditional(counts.groupBy("f1", "f2", "f3", "f4").agg(F.sum("c").alias("c")), "f2 f3 f4", least=FLOOR).select("f1", "f2", "f3", "f4", "p")


def fertilities(bitext: DataFrame) -> DataFrame:
    """(w, fert, c) of source words: how often a word has so many links."""
    w = bitext.select(F.expr("inline(transform(src, (w, i) -> struct(w as w, size(filter(links, x -> x.s = i)) as fert)))"))
    return w.groupBy("w", "fert").agg(F.count(F.lit(1)).alias("c"))


def normalised_fertilities(counts: DataFrame, highest: int) -> DataFrame:
    """n table: shares of 0..highest for each word, at least 1e-7 each."""
    per = counts.groupBy("w").agg(F.sum("c").alias("total"), *(F.sum(F.when(F.col("fert") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(highest + 1)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("fert"), F.greatest(F.col(f"c{k}") / F.col("total"), F.lit(FLOOR)).alias("p")) for k in range(highest + 1))))
    return per.select("w", rows.alias("x")).select("w", "x.fert", "x.p")


# Word classes


def first_classes(ranked: DataFrame, classes: int) -> DataFrame:
    """(word, class, freq): a word of rank r is in class min(r, classes)."""
    return ranked.select("word", F.least(F.col("id"), F.lit(classes)).alias("class"), "freq")


def bigrams(sents: DataFrame) -> DataFrame:
    """(v, w, n): neighbouring tokens, the first one after <s>."""
    s = sents.select(F.concat(F.array(F.lit("<s>")), "tokens").alias("t"))
    pair = s.select(F.expr("inline(transform(filter(sequence(1, size(t)), i -> i < size(t)), i -> struct(t[i - 1] as v, t[i] as w)))"))
    return pair.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n"))


def class_bigrams(bi: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, class, n)"""
    return bi.join(classes.select(F.col("word").alias("w"), "class"), "w").groupBy("v", "class").agg(F.sum("n").alias("n"))


def class_sizes(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.sum("freq").alias("n"))


def likelihood_parts(cb: DataFrame, classes: DataFrame) -> DataFrame:
    """(part, value): the sum of N ln N over (word, class) bigrams, and minus the sum of n(w) ln N(class)."""
    n = F.col("n").cast("double")
    one = cb.agg(F.sum(n * F.ln(n)).alias("value")).select(F.lit("bigrams").alias("part"), "value")
    sized = classes.join(class_sizes(classes).withColumnRenamed("n", "size"), "class").where("size > 0")
    two = sized.agg((-F.sum(F.col("freq") * F.ln(F.col("size").cast("double")))).alias("value")).select(F.lit("classes").alias("part"), "value")
    return one.unionByName(two)


def best_moves(bi: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(word, class, best, gain): the class in which each word raises the likelihood most, all others staying; staying gains 0, ties go to the smaller class.

    Per word and predecessor the k counts N(v, class) come as one array, so the work is k times the bigrams, without a product of words and classes.
    """
    h = lambda x: F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)
    per = lambda n: F.array(*(F.sum(F.when(F.col("class") == c, F.col(n)).otherwise(0)) for c in range(1, k + 1)))
    sizes = class_sizes(classes).agg(per("n").alias("s")).scalar()
    row = class_bigrams(bi, classes).groupBy("v").agg(per("n").alias("ns"))
    j = bi.join(row, "v").join(classes.select(F.col("word").alias("w"), F.col("class").alias("own"), "freq"), "w")
    own = F.get("ns", (F.col("own") - 1).cast("int"))
    each = j.select("w", "own", "freq", (h(own) - h(own - F.col("n"))).alias("out"), F.transform("ns", lambda x: h(x + F.col("n")) - h(x)).alias("into"))
    w = each.groupBy("w", "own", "freq").agg(F.sum("out").alias("out"), F.array(*(F.sum(F.get("into", F.lit(c))) for c in range(k))).alias("into"))
    w = w.withColumn("s", sizes)
    mine = F.get("s", (F.col("own") - 1).cast("int"))
    w = w.withColumn("keep", h(mine) - h(mine - F.col("freq")) - F.col("out"))
    gain = lambda x, i: F.when(i + 1 == F.col("own"), 0.0).otherwise(F.round(x + F.col("keep") - h(F.get("s", i) + F.col("freq")) + h(F.get("s", i)), 6))
    w = w.withColumn("gains", F.transform("into", gain)).withColumn("gain", F.array_max("gains"))
    return w.select(F.col("w").alias("word"), F.col("own").alias("class"), F.array_position("gains", F.col("gain")).alias("best"), "gain")


def exchanged(bi: DataFrame, classes: DataFrame, k: int, passes: int = 3) -> DataFrame:
    """Full passes of moving each word to its best class, half of the words at a time (by hash, so that neighbours don't all move at once); ends when a whole pass moves no word."""
    bi = written(bi, "bigrams")
    for _ in range(passes):
        moves = 0
        for half in (0, 1):
            m = best_moves(bi, classes, k).where("best <> class").select("word", "best")
            turn = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(2)) == half
            moved = classes.join(m, "word", "left").withColumn("go", turn & F.col("best").isNotNull())
            moved = written(moved.select("word", F.when(F.col("go"), F.col("best")).otherwise(F.col("class")).alias("class"), "freq", "go"), "classes")
            moves += moved.where("go").count()
            classes = moved.drop("go")
        if not moves:
            break
    return classes
