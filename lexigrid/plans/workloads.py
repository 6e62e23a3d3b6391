"""The three workloads from files to files, by settings: language models, phrase or rule tables, word alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.config import Direction, Extract, Settings, Tags, Translation
from lexigrid.functions import text as T
from lexigrid.functions.written import written
from lexigrid.operators import alignment as A
from lexigrid.operators import corpus as C
from lexigrid.operators import language_model as L
from lexigrid.operators import translation as X
from lexigrid.sources import files, models, tables


def language_models(spark: SparkSession, settings: Settings) -> dict[str, str]:
    """Counts the n-grams of a text file or folder once and writes each wanted model and the dictionary; the folders by kind."""
    lm = settings.lm
    files.require(spark, [lm.lmInputFileName])
    layout = models.Layout(lm.lmRootDir)
    lines = tables.text_lines(spark, lm.lmInputFileName).withColumnRenamed("value", "text")
    counts = written(L.ngram_counts(L.sentences(lines), lm.N), "ngrams")
    models.write_dictionary(C.ranked(C.word_count(lines), ["<s>", "</s>", "unk"], 3), layout.dictionary("lm"))
    make = {"gsb": lambda: L.stupid_backoff(counts, lm.N), "gt": lambda: L.good_turing(counts), "kn": lambda: L.kneser_ney(counts, lm.N), "mkn": lambda: L.kneser_ney(counts, lm.N, True)}
    for kind in lm.kinds():
        models.write_language_model(make[kind](), layout.language_model(kind))
    return {kind: layout.language_model(kind) for kind in lm.kinds()} | {"dictionary": layout.dictionary("lm")}


def extracted(bitext: DataFrame, mt: Translation) -> DataFrame:
    """Occurrences (row_id, src, tgt, align, ...) by the mode's limits: phrases, with unaligned words beside the null word where that is wanted, or rules; with syntax columns where they are wanted and the rows have heads and tags."""
    if mt.optType is Extract.Rule:
        return X.rules_with_syntax(bitext, mt.constrainedType.value, **mt.limits()) if mt.withSyntaxInfo else X.rule_occurrences(bitext, **mt.limits())
    if mt.withSyntaxInfo:
        return X.phrases_with_syntax(bitext, mt.maxc, mt.maxe, mt.constrainedType.value, mt.keepFloatingPOS)
    p = X.phrases(bitext, **mt.limits())
    return p.unionByName(X.null_phrases(bitext), allowMissingColumns=True) if mt.withNullOption else p


def translation(spark: SparkSession, settings: Settings) -> str:
    """Reads aligned bitext (three or five tab-separated fields) and writes the phrase or rule table; its folder. With syntax, rows without heads are left out."""
    mt = settings.mt
    files.require(spark, [mt.inputDir])
    layout = models.Layout(mt.rootDir)
    read = tables.bitext_tsv(spark, mt.inputDir)
    if mt.withSyntaxInfo:
        read = read.where("heads is not null and pos is not null and size(heads) = size(tgt) and size(pos) = size(tgt)")
    # written once, as row numbers must not change from reader to reader
    bitext = written(read.where("size(src) > 0 and size(tgt) > 0").withColumn("row_id", F.monotonically_increasing_id()), "bitext")
    occurrences = written(extracted(bitext, mt), "occurrences")
    words = written(X.word_pairs(bitext), "lexicon")
    lex = X.conditional(words, "s"), X.conditional(words, "t")
    pairs = written(X.best_align(X.count_by_align(occurrences, False), False), "pairs")
    if mt.optType is Extract.Rule:
        out = X.rule_table(pairs, *lex, direction="c2e" if mt.direction is Direction.C2E else "e2c", cutoff=mt.cutoff)
        path, keys, scores, more = layout.rules(), ["lhs", "rhs"], ["f1", "f2", "f3", "f4", "penalty", "rarity"], []
    else:
        out = X.phrase_table(pairs.where(F.col("c") > mt.cutoff), *lex)
        smooth = {"kn": lambda: X.kneser_ney_scores(pairs), "mkn": lambda: X.kneser_ney_scores(pairs, True), "gt": lambda: X.turing_scores(pairs)}.get(mt.smoothing())
        if smooth:
            out = out.drop("phi", "phi_rev").join(smooth(), ["src", "tgt"])
        path, keys, scores, more = layout.phrases(), ["src", "tgt"], ["phi_rev", "lex_rev", "phi", "lex", "penalty"], []
        if mt.withSyntaxInfo:
            out, more = out.join(X.syntax_columns(occurrences), ["src", "tgt"]), ["syntax"] + ["tags"] * (mt.posType is not Tags.NONE)
    models.write_table(out, path, keys, scores, more, int(settings.sparkPara.get("totalCores", 0)))
    return path


def line_by_line(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(row_id, src, tgt): the lines of two files or folders side by side, as far as the shorter one goes; row_id counts from 1."""
    one, two = (C.numbered(files.ordered_lines(spark, p), ["file", "at"], "row_id").select("row_id", F.col("value").alias(n)) for p, n in ((source, "src"), (target, "tgt")))
    return one.join(two, "row_id")


def alignment(spark: SparkSession, settings: Settings) -> str:
    """Reads two files line by line, leaves out pairs with an empty or a too long side, trains both directions by the schedule and writes ``src, tgt, links`` lines with tabs between; their folder."""
    wam = settings.wam
    out = f"{wam.alignedRoot}/aligned"
    files.require(spark, [wam.source, wam.target], [] if wam.overwrite else [out])
    toks = line_by_line(spark, wam.source, wam.target).select("row_id", T.tokens("src").alias("src"), T.tokens("tgt").alias("tgt"))
    bitext = written(C.within_length(toks, F.col("src"), F.col("tgt"), wam.maxSentLen), "bitext")
    links = A.aligned(bitext, wam.trainSeq, wam.symalmethod)
    lines = bitext.join(links, "row_id").select(F.concat_ws("\t", F.array_join("src", " "), F.array_join("tgt", " "), "align").alias("value"))
    tables.write_text(lines, out)
    return out
