"""Queries of the problems tagged llm, with SQL of the same results where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import encode, leaks, mojibake, same_look, seen_before, term_stats, together, top_n
from lexigrid.sources.tables import table


def _answers(spark: SparkSession, d: str, error: float = 1e-7) -> DataFrame:
    """The chains of earlier runs over ngram_seen meet the records of this one."""
    chains = seen_before.remembered(table(spark, d, "ngram_seen"), "id", error=error)
    return seen_before.answers(table(spark, d, "ngram"), "id", "rec_id", chains=chains, error=error)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """As the chains say, with an error bound of 2e-7."""
    return _answers(spark, d).where("said").select(F.col("order").alias("rec_id"))


def p2_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often the chains are wrong, at the error of p2_found and at one that takes less than half of the memory."""
    rates = [seen_before.wrong_rate(seen_before.checked(_answers(spark, d, e), table(spark, d, "ngram_seen"), "id")).select(F.lit(e).alias("error"), "*") for e in (1e-7, 1e-3)]
    return rates[0].unionByName(rates[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = together.lift(table(spark, d, "phrase_combinete"), "phrasec", "phrasee", "countpair", 30, 20)
    return p.select(F.col("a").alias("phrasec"), F.col("b").alias("phrasee"))


def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    p = together.lift(table(spark, d, "phrase_combinete"), "phrasec", "phrasee", "countpair", 30)
    return p.select(F.col("a").alias("phrasec"), F.col("b").alias("phrasee"), "s", "total_a", "total_b", F.round("lift", 6).alias("lift"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair, however seldom; p3_lift has those with a sum of at least 30."""
    p = together.lift(table(spark, d, "phrase_combinete"), "phrasec", "phrasee", "countpair")
    return p.select(F.col("a").alias("phrasec"), F.col("b").alias("phrasee"), "s", "total_a", "total_b", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return term_stats.marked(table(spark, d, "n_gram"), "words", "num").where("mark is not null").select("term")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_stats.marked(table(spark, d, "n_gram"), "words", "num")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_n(table(spark, d, "phrase_combinete"), "phrasec", "countpair", "phrasee", "row_id", 3).select(F.col("id").alias("row_id"))


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    t = top_n.top_n(table(spark, d, "phrase_combinete"), "phrasec", "countpair", "phrasee", "row_id", 3)
    return t.select(F.col("grp").alias("phrasec"), F.col("score").alias("countpair"), F.col("tie").alias("phrasee"), F.col("id").alias("row_id"), F.col("place").cast("bigint").alias("place"))


def _looks(spark: SparkSession, d: str) -> dict:
    return {"n_gram.words": (table(spark, d, "n_gram"), "words", "row_id"), "phrase_combinete.phrasec": (table(spark, d, "phrase_combinete"), "phrasec", "row_id")}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look.look_alikes(_looks(spark, d))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return same_look.look_classes(_looks(spark, d)).select("field_name", F.col("id").alias("row_id"), "class_id", "texts")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Rows of n_gram whose text is stored otherwise than in the consistent form."""
    return same_look.normalised(table(spark, d, "n_gram"), "words", "row_id").where("text <> form").select(F.col("id").alias("row_id"), "text", "form")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"), "text", "doc_id")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether decoding their ids gives their text again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = encode.encoded(docs, "text", "doc_id")
    back = encode.decoded(ids).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").groupBy((F.coalesce("text", F.lit("")) == F.col("back")).alias("same")).agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 12 words are searched with one edit allowed; these are the pairs of which one was verified with none."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), 12, 1).where("edits = 0").select("doc_id", "item_id")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 20 words of an item with up to two words edited."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), 20, 2)


def p9_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of texts that hold 20 words of an item with so many edits, how many p9_edited's search finds."""
    return leaks.recall(table(spark, d, "eval_items"), 20, 2)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents"), found_only=True).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents"), found_only=True).select("doc_id", "kind", "layers", "restored")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents"), found_only=True).groupBy("kind", "layers").agg(F.count(F.lit(1)).alias("documents"))


def p10_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many sound documents, garbled on purpose, are found and restored."""
    return mojibake.accuracy(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_rate, p3_found, p3_lift, p3_pairs, p5_found, p5_terms, p6_found, p6_ranked, p7_found, p7_classes, p7_forms, p8_ids, p8_round_trip, p9_found, p9_edited, p9_recall, p10_found, p10_restored, p10_kinds, p10_accuracy)
}

_PAIRS = """
with r as (select phrasec, phrasee, countpair as w from phrase_combinete where phrasec is not null and phrasee is not null and countpair is not null),
s as (select phrasec, phrasee, cast(sum(w) as bigint) as s from r group by 1, 2),
c as (select phrasec, cast(sum(w) as bigint) as total_a from r group by 1), e as (select phrasee, cast(sum(w) as bigint) as total_b from r group by 1),
p as (select s.*, total_a, total_b, (select cast(sum(w) as hugeint) from r) as t from s join c using (phrasec) join e using (phrasee) where s >= 30)
"""
_ALL_PAIRS = """
with r as (select phrasec, phrasee, countpair as w from phrase_combinete where phrasec is not null and phrasee is not null and countpair is not null)
select phrasec, phrasee, s, total_a, total_b, round(s::double * (select sum(w) from r)::double / total_a / total_b, 6) as lift
from (select phrasec, phrasee, cast(sum(w) as bigint) as s from r group by 1, 2)
join (select phrasec, cast(sum(w) as bigint) as total_a from r group by 1) using (phrasec) join (select phrasee, cast(sum(w) as bigint) as total_b from r group by 1) using (phrasee)
"""
_TERMS = """
with r as (select row_id, num, unnest(string_split(words, ' ')) as term from n_gram where words is not null and num is not null),
t as (select term, cast(sum(num) as bigint) as occurrences, count(distinct row_id) as records from r group by 1),
k as (select *, occurrences <= 5 as few, records * 50 >= (select count(*) from n_gram where words is not null and num is not null) as many from t)
"""
_RANKED = """
select phrasec, countpair, phrasee, row_id, place from (
  select *, row_number() over (partition by phrasec order by countpair desc, phrasee, row_id) as place
  from phrase_combinete where phrasec is not null and phrasee is not null and countpair is not null) where place <= 3
"""
SQL = {
    "p2_found": """select rec_id from (select n.*, row_number() over (partition by n.id order by rec_id) as k, s.id as old from ngram n left join ngram_seen s on n.id = s.id where n.id is not null) where k > 1 or old is not null""",
    "p3_found": _PAIRS + "select phrasec, phrasee from p where s * t >= 20 * total_a::hugeint * total_b",
    "p3_lift": _PAIRS + "select phrasec, phrasee, s, total_a, total_b, round(s::double * t::double / total_a / total_b, 6) as lift from p",
    "p3_pairs": _ALL_PAIRS,
    "p5_found": _TERMS + "select term from k where few or many",
    "p5_terms": _TERMS + "select term, occurrences, records, case when few and many then 'both' when few then 'rare' when many then 'common' end as mark from k",
    "p6_found": f"select row_id from ({_RANKED})",
    "p6_ranked": _RANKED,
    "p9_recall": """with n as (select count(*) as planted from eval_items where len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) >= 20)
select e::int as edits, planted, case when e <= 2 then planted else 0 end as found from n, range(0, 5) t(e)""",
    "p9_found": """
with w as (select item_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
g as (select id, array_to_string(w[k : k + 11], ' ') as g from w, range(1, len(w) - 10) t(k)),
dw as (select doc_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
dg as (select id, array_to_string(w[k : k + 11], ' ') as g from dw, range(1, len(w) - 10) t(k))
select distinct dg.id as doc_id, g.id as item_id from dg join g using (g)""",
}
