"""Queries of the general problems 1 and 4, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import bulk_parse, eager
from lexigrid.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bulk_parse.rejects(table(spark, d, "phrase_lines")).select("line_id")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return bulk_parse.rejects(table(spark, d, "phrase_lines")).select("line_id", "reason")


def p1_details(spark: SparkSession, d: str) -> DataFrame:
    return bulk_parse.rejects(table(spark, d, "phrase_lines")).select("line_id", "reason", "detail")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return bulk_parse.loaded(table(spark, d, "phrase_lines"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return bulk_parse.rejects(table(spark, d, "phrase_lines")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _fields(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str]]:
    grams = table(spark, d, "ngram_join")
    return {"ngram_join.words": (grams, "words"), "ngram_join.prefix_num": (grams, "prefix_num"), "phrase_combinete.phrasec": (table(spark, d, "phrase_combinete"), "phrasec")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.hot_keys(_fields(spark, d)).select("field_name", "hot_key")


def p4_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return eager.field_states(_fields(spark, d))


def _words_join(spark: SparkSession, d: str) -> DataFrame:
    return eager.eager_join(table(spark, d, "ngram_join"), table(spark, d, "n_gram"), "words", "num", "num")


def p4_join_sums(spark: SparkSession, d: str) -> DataFrame:
    j = _words_join(spark, d)
    return j.select(F.col("key").alias("words"), *(F.col(c).cast("bigint").alias(c) for c in ("join_rows", "left_sum", "right_sum")))


def p4_join_by_order(spark: SparkSession, d: str) -> DataFrame:
    """The join rolled up by the number of terms."""
    r = eager.roll_up(_words_join(spark, d), F.size(F.split("key", " ")), "n")
    return r.select("n", "keys", F.col("join_rows").cast("bigint").alias("join_rows"), F.col("left_sum").cast("bigint").alias("left_sum"), F.col("right_sum").cast("bigint").alias("right_sum"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_details, p1_loaded, p1_reasons, p4_found, p4_key_counts, p4_join_sums, p4_join_by_order)}

# Lines are cut by a pattern over the separator as one character (U+0001, which no line holds as it is).
_FIELD = r'((?s:"(?:[^"]|"")*"|[^"\x01][^\x01]*|))'
_LINE = "\\x01".join([_FIELD] * 9)
_CUT = f"""
with cut as (
  select line_id, raw, regexp_extract(replace(raw, ' ||| ', chr(1)), '^{_LINE}$', ['f1','f2','f3','f4','f5','f6','f7','f8','f9']) as f,
         regexp_full_match(replace(raw, ' ||| ', chr(1)), '{_LINE}') as whole
  from phrase_lines
), un as (
  select line_id, raw, coalesce(whole, false) as whole,
    replace(case when f.f1 like '"%' then replace(f.f1[2:-2], '""', '"') else f.f1 end, chr(1), ' ||| ') as c,
    replace(case when f.f2 like '"%' then replace(f.f2[2:-2], '""', '"') else f.f2 end, chr(1), ' ||| ') as e,
    replace(case when f.f3 like '"%' then replace(f.f3[2:-2], '""', '"') else f.f3 end, chr(1), ' ||| ') as a,
    replace(case when f.f4 like '"%' then replace(f.f4[2:-2], '""', '"') else f.f4 end, chr(1), ' ||| ') as n1,
    replace(case when f.f5 like '"%' then replace(f.f5[2:-2], '""', '"') else f.f5 end, chr(1), ' ||| ') as i1,
    replace(case when f.f6 like '"%' then replace(f.f6[2:-2], '""', '"') else f.f6 end, chr(1), ' ||| ') as i2,
    replace(case when f.f7 like '"%' then replace(f.f7[2:-2], '""', '"') else f.f7 end, chr(1), ' ||| ') as i3,
    replace(case when f.f8 like '"%' then replace(f.f8[2:-2], '""', '"') else f.f8 end, chr(1), ' ||| ') as n2,
    replace(case when f.f9 like '"%' then replace(f.f9[2:-2], '""', '"') else f.f9 end, chr(1), ' ||| ') as n3
  from cut
)
"""
_CUT += r""", judged as (
  select *, whole and not regexp_matches(c, '[\x00-\x1f\x7f-\x{9f}\x{fffd}]') and not regexp_matches(e, '[\x00-\x1f\x7f-\x{9f}\x{fffd}]')
    and regexp_matches(c, '[^\s\p{Z}]') and regexp_matches(e, '[^\s\p{Z}]') and regexp_full_match(a, '[0-9]{1,9}-[0-9]{1,9}( [0-9]{1,9}-[0-9]{1,9})*')
    and coalesce(list_bool_and(list_transform(string_split(a, ' '), lambda x: try_cast(split_part(x, '-', 1) as bigint) < len(string_split(c, ' ')) and try_cast(split_part(x, '-', 2) as bigint) < len(string_split(e, ' ')))), false)
    and regexp_full_match(n1, '[1-9][0-9]*') and try_cast(n1 as bigint) is not null and regexp_full_match(n2, '[1-9][0-9]*') and try_cast(n2 as bigint) is not null
    and regexp_full_match(n3, '[1-9][0-9]*') and try_cast(n3 as bigint) is not null as sound
  from un
)
"""
_REASONS = _CUT + r""", told as (
  select line_id, case when raw is null then 'null_line'
    when not regexp_full_match(replace(raw, ' ||| ', chr(1)), '""" + _FIELD + r"(\x01" + _FIELD + r""")*') then 'quoting' when not whole then 'column_count'
    when regexp_matches(c, '[\x00-\x1f\x7f-\x{9f}\x{fffd}]') or not regexp_matches(c, '[^\s\p{Z}]') then 'phrasec'
    when regexp_matches(e, '[\x00-\x1f\x7f-\x{9f}\x{fffd}]') or not regexp_matches(e, '[^\s\p{Z}]') then 'phrasee'
    when not regexp_full_match(a, '[0-9]+-[0-9]+( [0-9]+-[0-9]+)*') or not coalesce(list_bool_and(list_transform(string_split(a, ' '), lambda x: coalesce(try_cast(split_part(x, '-', 1) as bigint) < len(string_split(c, ' ')) and try_cast(split_part(x, '-', 2) as bigint) < len(string_split(e, ' ')), false))), false) then 'alignstr'
    when not regexp_full_match(n1, '[1-9][0-9]*') or try_cast(n1 as bigint) is null then 'countpair' when not regexp_full_match(n2, '[1-9][0-9]*') or try_cast(n2 as bigint) is null then 'totalcountc' else 'totalcounte' end as reason
  from judged where sound is not true)
"""
_FIELDS_SQL = """
with k as (
  select 'ngram_join.words' as field_name, words as key from ngram_join union all
  select 'ngram_join.prefix_num', cast(prefix_num as varchar) from ngram_join union all
  select 'phrase_combinete.phrasec', phrasec from phrase_combinete
), s as (select field_name, key, count(*) as n from k where key is not null group by 1, 2)
"""
_JOIN_SQL = """
select a.words, count(*) as join_rows, cast(sum(a.num) as bigint) as left_sum, cast(sum(b.num) as bigint) as right_sum
from ngram_join a join n_gram b on a.words = b.words group by 1
"""
SQL = {
    "p1_found": _CUT + "select line_id from judged where sound is not true",
    "p1_rejects": _REASONS + "select line_id, reason from told",
    "p1_reasons": _REASONS + "select reason, count(*) as n from told group by 1",
    "p1_loaded": _CUT
    + "select line_id, c as phrasec, e as phrasee, a as alignstr, cast(n1 as bigint) as countpair, i1 as syntaxinfo, i2 as postaginfo, i3 as posframeinfo, cast(n2 as bigint) as totalcountc, cast(n3 as bigint) as totalcounte from judged where sound",
    "p4_found": _FIELDS_SQL + "select field_name, key as hot_key from (select *, sum(n) over (partition by field_name) as t from s) where n * 50 >= t",
    "p4_key_counts": _FIELDS_SQL + "select field_name, key, n from s",
    "p4_join_sums": _JOIN_SQL,
    "p4_join_by_order": f"select len(string_split(words, ' ')) as n, count(*) as keys, cast(sum(join_rows) as bigint) as join_rows, cast(sum(left_sum) as bigint) as left_sum, cast(sum(right_sum) as bigint) as right_sum from ({_JOIN_SQL}) group by 1",
}
