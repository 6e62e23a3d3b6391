"""Language-model queries over the lines of documents; perplexity of eval_items."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.written import written
from lexigrid.operators import language_model as L
from lexigrid.sources.tables import table

N = 5


def counts(spark: SparkSession, d: str, high: int = N, low: int = 1) -> DataFrame:
    return L.ngram_counts(L.sentences(table(spark, d, "documents", spark.sparkContext.defaultParallelism)), high, low)


def kept(spark: SparkSession, d: str, high: int) -> DataFrame:
    """The counts as a table, for models that read them once an order and more."""
    return written(counts(spark, d, high), "ngrams")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def lm_ngram(n, spark, d):
    return counts(spark, d, n, n)


def lm_gsb(n, spark, d):
    c = counts(spark, d, n, n)
    return _rounded(L.backoff_unigrams(c) if n == 1 else L.backoff_ngrams(c, N))


def lm_gt(n, variant, spark, d):
    return _rounded(L.good_turing(counts(spark, d, n, n), variant).drop("bow"))


def lm_kn(n, modified, variant, spark, d):
    p = L.interpolated(kept(spark, d, n), n, modified, variant)[n]
    return _rounded(p.select("gram", F.when(F.col("p") > 0, F.log10("p")).alias("logp")))


def lm_table(modified, variant, high, spark, d):
    return _rounded(L.kneser_ney(kept(spark, d, high), high, modified, variant))


def lm_type_counts(spark, d):
    return L.type_counts(counts(spark, d))


def lm_history_split(spark, d):
    return L.split_history(counts(spark, d, 3, 2))


def lm_history_stats(spark, d):
    return L.history_stats(counts(spark, d, 3)).select("n", "hist", "total", "followers")


def lm_mkn_buckets(spark, d):
    return L.history_stats(counts(spark, d, 3)).select("n", "hist", "n1", "n2", "n3")


def lm_continuation(spark, d):
    return _rounded(L.continuation(counts(spark, d, 2, 2)))


def count_of_counts(spark, d):
    return L.count_of_counts(counts(spark, d))


def lm_kn_discount(spark, d):
    return _rounded(L.discounts(counts(spark, d)).select("n", "d"))


def lm_mkn_discounts(variant, spark, d):
    return _rounded(L.discounts(counts(spark, d), variant).drop("d"))


def gt_weighted_fit(spark, d):
    return _rounded(L.turing_fit(counts(spark, d), "standard", True).select("n", "slope"))


def gt_direct(spark, d):
    return _rounded(L.turing_direct(counts(spark, d)))


def lm_wrap(spark, d):
    return L.sentences(table(spark, d, "documents", spark.sparkContext.defaultParallelism)).select(F.array_join("w", " ").alias("sentence"))


def lm_arpa_render(spark, d):
    return L.arpa(L.stupid_backoff(counts(spark, d), N))


def _held_out(spark, d):
    return L.sentences(table(spark, d, "eval_items"))


def ppl_events(spark, d):
    return L.events(_held_out(spark, d), N).select("word", F.coalesce("h4", "h3", "h2", "h1").alias("hist"))


def ppl_token_count(spark, d):
    w = _held_out(spark, d).select(F.explode("w").alias("word"))
    return w.where("word <> '<s>'").agg(F.count(F.lit(1)).alias("tokens"))


def _unk(spark, d):
    return L.type_counts(counts(spark, d, 1)).select((-F.log10("types")).alias("unk"))


def ppl_gsb(spark, d):
    t = written(L.stupid_backoff(kept(spark, d, N), N, "standard"), "gsb")
    unk = t.where("n = 1 and gram = 'unk'").select(F.col("logp").alias("unk"))
    return _rounded(L.perplexity(L.stupid_score(L.events(_held_out(spark, d), N), t, N, unk)))


def ppl_gt(spark, d):
    c = kept(spark, d, N)
    return _rounded(L.perplexity(L.turing_score(L.events(_held_out(spark, d), N), L.good_turing(c, "standard"), N, L.turing_fit(c, "standard"))))


def _ppl_kn(modified, spark, d):
    t = written(L.kneser_ney(kept(spark, d, N), N, modified, "standard").where("gram <> 'unk' or n > 1"), "kn")
    return _rounded(L.perplexity(L.backed_off(L.events(_held_out(spark, d), N), t, N, _unk(spark, d))))


QUERIES = {f.__name__: f for f in (lm_type_counts, lm_history_split, lm_history_stats, lm_mkn_buckets, lm_continuation, count_of_counts, lm_kn_discount, gt_weighted_fit, gt_direct, lm_wrap, lm_arpa_render, ppl_events, ppl_token_count, ppl_gsb, ppl_gt)}
for _n in range(1, N + 1):
    QUERIES[f"lm_ngram_{_n}"] = partial(lm_ngram, _n)
    QUERIES[f"lm_gsb_{_n}"] = partial(lm_gsb, _n)
    QUERIES[f"lm_gt_{_n}"] = partial(lm_gt, _n, "reference")
    if _n > 1:
        QUERIES[f"lm_kn_{_n}"] = partial(lm_kn, _n, False, "reference")
        QUERIES[f"lm_mkn_{_n}"] = partial(lm_kn, _n, True, "reference")
QUERIES |= {
    "lm_gt_std_2": partial(lm_gt, 2, "standard"),
    "lm_kn_std_2": partial(lm_kn, 2, False, "standard"),
    "lm_kn_std_3": partial(lm_kn, 3, False, "standard"),
    "lm_mkn_std_3": partial(lm_kn, 3, True, "standard"),
    "lm_kn_std_5": partial(lm_kn, 5, False, "standard"),
    "lm_mkn_std_5": partial(lm_kn, 5, True, "standard"),
    **{f"lm_{m}{v}_table{'' if k == 3 else '_5'}": partial(lm_table, m == "mkn", variant, k) for m in ("kn", "mkn") for v, variant in (("", "reference"), ("_std", "standard")) for k in (3, N)},
    "lm_mkn_discounts": partial(lm_mkn_discounts, "reference"),
    "lm_mkn_std_discounts": partial(lm_mkn_discounts, "standard"),
    "ppl_kn": partial(_ppl_kn, False),
    "ppl_mkn": partial(_ppl_kn, True),
}


def base(tab: str = "documents", name: str = "") -> str:
    return f"""line{name} as (select unnest(string_split(text, chr(10))) as line from {tab} where text is not null),
s{name} as (select row_number() over () as sid, ['<s>'] || regexp_extract_all(line, '{T.TOKEN}') || ['</s>'] as w from line{name} where length(line) > 0)"""


_G = (
    "with "
    + base()
    + """, g as (select n, array_to_string(w[k : k + n - 1], ' ') as gram from s, range(1, 6) t(n), range(1, len(w) - n + 2) u(k)),
c as materialized (select cast(n as int) as n, gram, count(*) as c from g group by 1, 2),
h as materialized (select *, regexp_replace(gram, '(^| )[^ ]*$', '') as hist, regexp_extract(gram, '[^ ]*$') as word, regexp_replace(gram, '^[^ ]* ', '') as suffix from c),
t as (select n, count(*) as types, cast(sum(c) as bigint) as tokens from c group by 1),
cc as materialized (select n, c as r, count(*) as nr from c group by 1, 2),
st as materialized (select n, hist, cast(sum(c) as bigint) as total, count(*) as followers, count(*) filter (c = 1) as n1, count(*) filter (c = 2) as n2, count(*) filter (c > 2) as n3 from h where n > 1 group by 1, 2),
m as (select n, coalesce(sum(nr) filter (r = 1), 1)::double as m1, coalesce(sum(nr) filter (r = 2), 1)::double as m2, coalesce(sum(nr) filter (r = 3), 1)::double as m3, coalesce(sum(nr) filter (r = 4), 1)::double as m4 from cc group by 1),
y as (select *, m1 / (m1 + 2 * m2) as y from m),
d_ref as materialized (select n, y as d, 1 - 2 * y * m2 / m1 as d1, 1 - 2 * y * m3 / m2 as d2, 1 - 2 * y * m4 / m3 as d3 from y),
d_std as materialized (select n, y as d, 1 - 2 * y * m2 / m1 as d1, 2 - 3 * y * m3 / m2 as d2, 3 - 4 * y * m4 / m3 as d3 from y),
co as (select word, count(*) as preceding, count(*) / (select count(*) from h where n = 2) as p from h where n = 2 group by 1),
sums as (select n, count(*)::double as every, sum(1.0) filter (r < 1000) as m, sum(ln(r) * ln(nr)) filter (r < 1000) as xy, sum(ln(r)) filter (r < 1000) as x, sum(ln(nr)) filter (r < 1000) as y,
  sum(ln(r) * ln(r)) filter (r < 1000) as xx, sum(r) filter (r < 1000)::double as wm, sum(r * ln(r) * ln(nr)) filter (r < 1000) as wxy, sum(r * ln(r)) filter (r < 1000) as wx, sum(r * ln(nr)) filter (r < 1000) as wy,
  sum(r * ln(r) * ln(r)) filter (r < 1000) as wxx, cast(sum(r * nr) as bigint) as total, coalesce(sum(nr) filter (r = 1), 0) as n1 from cc group by 1),
fit_ref as (select n, (every * xy - xy * y) / (every * xx - x * x) as slope, total, n1 from sums),
fit_std as (select n, (m * xy - x * y) / (m * xx - x * x) as slope, total, n1 from sums),
"""
)


def _kn_parts(variant: str, modified: bool, high: int) -> str:
    if not modified:
        d, mass = "d", "d * followers"
    elif variant == "ref":
        d, mass = "case c when 1 then d1 when 2 then d2 when 3 then d3 else 0 end", "greatest(d1, 0) * followers"
    else:
        d, mass = "case c when 1 then d1 when 2 then d2 else d3 end", "d1 * n1 + d2 * n2 + d3 * n3"
    if variant == "ref":
        out, hs, sts, ds, low = "", "h", "st", "d_ref", "hist"
        p1 = "select gram, c / (select count(*) from c where n = 1) as p from c where n = 1"
    else:
        hs, sts, ds, low = "ah", "ast", "ad", "suffix"
        p1 = "select c.gram, coalesce(co.p, 0) as p from c left join co on gram = word where n = 1"
        out = f"""ah as materialized (select n, gram, hist, suffix, coalesce(b.before, c) as c from h left join (select n - 1 as n, suffix as gram, count(*) as before from h where n between 2 and {high} group by 1, 2) b using (n, gram) where n <= {high}),
ast as materialized (select n, hist, cast(sum(c) as bigint) as total, count(*) as followers, count(*) filter (c = 1) as n1, count(*) filter (c = 2) as n2, count(*) filter (c > 2) as n3 from ah where n > 1 group by 1, 2),
am as (select n, greatest(count(*) filter (c = 1), 1)::double as m1, greatest(count(*) filter (c = 2), 1)::double as m2, greatest(count(*) filter (c = 3), 1)::double as m3, greatest(count(*) filter (c = 4), 1)::double as m4 from ah group by 1),
ad as materialized (select n, m1 / (m1 + 2 * m2) as d, 1 - 2 * d * m2 / m1 as d1, 2 - 3 * d * m3 / m2 as d2, 3 - 4 * d * m4 / m3 as d3 from am),
"""
    out += f"""a as materialized (select x.n, gram, hist, {low} as low, greatest(c - ({d}), 0) / total as first, ({mass}) / total as bow from {hs} x join {sts} using (n, hist) join {ds} using (n) where x.n <= {high}),
p1 as materialized ({p1})"""
    for n in range(2, high + 1):
        out += f",\np{n} as materialized (select a.gram, first + bow * p as p from a join p{n - 1} on low = p{n - 1}.gram where n = {n})"
    return out + "\n"


def _kn_sql(n: int, variant: str, modified: bool) -> str:
    return _G + _kn_parts(variant, modified, n) + f"select gram, case when p > 0 then round(log10(p), 6) + 0 end as logp from p{n}"


def _table_sql(variant: str, modified: bool, high: int) -> str:
    lg = "case when p > 0 then log10(p) end"
    bw = "case when bow > 0 then log10(bow) else 0 end"
    how = "join" if variant == "ref" else "left join"
    out = f""", bw as materialized (select distinct n, hist, bow from a), tab as materialized (
select 1 as n, gram, case when gram = '<s>' then 0 else {lg} end as logp, case when gram = '</s>' then 0 else {bw} end as bow from p1 {how} bw on gram = hist and bw.n = 2
"""
    for n in range(2, high + 1):
        out += f"union all select {n}, gram, {lg}, {bw} from p{n} left join bw on gram = hist and bw.n = {n + 1}\n" if n < high else f"union all select {n}, gram, {lg}, null from p{n}\n"
    out += f"union all select 1, 'unk', -log10(types), 0 from t where n = {2 if variant == 'ref' else 1}"
    if variant == "ref":
        out += " union all select 1, '</s>', log10(0.5), 0 where exists (select 1 from p1 where gram not in (select hist from bw where n = 2))"
    return _G + _kn_parts(variant, modified, high) + out + ")\n"


_GSB = """gsb as (select 1 as n, gram, case when gram = '<s>' then 0 else log10(c) - log10({v}) end as logp, case when gram = '</s>' then 0 else log10(0.4) end as bow from c where n = 1
union all select 1, 'unk', -log10({v}), 0 union all select n, gram, log10(c) - log10(total), case when n < {high} then log10(0.4) end from h join st using (n, hist))
"""
_TYPES, _TOKENS = "(select types from t where n = 1)", "(select tokens from t where n = 1)"
_EV = base("eval_items", "_e") + ", e as materialized (select sid, k, w[k] as word, " + ", ".join(f"case when k > {j} then array_to_string(w[k - {j} : k - 1], ' ') end as h{j}" for j in range(1, N)) + " from s_e, range(2, len(w) + 1) u(k))"


def _ppl(tab: str, cut: str) -> str:
    """Scores of the events from the shortest gram up: where the longer one isn't in the table, the shorter one's score and what the cut costs."""
    out = f", {_EV}, k0 as materialized (select * from {tab} where gram <> 'unk' or n > 1), x1 as materialized (select e.*, coalesce(q.logp, (select -log10({_TOKENS if '0.4' in cut else _TYPES}))) as score from e left join k0 q on q.n = 1 and q.gram = word)"
    for n in range(2, N + 1):
        h = f"h{n - 1}"
        out += f",\nx{n} as materialized (select x.* exclude (score), case when {h} is null then score else coalesce(q.logp, {cut} + score) end as score from x{n - 1} x left join k0 q on q.n = {n} and q.gram = {h} || ' ' || word left join k0 b on b.n = {n - 1} and b.gram = {h})"
    return out + f"\nselect count(*) as tokens, round(pow(10, -avg(score)), 6) as perplexity from x{N}"


_GT = "case when c > 1000 then c::double else c * pow(1 + 1 / c::double, slope) end"
SQL = {
    "lm_type_counts": _G + "z as (select 1) select * from t",
    "lm_history_split": _G + "z as (select 1) select n, gram, c, hist, word from h where n in (2, 3)",
    "lm_history_stats": _G + "z as (select 1) select n, hist, total, followers from st where n < 4",
    "lm_mkn_buckets": _G + "z as (select 1) select n, hist, n1, n2, n3 from st where n < 4",
    "lm_continuation": _G + "z as (select 1) select word, preceding, round(p, 6) as p from co",
    "count_of_counts": _G + "z as (select 1) select * from cc",
    "lm_kn_discount": _G + "z as (select 1) select n, round(d, 6) as d from d_ref",
    "lm_mkn_discounts": _G + "z as (select 1) select n, round(d1, 6) as d1, round(d2, 6) as d2, round(d3, 6) as d3 from d_ref",
    "lm_mkn_std_discounts": _G + "z as (select 1) select n, round(d1, 6) as d1, round(d2, 6) as d2, round(d3, 6) as d3 from d_std",
    "gt_weighted_fit": _G + "z as (select 1) select n, round((wm * wxy - wx * wy) / (wm * wxx - wx * wx), 6) as slope from sums",
    "gt_direct": _G + "z as (select 1) select a.n, a.r, round((a.r + 1) * b.nr / a.nr, 6) as adjusted from cc a left join cc b on a.n = b.n and b.r = a.r + 1",
    "lm_wrap": "with " + base() + " select array_to_string(w, ' ') as sentence from s",
    "lm_arpa_render": _G + _GSB.format(v=_TYPES, high=N) + "select n, printf('%.6f', logp) || chr(9) || gram || coalesce(chr(9) || printf('%.6f', bow), '') as line from gsb",
    "ppl_events": "with " + _EV + " select word, coalesce(h4, h3, h2, h1) as hist from e",
    "ppl_token_count": "with " + base("eval_items") + " select count(*) as tokens from (select unnest(w) as word from s) where word <> '<s>'",
    "ppl_gsb": _G + _GSB.format(v=_TOKENS, high=N) + _ppl("gsb", "log10(0.4)"),
    "ppl_gt": _G
    + _EV
    + f""", gt as (select c.n, gram, log10({_GT}) - log10(total) as logp from c join fit_std using (n)),
k as (select case when h4 is not null then 5 when h3 is not null then 4 when h2 is not null then 3 when h1 is not null then 2 else 1 end as n, concat_ws(' ', coalesce(h4, h3, h2, h1), word) as gram from e)
select count(*) as tokens, round(pow(10, -avg(coalesce(gt.logp, log10(f.n1) - log10(f.total)))), 6) as perplexity from k left join gt using (n, gram) left join fit_std f using (n)""",
    "ppl_kn": _table_sql("std", False, N) + _ppl("tab", "coalesce(b.bow, 0)"),
    "ppl_mkn": _table_sql("std", True, N) + _ppl("tab", "coalesce(b.bow, 0)"),
    "lm_gt_std_2": _G + f"z as (select 1) select n, gram, round(log10({_GT}) - log10(total), 6) as logp from c join fit_std using (n) where n = 2",
    "lm_kn_std_2": _kn_sql(2, "std", False),
    "lm_kn_std_3": _kn_sql(3, "std", False),
    "lm_mkn_std_3": _kn_sql(3, "std", True),
    "lm_kn_std_5": _kn_sql(5, "std", False),
    "lm_mkn_std_5": _kn_sql(5, "std", True),
    **{f"lm_{m}{v}_table{'' if k == 3 else '_5'}": _table_sql(variant, m == "mkn", k) + "select n, gram, round(logp, 6) + 0 as logp, round(bow, 6) + 0 as bow from tab" for m in ("kn", "mkn") for v, variant in (("", "ref"), ("_std", "std")) for k in (3, N)},
}
for _n in range(1, N + 1):
    SQL[f"lm_ngram_{_n}"] = _G + f"z as (select 1) select n, gram, c from c where n = {_n}"
    SQL[f"lm_gsb_{_n}"] = _G + _GSB.format(v=_TYPES, high=N) + f"select n, gram, round(logp, 6) + 0 as logp, round(bow, 6) + 0 as bow from gsb where n = {_n}"
    SQL[f"lm_gt_{_n}"] = _G + f"z as (select 1) select n, gram, round(log10({_GT}) - log10(total), 6) as logp from c join fit_ref using (n) where n = {_n}"
    if _n > 1:
        SQL[f"lm_kn_{_n}"] = _kn_sql(_n, "ref", False)
        SQL[f"lm_mkn_{_n}"] = _kn_sql(_n, "ref", True)
