"""Translation-model and word-alignment queries over the phrase pairs of phrase_combinete as aligned bitext."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.written import written
from lexigrid.operators import alignment as A
from lexigrid.operators import corpus as C
from lexigrid.operators import dependency as Y
from lexigrid.operators import translation as X
from lexigrid.plans.corpus_queries import bitext
from lexigrid.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_B = """with recursive b as (select row_id, string_split(phrasec, ' ') as src, string_split(phrasee, ' ') as tgt, alignstr from phrase_combinete where phrasec is not null and phrasee is not null and alignstr is not null),
l as (select distinct row_id, cast(split_part(x, '-', 1) as int) as s, cast(split_part(x, '-', 2) as int) as t from (select row_id, unnest(string_split(alignstr, ' ')) as x from b))
"""
_P = (
    _B
    + """, sp as (select row_id, se, ee, len(src) as rows, len(tgt) as cols from b, range(0, len(tgt)) u(se), range(se, least(len(tgt), se + 5)) v(ee)),
mm as (select sp.row_id, se, ee, rows, cols, min(s) as lo, max(s) as hi from sp join l on l.row_id = sp.row_id and t between se and ee group by all),
ok as (select * from mm where hi - lo < 5 and not exists (select 1 from l where l.row_id = mm.row_id and l.s between mm.lo and mm.hi and (l.t < mm.se or l.t > mm.ee))),
ex as (select ok.*, sc, ec from ok, range(0, lo + 1) u(sc), range(hi, rows) v(ec) where ec - sc < 5 and not exists (select 1 from l where l.row_id = ok.row_id and (l.s between sc and lo - 1 or l.s between hi + 1 and ec))),
o as (select ex.*, list_contains(k, (sc - 1) * 100 + se - 1) or (sc = 0 and se = 0) as a1, list_contains(k, (ec + 1) * 100 + se - 1) as a2, list_contains(k, (sc - 1) * 100 + ee + 1) as a3, list_contains(k, (ec + 1) * 100 + ee + 1) or (ec + 1 >= rows and ee + 1 >= cols) as a4
  from ex join (select row_id, list(s * 100 + t) as k from l group by 1) using (row_id)),
al as (select ex.row_id, sc, ec, se, ee, string_agg((s - sc) || '-' || (t - se), ' ' order by s, t) as align from ex join l on l.row_id = ex.row_id and s between sc and ec and t between se and ee group by all),
p as (select o.row_id, array_to_string(src[sc + 1 : ec + 1], ' ') as src, array_to_string(tgt[se + 1 : ee + 1], ' ') as tgt, align, cast(sc as int) as sc, cast(ec as int) as ec, cast(se as int) as se, cast(ee as int) as ee,
  case when a1 and not a2 then 'm' when a2 and not a1 then 's' else 'o' end as prev, case when a3 and not a4 then 't' when a4 and not a3 then 'n' else 'p' end as next
  from o join b using (row_id) join al using (row_id, sc, ec, se, ee)),
ca as (select src, tgt, align, count(*) as c, count(*) filter (prev = 'm') as m, count(*) filter (prev = 's') as s, count(*) filter (prev = 'o') as o, count(*) filter (next = 't') as t, count(*) filter (next = 'n') as n, count(*) filter (next = 'p') as p from p group by 1, 2, 3),
ba as (select src, tgt, first(align order by c desc, align) as align, cast(sum(c) as bigint) as c, cast(sum(m) as bigint) as m, cast(sum(s) as bigint) as s, cast(sum(o) as bigint) as o, cast(sum(t) as bigint) as t, cast(sum(n) as bigint) as n, cast(sum(p) as bigint) as p from ca group by 1, 2),
sm as (select src, cast(sum(c) as bigint) as tc, count(*) as dc, count(*) filter (c = 1) as c1, count(*) filter (c = 2) as c2, count(*) filter (c > 2) as c3 from ba group by 1),
tm as (select tgt, cast(sum(c) as bigint) as te, count(*) as de, count(*) filter (c = 1) as e1, count(*) filter (c = 2) as e2, count(*) filter (c > 2) as e3 from ba group by 1),
wt as (select * from ba join sm using (src) join tm using (tgt))
"""
)
_LEX = """, wp as (select s, t, count(*) as c from (select src[l.s + 1] as s, tgt[l.t + 1] as t from l join b using (row_id)
  union all select src[k], '<NULL>' from b, range(1, len(src) + 1) u(k) where not exists (select 1 from l where l.row_id = b.row_id and l.s = k - 1)
  union all select '<NULL>', tgt[k] from b, range(1, len(tgt) + 1) u(k) where not exists (select 1 from l where l.row_id = b.row_id and l.t = k - 1)) group by 1, 2),
lc as (select s, t, c, c / sum(c) over (partition by s) as p from wp), le as (select s, t, c, c / sum(c) over (partition by t) as p from wp)
"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pairs(spark, d, oriented: bool = True):
    return X.best_align(X.count_by_align(X.phrases(bitext(spark, d)), oriented), oriented)


def _kept(spark, d, oriented: bool = False):
    """The pairs as a table, for scores that read them several times."""
    return written(_pairs(spark, d, oriented), "pairs")


def _lex(spark, d):
    w = written(X.word_pairs(bitext(spark, d)), "lexicon")
    return X.conditional(w, "s"), X.conditional(w, "t")


def _round(df, *names):
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(_P + "select * from p")
def phrase_extract(spark, d):
    return X.phrases(bitext(spark, d))


@query(_P + "select prev, next, count(*) as n from p group by 1, 2")
def phrase_orientation(spark, d):
    return X.phrases(bitext(spark, d)).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


@query(_P + "select * from ca")
def phrase_count_align(spark, d):
    return X.count_by_align(X.phrases(bitext(spark, d)))


@query(_P + "select * from ba")
def phrase_best_align(spark, d):
    return _pairs(spark, d)


@query(_P + "select src, tgt, c, tc, te from wt")
def phrase_totals(spark, d):
    return X.with_totals(_pairs(spark, d, False)).select("src", "tgt", "c", "tc", "te")


@query(_P + "select src, tgt, dc, de from wt")
def phrase_diversity(spark, d):
    return X.with_totals(_pairs(spark, d, False)).select("src", "tgt", "dc", "de")


@query(_P + "select src, tgt, c1, c2, c3, e1, e2, e3 from wt")
def phrase_diversity_buckets(spark, d):
    return X.with_totals(_pairs(spark, d, False)).select("src", "tgt", "c1", "c2", "c3", "e1", "e2", "e3")


@query(_P + "select src, tgt, round(c / tc, 6) as phi, round(c / te, 6) as phi_rev from wt")
def phrase_relfreq(spark, d):
    w = X.with_totals(_pairs(spark, d, False))
    return _round(w.select("src", "tgt", (F.col("c") / F.col("tc")).alias("phi"), (F.col("c") / F.col("te")).alias("phi_rev")))


@query(_P + "select src, tgt, m, s, o, t, n, p from ba")
def reorder_counts(spark, d):
    return _pairs(spark, d).select("src", "tgt", "m", "s", "o", "t", "n", "p")


_RP = "select src, tgt, " + ", ".join(f"round(({k} + 1) / ({' + '.join(ks)} + 3), 6) as {k}" for ks in ("mso", "tnp") for k in ks) + " from ba"


@query(_P + _RP)
def reorder_probs(spark, d):
    return _round(X.reorder_probs(_pairs(spark, d)))


@query(_B + """, f as (select row_id, src, tgt, [exists(select 1 from l where l.row_id = b.row_id and l.s = 0)] as z from b)
select row_id, src[k] as src, '<NULL>' as tgt, '0-0' as align from b, range(1, len(src) + 1) u(k) where not exists (select 1 from l where l.row_id = b.row_id and l.s = k - 1)
  and (k = 1 or exists (select 1 from l where l.row_id = b.row_id and l.s = k - 2)) and (k = len(src) or exists (select 1 from l where l.row_id = b.row_id and l.s = k))
union all select row_id, '<NULL>', tgt[k], '0-0' from b, range(1, len(tgt) + 1) u(k) where not exists (select 1 from l where l.row_id = b.row_id and l.t = k - 1)
  and (k = 1 or exists (select 1 from l where l.row_id = b.row_id and l.t = k - 2)) and (k = len(tgt) or exists (select 1 from l where l.row_id = b.row_id and l.t = k))""".replace(", f as (select row_id, src, tgt, [exists(select 1 from l where l.row_id = b.row_id and l.s = 0)] as z from b)", ""))
def phrase_null(spark, d):
    return X.null_phrases(bitext(spark, d))


@query(_B + _LEX + "select * from wp")
def lex_pair_count(spark, d):
    return X.word_pairs(bitext(spark, d))


@query(_B + _LEX + "select s, t, c, round(p, 6) as p from lc")
def lex_prob_c2e(spark, d):
    return _round(_lex(spark, d)[0])


@query(_B + _LEX + "select s, t, c, round(p, 6) as p from le")
def lex_prob_e2c(spark, d):
    return _round(_lex(spark, d)[1])


_LW = _LEX + """, pl as (select distinct src, tgt, cast(split_part(x, '-', 1) as int) as s, cast(split_part(x, '-', 2) as int) as t from (select src, tgt, unnest(string_split(align, ' ')) as x from ba)),
lw as (select src, tgt, product(w) as lex from (select src, tgt, k, case when count(pl_s) > 0 then avg(coalesce(lc.p, 0)) else coalesce(max(nl), 1) end as w from (
  select q.*, string_split(q.src, ' ')[pl.s + 1] as word, pl.s as pl_s, (select lc.p from lc where lc.s = '<NULL>' and lc.t = q.e) as nl from (select src, tgt, k, string_split(tgt, ' ')[k] as e from ba, range(1, len(string_split(tgt, ' ')) + 1) u(k)) q left join pl on pl.src = q.src and pl.tgt = q.tgt and pl.t = q.k - 1) x
  left join lc on lc.s = x.word and lc.t = x.e group by 1, 2, 3) group by 1, 2),
lr as (select src, tgt, product(w) as lex_rev from (select src, tgt, k, case when count(pl_t) > 0 then avg(coalesce(le.p, 0)) else coalesce(max(nl), 1) end as w from (
  select q.*, string_split(q.tgt, ' ')[pl.t + 1] as word, pl.t as pl_t, (select le.p from le where le.t = '<NULL>' and le.s = q.e) as nl from (select src, tgt, k, string_split(src, ' ')[k] as e from ba, range(1, len(string_split(src, ' ')) + 1) u(k)) q left join pl on pl.src = q.src and pl.tgt = q.tgt and pl.s = q.k - 1) x
  left join le on le.t = x.word and le.s = x.e group by 1, 2, 3) group by 1, 2)
"""


@query(_P + _LW + "select src, tgt, round(lex, 6) as lex, round(lex_rev, 6) as lex_rev from lw join lr using (src, tgt)")
def phrase_lexweight(spark, d):
    return _round(X.lexical_weights(_kept(spark, d), *_lex(spark, d)))


_PT = "select src, tgt, round(c / te, 6) as phi_rev, round(lex_rev, 6) as lex_rev, round(c / tc, 6) as phi, round(lex, 6) as lex, 2.718::double as penalty from wt join lw using (src, tgt) join lr using (src, tgt)"


@query(_P + _LW + _PT)
def phrase_table(spark, d):
    return _round(X.phrase_table(_kept(spark, d), *_lex(spark, d)))


@query(_P + _LW + f", pt as ({_PT}), rp as ({_RP}) select src, tgt, phi as f0, lex as f1, phi_rev as f2, lex_rev as f3, m, s, o, t, n, p from pt join rp using (src, tgt)")
def phrase_reorder_join(spark, d):
    p = _kept(spark, d, True)
    return _round(X.reorder_joined(X.phrase_table(p.select("src", "tgt", "align", "c"), *_lex(spark, d)), X.reorder_probs(p)))


@query(_P + """, cc as (select c as r, count(*) as nr from ba group by 1), f as (select sum(r) filter (r < 1000)::double as m, sum(r * ln(r) * ln(nr)) filter (r < 1000) as xy, sum(r * ln(r)) filter (r < 1000) as x, sum(r * ln(nr)) filter (r < 1000) as y, sum(r * ln(r) * ln(r)) filter (r < 1000) as xx, sum(r * nr)::double as every from cc),
g as (select *, (m * xy - x * y) / (m * xx - x * x) as a from f), h as (select a, (y - a * x) / m as b, every from g),
st as (select src, tgt, c, case when c > 1000 then c else (c + 1) * pow((c + 1) / c, a) end as star from ba, h),
t1 as (select src, case when sum(c) > 1000 then sum(c)::double else sum(star) + sum(c) / (select every from h) * (select exp(b) from h) end as t from st group by 1), t2 as (select tgt, case when sum(c) > 1000 then sum(c)::double else sum(star) + sum(c) / (select every from h) * (select exp(b) from h) end as t from st group by 1)
select src, tgt, round(star / t1.t, 6) as phi, round(star / t2.t, 6) as phi_rev from st join t1 using (src) join t2 using (tgt)""")
def phrase_gt(spark, d):
    return _round(X.turing_scores(_kept(spark, d)))


_DS = """, ks as (select greatest(count(*) filter (c = 1), 1)::double as k1, greatest(count(*) filter (c = 2), 1)::double as k2, greatest(count(*) filter (c = 3), 1)::double as k3, greatest(count(*) filter (c = 4), 1)::double as k4, count(*)::double as every from ba),
ds as (select *, k1 / (k1 + 2 * k2) as y, 1 - 2 * y * k2 / k1 as d1, 2 - 3 * y * k3 / k2 as d2, 3 - 4 * y * k4 / k3 as d3 from ks)
"""


@query(_P + _DS + "select src, tgt, round((c - y) / tc + y * dc / tc * de / every, 6) as phi, round((c - y) / te + y * de / te * dc / every, 6) as phi_rev from wt, ds")
def phrase_kn(spark, d):
    return _round(X.kneser_ney_scores(_kept(spark, d)))


@query(_P + _DS + """select src, tgt, round((c - case c when 1 then d1 when 2 then d2 else d3 end) / tc + (d1 * c1 + d2 * c2 + d3 * c3) / tc * de / every, 6) + 0 as phi,
round((c - case c when 1 then d1 when 2 then d2 else d3 end) / te + (d1 * e1 + d2 * e2 + d3 * e3) / te * dc / every, 6) + 0 as phi_rev from wt, ds""")
def phrase_mkn(spark, d):
    return _round(X.kneser_ney_scores(_kept(spark, d), True))


def _rules(spark, d):
    return X.rule_occurrences(bitext(spark, d))


_R1 = """, ip as (select row_id, lo::int as sc, hi::int as ec, se::int as se, ee::int as ee from ok where exists (select 1 from l where l.row_id = ok.row_id and l.t = ok.se) and exists (select 1 from l where l.row_id = ok.row_id and l.t = ok.ee)),
w0 as (select row_id, sc, ec, se, ee, null::int as xc, null::int as yc, null::int as xe, null::int as ye from ip),
w1 as (select a.row_id, a.sc, a.ec, a.se, a.ee, b.sc, b.ec, b.se, b.ee from ip a join ip b on a.row_id = b.row_id and a.sc <= b.sc and b.ec <= a.ec and a.se <= b.se and b.ee <= a.ee where (a.sc, a.ec, a.se, a.ee) <> (b.sc, b.ec, b.se, b.ee)),
ws as materialized (select row_number() over () as k, x.*, src as a, tgt as b from (select * from w0 union all select * from w1) x join b using (row_id)),
li as (select k, l.s, l.t, case when xc is null or l.s < xc then l.s - sc else l.s - sc - (yc - xc) end as s2, case when xe is null or l.t < xe then l.t - se else l.t - se - (ye - xe) end as t2 from ws join l on l.row_id = ws.row_id and l.s between sc and ec and l.t between se and ee and (xc is null or (l.s not between xc and yc and l.t not between xe and ye))),
ag as (select k, string_agg(s2 || '-' || t2, ' ' order by s2, t2) as align from li group by 1),
ru as (select ws.row_id, ws.k, se, ee, xe, ye, case when xc is null then array_to_string(a[sc + 1 : ec + 1], ' ') else trim(array_to_string(a[sc + 1 : xc], ' ') || ' # ' || array_to_string(a[yc + 2 : ec + 1], ' ')) end as src, case when xc is null then array_to_string(b[se + 1 : ee + 1], ' ') else trim(array_to_string(b[se + 1 : xe], ' ') || ' #1 ' || array_to_string(b[ye + 2 : ee + 1], ' ')) end as tgt, align
  from ws join ag using (k) where (ec - sc + 1) - coalesce(yc - xc + 1, 0) >= 1 and (ee - se + 1) - coalesce(ye - xe + 1, 0) >= 1 and (ec - sc + 1) - coalesce(yc - xc, 0) <= 5 and (ee - se + 1) - coalesce(ye - xe, 0) <= 5)
"""


@query(_P + _R1 + "select distinct row_id, src, tgt, align from ru")
def rule_extract_1(spark, d):
    """Rules of at most one slot."""
    return X.rule_occurrences(bitext(spark, d), max_slots=1)


@query(_P + _R1 + "select src, tgt, first(align order by n desc, align) as align, cast(sum(n) as bigint) as c from (select src, tgt, align, count(*) as n from (select distinct row_id, src, tgt, align from ru) group by 1, 2, 3) group by 1, 2")
def rule_best_align_1(spark, d):
    return X.best_align(X.count_by_align(X.rule_occurrences(bitext(spark, d), max_slots=1), False), False)


@query(None)
def rule_extract(spark, d):
    return _rules(spark, d)


@query(None)
def rule_best_align(spark, d):
    return X.best_align(X.count_by_align(_rules(spark, d), False), False)


@query(None)
def rule_cutoff(spark, d):
    r = X.best_align(X.count_by_align(_rules(spark, d), False), False)
    return X.with_totals(r).where("c > 1").select("src", "tgt", "c", "tc", "te")


@query(None)
def rule_table(spark, d):
    r = X.best_align(X.count_by_align(_rules(spark, d), False), False)
    return _round(X.rule_table(r, *_lex(spark, d), cutoff=1))


# Syntax of the target side: heads of a balanced tree, tags by word length.


def _parsed(spark, d):
    heads, tags = X.heap_heads(F.size("tgt")), F.transform("tgt", lambda w: F.concat(F.lit("T"), (F.length(w) % 4).cast("string")))
    return bitext(spark, d).withColumn("heads", heads).withColumn("pos", tags)


_DEP = """, hd as (select row_id, k::int as k, case when k = 0 then -1 else (k - 1) // 2 end as h, 'T' || (length(tgt[k + 1]) % 4) as tag from b, range(0, len(tgt)) u(k)),
dsp as (select row_id, st::int as se, en::int as ee from b, range(0, len(tgt)) u(st), range(st, len(tgt)) v(en)),
dx as (select dsp.row_id, se, ee, list(k) filter (k between se and ee and h not between se and ee) as roots, list(distinct h) filter (k between se and ee and h not between se and ee) as over, coalesce(list(distinct h) filter (k not between se and ee and h between se and ee), []) as hang,
  string_agg(case when h between se and ee then h - se else -1 end, ' ' order by k) filter (k between se and ee) as local from dsp join hd using (row_id) group by 1, 2, 3),
dt as (select *, len(roots) = 1 and len(list_filter(hang, lambda z: z <> roots[1])) = 0 as tight from dx),
dep as materialized (select dt.row_id, se, ee, case when tight or len(roots) = 1 then 'fixed' when len(over) = 1 then case when over[1] > ee then 'leftFloating' else 'rightFloating' end else 'other' end as kind, case when tight then 0 else 1 end as flag, local, case when len(roots) = 1 then hd.tag else 'X' end as tag from dt left join hd on hd.row_id = dt.row_id and hd.k = roots[1])
"""
_PS = _P + _DEP + ", ps as (select p.*, kind || chr(9) || flag || chr(9) || local as syntax, tag from p join dep using (row_id, se, ee))"


@query(_PS + " select row_id, src, tgt, align, array_to_string(list_transform(string_split(align, ' '), lambda x: split_part(x, '-', 2) || '-' || split_part(x, '-', 1)), ' ') as inverse, sc, ec, se, ee, syntax, tag from ps")
def phrase_syntax(spark, d):
    return X.phrases_with_syntax(_parsed(spark, d)).drop("prev", "next")


_SC = ", sh as (select src, tgt, syntax, count(*) as n from ps group by 1, 2, 3), sy as (select src, tgt, string_agg(printf('%.4f', n / e) || ' ' || syntax, ';' order by n desc, syntax) as syntax from (select *, sum(n) over (partition by src, tgt) as e from sh) group by 1, 2), tg as (select src, tgt, string_agg(tag, ' ' order by tag) as tags from (select distinct src, tgt, tag from ps) group by 1, 2)"


@query(_PS + _SC + " select src, tgt, syntax, tags from sy join tg using (src, tgt)")
def phrase_syntax_columns(spark, d):
    return X.syntax_columns(X.phrases_with_syntax(_parsed(spark, d)))


@query(_PS + _SC + _LW + f", pt as ({_PT}) select pt.*, syntax, tags from pt join sy using (src, tgt) join tg using (src, tgt)")
def phrase_table_syntax(spark, d):
    o = written(X.phrases_with_syntax(_parsed(spark, d)).select("src", "tgt", "align", "syntax", "tag"), "occurrences")
    pairs = written(X.best_align(X.count_by_align(o, False), False), "pairs")
    return _round(X.phrase_table(pairs, *_lex(spark, d))).join(X.syntax_columns(o), ["src", "tgt"])


@query(None)
def rule_syntax(spark, d):
    return _round(X.rules_with_syntax(_parsed(spark, d)))


@query(_PS + _R1 + ", n as (select *, 1 / count(*) over (partition by row_id, se, ee) as weight from ru) select src, tgt, round(sum(weight), 6) as c from n group by 1, 2")
def rule_fractional(spark, d):
    """Counts of rules of at most one slot in which each span's rules share one."""
    return _round(X.rules_with_syntax(_parsed(spark, d), max_slots=1).groupBy("src", "tgt").agg(F.sum("weight").alias("c")))


@query(None)
def rule_best_tags(spark, d):
    return X.best_tags(X.rules_with_syntax(_parsed(spark, d)))


@query(_P + _LW + _PT.replace("select src, tgt, ", "select src, tgt, ", 1).replace(", 2.718::double as penalty", "").replace("select src, tgt, round(c / te, 6) as phi_rev, round(lex_rev, 6) as lex_rev, round(c / tc, 6) as phi, round(lex, 6) as lex", "select src || ' ||| ' || tgt || ' ||| ' || printf('%.6f %.6f %.6f %.6f', round(c / tc, 6), round(lex, 6), round(c / te, 6), round(lex_rev, 6)) as phrase, row_number() over (order by src, tgt) as place"))
def presort_phrases(spark, d):
    """Lines of a phrase table in the order of its pairs, scores in the order 2, 3, 0, 1."""
    t = _round(X.phrase_table(_kept(spark, d), *_lex(spark, d)))
    return X.presorted(t.select("src", "tgt", F.format_string("%.6f %.6f %.6f %.6f", "phi", "lex", "phi_rev", "lex_rev").alias("text")), "phrase")


@query(_P + f", rp as ({_RP}) select src || ' ||| ' || tgt || ' ||| ' || printf('%.6f %.6f %.6f %.6f %.6f %.6f', m, s, o, t, n, p) as reorder, row_number() over (order by src, tgt) as place from rp")
def presort_reorder(spark, d):
    """Lines of the reordering table beside it."""
    t = _round(X.reorder_probs(_pairs(spark, d)))
    return X.presorted(t.select("src", "tgt", F.format_string("%.6f %.6f %.6f %.6f %.6f %.6f", "m", "s", "o", "t", "n", "p").alias("text")), "reorder")


@query(_B + ", hd as (select row_id, k::int as k, case when k = 0 then -1 else (k - 1) // 2 end as h from b, range(0, len(tgt)) u(k)) select a.row_id, a.k as word, coalesce(string_agg(c.k, ' ' order by c.k), '') as children from hd a left join hd c on c.row_id = a.row_id and c.h = a.k group by 1, 2")
def dep_children(spark, d):
    p = _parsed(spark, d).select("row_id", "heads", F.explode(F.sequence(F.lit(0), F.size("heads") - 1)).alias("word"))
    return p.select("row_id", "word", F.array_join(Y.children("heads", "word"), " ").alias("children"))


_WAY = ", hd as (select row_id, k::int as k, case when k = 0 then -1 else (k - 1) // 2 end as h from b, range(0, len(tgt)) u(k)), up as (select row_id, k, k as node, 0 as step from hd union all select up.row_id, up.k, hd.h, step + 1 from up join hd on hd.row_id = up.row_id and hd.k = up.node where hd.h >= 0)"


@query(_B + _WAY + " select row_id, k as word, string_agg(node, ' ' order by step) as path from up group by 1, 2")
def dep_path(spark, d):
    p = _parsed(spark, d).select("row_id", "heads", F.explode(F.sequence(F.lit(0), F.size("heads") - 1)).alias("word"))
    return p.select("row_id", "word", F.array_join(Y.path_to_root("heads", "word"), " ").alias("path"))


@query(_B + _WAY + " select row_id, cast(node as int) as word, string_agg(k, ' ' order by k) as yield from up group by 1, 2")
def dep_yield(spark, d):
    return Y.subtree(_parsed(spark, d), ["row_id"], "heads").select("row_id", "word", F.array_join("yield", " ").alias("yield"))


@query("select row_id, cast(k - 1 as int) as at, 'w' || (k - 1) as token, w[k] as tag, 'L' || (k % 3) as label, cast(case when k = 1 then -1 else (k - 2) // 2 end as int) as head from (select row_id, string_split(postaginfo, ' ') as w from phrase_combinete where postaginfo is not null), range(1, len(w) + 1) u(k)")
def dep_mst_parse(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null").select("row_id", T.terms("postaginfo").alias("w"))
    line = lambda f: F.array_join(F.transform("w", f), "\t")
    text = F.concat_ws("\n", line(lambda x, i: F.concat(F.lit("w"), i.cast("string"))), line(lambda x, i: x), line(lambda x, i: F.concat(F.lit("L"), ((i + 1) % 3).cast("string"))), line(lambda x, i: F.when(i == 0, 0).otherwise(F.floor((i - 1) / 2) + 1).cast("string")))
    return p.select("row_id", F.inline(Y.from_mst(text)))


@query("select row_id, 'L' || (k % 3) as label, cast(case when k = 1 then -1 else (k - 2) // 2 end as int) as head, cast(k - 1 as int) as word from (select row_id, string_split(postaginfo, ' ') as w from phrase_combinete where postaginfo is not null), range(1, len(w) + 1) u(k)")
def dep_stanford_parse(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null").select("row_id", T.terms("postaginfo").alias("w"))
    one = lambda x, i: F.concat(F.lit("L"), ((i + 1) % 3).cast("string"), F.lit("(h-"), F.when(i == 0, 0).otherwise(F.floor((i - 1) / 2) + 1).cast("string"), F.lit(", "), x, F.lit("-"), (i + 1).cast("string"), F.lit(")"))
    return p.select("row_id", F.inline(Y.from_stanford(F.array_join(F.transform("w", one), "\n"))))


@query("with x as (select phrasec, phrasee, unnest(string_split(syntaxinfo, ';')) as x from phrase_combinete where syntaxinfo is not null) select phrasec, phrasee, split_part(x, ' ', 1) as tag, cast(sum(cast(split_part(x, ' ', 2) as bigint)) as bigint) as weight from x group by 1, 2, 3")
def syntax_hist(spark, d):
    return X.tag_weights(table(spark, d, "phrase_combinete"), ["phrasec", "phrasee"], "syntaxinfo")


@query("with x as (select phrasec, unnest(string_split(syntaxinfo, ';')) as x from phrase_combinete where syntaxinfo is not null and phrasec is not null), h as (select phrasec, split_part(x, ' ', 1) as tag, cast(sum(cast(split_part(x, ' ', 2) as bigint)) as bigint) as weight from x group by 1, 2) select phrasec, tag, weight, round(weight / sum(weight) over (partition by phrasec), 6) as p from h")
def syntax_prob(spark, d):
    h = X.tag_weights(table(spark, d, "phrase_combinete").where("phrasec is not null"), ["phrasec"], "syntaxinfo")
    return _round(X.conditional(h, "phrasec", "weight"))


@query(_B + """, hd as (select row_id, k::int as k, case when k = 0 then -1 else (k - 1) // 2 end as h from b, range(0, len(tgt)) u(k)),
sp as (select row_id, st::int as start, en::int as en from b, range(0, len(tgt)) u(st), range(st, least(len(tgt), st + 5)) v(en)),
x as (select sp.row_id, start, en, list(k) filter (k between start and en and h not between start and en) as roots, list(distinct h) filter (k between start and en and h not between start and en) as over, list(distinct h) filter (k not between start and en and h between start and en) as hang from sp join hd using (row_id) group by 1, 2, 3)
select row_id, start, en as "end", case when len(roots) = 1 and coalesce(len(list_filter(hang, lambda z: z <> roots[1])), 0) = 0 then 'fixed' when len(over) = 1 and coalesce(len(hang), 0) = 0 then 'floating' else 'none' end as kind from x""")
def dep_span_type(spark, d):
    return X.span_kinds(bitext(spark, d).select("row_id", X.heap_heads(F.size("tgt")).alias("heads")))


@query("""with t as (select row_id, k - 1 as k, w[k] as tag, coalesce(w[k] <> w[k - 1], true) as fresh from (select row_id, string_split(postaginfo, ' ') as w from phrase_combinete where postaginfo is not null), range(1, len(w) + 1) u(k)),
g as (select *, sum(fresh::int) over (partition by row_id order by k) as island from t) select row_id, cast(min(k) as int) as start, cast(count(*) as int) as length, tag from g group by row_id, island, tag""")
def ner_chunks(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null")
    return X.chunks(p.select("row_id", T.terms("postaginfo").alias("tags")), "tags")


@query("select row_id, cast(k - 1 as int) as word, cast(case when k = 1 then -1 else (k - 2) // 2 end as int) as head, w[k] as label from (select row_id, string_split(postaginfo, ' ') as w from phrase_combinete where postaginfo is not null and not contains(postaginfo, ')')), range(1, len(w) + 1) u(k)")
def dep_item_parse(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null and not contains(postaginfo, ')')").select("row_id", T.terms("postaginfo").alias("w"))
    text = F.array_join(F.transform("w", lambda x, i: F.concat(F.lit("("), i.cast("string"), F.lit(","), F.when(i == 0, -1).otherwise(F.floor((i - 1) / 2)).cast("string"), F.lit(","), x, F.lit(")"))), " ")
    return p.select("row_id", F.inline(X.dependency_items(text)))


@query("select row_id, cast(k - 1 as int) as at, 'w' || (k - 1) as token, w[k] as tag, cast(case when k = 1 then -1 else (k - 2) // 2 end as int) as head from (select row_id, string_split(postaginfo, ' ') as w from phrase_combinete where postaginfo is not null), range(1, len(w) + 1) u(k)")
def dep_format_parse(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null").select("row_id", T.terms("postaginfo").alias("w"))
    text = F.array_join(F.transform("w", lambda x, i: F.concat_ws("\t", F.concat(F.lit("w"), i.cast("string")), x, F.when(i == 0, -1).otherwise(F.floor((i - 1) / 2)).cast("string"))), "\n")
    return X.dependency_lines(p.select("row_id", text.alias("text")), "text")


# Word alignment


@query("select row_id, phrasec || ' ||| ' || phrasee as line from phrase_combinete where phrasec is not null and phrasee is not null")
def bitext_merge(spark, d):
    p = table(spark, d, "phrase_combinete")
    src, tgt = (p.where(F.col(c).isNotNull()).select("row_id", T.escape_reserved(c).alias(c)) for c in ("phrasec", "phrasee"))
    return src.join(tgt, "row_id").select("row_id", F.concat_ws(" ||| ", "phrasec", "phrasee").alias("line"))


@query("select row_id, '1|' || phrasec || '|' || phrasee as forward, '1|' || phrasee || '|' || phrasec as backward from phrase_combinete where phrasec is not null and phrasee is not null")
def snt_format(spark, d):
    p = table(spark, d, "phrase_combinete").where("phrasec is not null and phrasee is not null")
    return p.select("row_id", F.concat_ws("|", F.lit("1"), "phrasec", "phrasee").alias("forward"), F.concat_ws("|", F.lit("1"), "phrasee", "phrasec").alias("backward"))


_CO = _B + ", co as (select row_id, j, tgt[j] as t, unnest(['<NULL>'] || src) as s from b, range(1, len(tgt) + 1) u(j)), t0 as (select s, t, 1 / (select count(distinct t) from co) as p from (select distinct s, t from co))"


def _em(n: int) -> str:
    out = _CO
    for k in range(1, n + 1):
        out += f", e{k} as materialized (select s, t, sum(share) as c from (select row_id, j, s, t, p / sum(p) over (partition by row_id, j) as share from co join t{k - 1} using (s, t)) group by 1, 2), t{k} as materialized (select s, t, c / sum(c) over (partition by s) as p from e{k})"
    return out


def _ibm1(n, spark, d):
    return _round(A.ibm1(bitext(spark, d), n))


for _n in (1, 2, 3):
    QUERIES[f"ibm1_em_{_n}"], SQL[f"ibm1_em_{_n}"] = partial(_ibm1, _n), _em(_n) + f" select s, t, round(p, 6) as p from t{_n}"


@query(_em(3) + ", x as (select row_id, j - 1 as j, i, round(p, 9) as p from (select row_id, j, tgt[j] as t, generate_subscripts(['<NULL>'] || src, 1) - 1 as i, unnest(['<NULL>'] || src) as s from b, range(1, len(tgt) + 1) u(j)) join t3 using (s, t)), y as (select row_id, j, first(i order by p desc, i) as i from x group by 1, 2) select row_id, cast(j as int) as j, cast(i - 1 as int) as i from y where i > 0")
def wam_best_links(spark, d):
    b = bitext(spark, d)
    return A.best_links(b, written(A.ibm1(b, 3), "t"))


@query(None)
def wam_align(spark, d):
    """The whole way: both directions by a schedule, symmetrised."""
    return A.aligned(bitext(spark, d).select("row_id", "src", "tgt"), "1**H")


_CO2 = _B + ", co as materialized (select row_id, len(src) as rows, len(tgt) as cols, j, tgt[j] as t, generate_subscripts(['<NULL>'] || src, 1) - 1 as i, unnest(['<NULL>'] || src) as s from b, range(1, len(tgt) + 1) u(j)), t0 as (select s, t, 1 / (select count(distinct t) from co) as p from (select distinct s, t from co)), a0 as (select i, j, rows, cols, 1 / (rows + 1) as p from (select distinct i, j, rows, cols from co))"


def _em2(n: int) -> str:
    out = _CO2
    for k in range(1, n + 1):
        out += f""", e{k} as materialized (select i, j, rows, cols, s, t, w / sum(w) over (partition by row_id, j) as share from (select co.*, t.p * a.p as w from co join t{k - 1} t using (s, t) join a{k - 1} a using (i, j, rows, cols))),
t{k} as materialized (select s, t, c / sum(c) over (partition by s) as p from (select s, t, sum(share) as c from e{k} group by 1, 2)), a{k} as materialized (select i, j, rows, cols, c / sum(c) over (partition by j, rows, cols) as p from (select i, j, rows, cols, sum(share) as c from e{k} group by all))"""
    return out


@query(_em2(2) + " select s, t, round(p, 6) as p from t2")
def ibm2_em_2(spark, d):
    return _round(A.ibm2(bitext(spark, d), 2)[0])


@query(_em2(2) + " select cast(i as int) as i, cast(j as int) as j, cast(rows as int) as rows, cast(cols as int) as cols, round(p, 6) as p from a2")
def ibm2_places_2(spark, d):
    return _round(A.ibm2(bitext(spark, d), 2)[1])


def _hmm_sql(n: int) -> str:
    """All alignments of a sentence are listed, each with its probability."""
    out = _B + """, un as materialized (select distinct s, t from (select unnest(src) as s, tgt from b), unnest(tgt) u(t)), b1 as materialized (select src, tgt, count(*) as times from b group by 1, 2),
z as (select max(len(src)) as m from b), t0 as (select s, t, 1 / (select count(distinct t) from un) as p from un), g0 as (select unnest(range(1 - m, m)) as d, 1 / (2 * m - 1) as p from z)"""
    for k in range(1, n + 1):
        out += f""", tr{k} as materialized (select r.rows, x, y, y - x as d, g.p / sum(g.p) over (partition by r.rows, x) as p from (select unnest(range(1, m + 1)) as rows from z) r, range(1, r.rows + 1) u(x), range(1, r.rows + 1) v(y) join g{k - 1} g on g.d = y - x),
pa{k} as (select src, tgt, times, 1 as j, [i] as way, t.p / len(src) as w from b1, range(1, len(src) + 1) u(i) join t{k - 1} t on t.s = src[i] and t.t = tgt[1]
  union all select src, tgt, times, j + 1, way || [y], w * tr.p * t.p from pa{k} join tr{k} tr on tr.rows = len(src) and tr.x = way[-1] join t{k - 1} t on t.s = src[y] and t.t = tgt[j + 1] where j < len(tgt)),
wh{k} as materialized (select *, times * w / sum(w) over (partition by src, tgt) as q from pa{k} where j = len(tgt)),
t{k} as materialized (select s, t, c / sum(c) over (partition by s) as p from (select src[way[k]] as s, tgt[k] as t, sum(q) as c from wh{k}, range(1, j + 1) u(k) group by 1, 2)),
g{k} as materialized (select d, c / sum(c) over () as p from (select way[k] - way[k - 1] as d, sum(q) as c from wh{k}, range(2, j + 1) u(k) group by 1))"""
    return out


@query(_hmm_sql(2) + " select s, t, round(p, 6) as p from t2")
def hmm_em_2(spark, d):
    return _round(A.hmm(bitext(spark, d), 2)[0])


@query(_hmm_sql(2) + " select cast(d as int) as d, round(p, 6) as p from g2")
def hmm_jumps_2(spark, d):
    return _round(A.hmm(bitext(spark, d), 2)[1])


@query(_CO + " select s, t, round(p, 6) as p from t0")
def ibm1_init(spark, d):
    return _round(A.uniform_start(bitext(spark, d)))


@query(_B + ", z as (select distinct cast(len(src) as int) as rows, cast(len(tgt) as int) as cols from b) select cast(i as int) as i, cast(j as int) as j, rows, cols, round(1 / (rows + 1), 6) as p from z, range(0, rows + 1) u(i), range(1, cols + 1) v(j)")
def ibm2_init(spark, d):
    return _round(A.position_start(bitext(spark, d)))


@query(_B + ", z as (select max(len(src)) as m from b) select cast(i as int) as i, cast(k as int) as k, round(-ln(m), 6) as logp from z, range(0, m + 1) u(i), range(1, m + 1) v(k)")
def hmm_init(spark, d):
    return _round(A.jump_start(bitext(spark, d)))


@query(_CO + " select distinct s, t from co")
def cooc_pairs(spark, d):
    return A.cooccurrence_pairs(bitext(spark, d))


@query(_B + _LEX + "select s, t, round(p, 6) as p from lc where p > 1e-7")
def norm_ttable(spark, d):
    return _round(A.normalised_pairs(X.word_pairs(bitext(spark, d))))


@query(_B + ", c as (select l.s as f1, l.t as f2, cast(len(src) as int) as f3, cast(len(tgt) as int) as f4, count(*) as c from l join b using (row_id) group by 1, 2, 3, 4) select f1, f2, f3, f4, round(c / sum(c) over (partition by f2, f3, f4), 6) as p from c")
def norm_adtable(spark, d):
    b = bitext(spark, d).select(F.explode("links").alias("l"), F.size("src").alias("f3"), F.size("tgt").alias("f4"))
    return _round(A.normalised_positions(b.select(F.col("l.s").alias("f1"), F.col("l.t").alias("f2"), "f3", "f4", F.lit(1).alias("c"))))


@query(_B + ", c as (select src[k] as w, (select count(*) from l where l.row_id = b.row_id and l.s = k - 1) as f from b, range(1, len(src) + 1) u(k)) select w, cast(f as int) as fert, round(greatest(n / t, 1e-7), 6) as p from (select w, count(*) as t from c group by 1) cross join range(0, 5) z(f) left join (select w, f, count(*) as n0 from c group by 1, 2) x using (w, f), lateral (select coalesce(n0, 0) as n)")
def norm_ntable(spark, d):
    return _round(A.normalised_fertilities(A.fertilities(bitext(spark, d)), 4))


_SY = _B + ", f as (select row_id, s, t from l), g as (select row_id, s, cast(row_number() over (partition by row_id, s order by t) - 1 as int) as t from l)"


def _two_ways(spark, d):
    """Links as they are, and a second opinion: each source word's links counted up from the first target word."""
    b = bitext(spark, d)
    back = F.expr("transform(links, (x, i) -> struct(x.s as s, size(filter(links, y -> y.s = x.s and y.t < x.t)) as t))")
    return b.select("row_id", F.col("links").alias("forward"), back.alias("backward"))


@query(_SY + " select row_id, s, t from (select * from f union select * from g)")
def sym_union(spark, d):
    return _two_ways(spark, d).select("row_id", F.inline(F.array_union("forward", "backward")))


@query(_SY + " select row_id, s, t from (select * from f intersect select * from g)")
def sym_intersect(spark, d):
    return _two_ways(spark, d).select("row_id", F.inline(F.array_intersect("forward", "backward")))


@query(None)
def sym_grow_diag_final_and(spark, d):
    return X.symmetrised(_two_ways(spark, d))


@query(_SY + " select b.row_id, coalesce(string_agg(s || '-' || t, ' ' order by s, t), '') as align from b left join f using (row_id) group by 1")
def sym_srctotgt(spark, d):
    return X.symmetrised(_two_ways(spark, d), "srctotgt")


@query(_SY + " select b.row_id, coalesce(string_agg(s || '-' || t, ' ' order by s, t), '') as align from b left join (select distinct * from g) g using (row_id) group by 1")
def sym_tgttosrc(spark, d):
    return X.symmetrised(_two_ways(spark, d), "tgttosrc")


@query(None)
def sym_grow(spark, d):
    return X.symmetrised(_two_ways(spark, d), "grow")


@query(_B + ", lk as (select row_id, s, t, s - lag(s) over (partition by row_id order by t, s) as d from l), c as (select d, count(*) as c from lk where d is not null group by 1) select cast(d as int) as d, round(c / sum(c) over (), 6) as p from c")
def norm_hmm(spark, d):
    """Shares of the distances between the source places of links in the order of their target places."""
    ls = bitext(spark, d).select(F.expr("array_sort(transform(links, x -> struct(x.t as t, x.s as s)))").alias("l"))
    steps = ls.select(F.explode(F.expr("transform(filter(sequence(1, size(l)), k -> k > 1), k -> l[k - 1].s - l[k - 2].s)")).alias("d"))
    return _round(A.normalised_jumps(steps.withColumn("c", F.lit(1))))


@query(_B + ", lk as (select row_id, src[s + 1] as w, tgt[t + 1] as v, t - lag(t) over (partition by row_id order by s, t) as d from l join b using (row_id)), c as (select length(w) % 5 as sc, length(v) % 5 as tc, d, count(*) as c from lk where d is not null group by 1, 2, 3) select cast(sc as int) as sc, cast(tc as int) as tc, cast(d as int) as d, round(c / sum(c) over (partition by sc, tc), 6) as p from c")
def norm_d4table(spark, d):
    """Distortion shares by word classes (here by length) of either side."""
    ls = bitext(spark, d).select("src", "tgt", F.expr("array_sort(links)").alias("l"))
    steps = ls.select(F.explode(F.expr("transform(filter(sequence(1, size(l)), k -> k > 1), k -> struct(length(src[l[k - 1].s]) % 5 as sc, length(tgt[l[k - 1].t]) % 5 as tc, l[k - 1].t - l[k - 2].t as d))")).alias("x"))
    return _round(A.normalised_classes(steps.select("x.*", F.lit(1).alias("c"))))


#: Word classes of a side.
CLASSES = 50
_CL = """with s as (select ['<s>'] || string_split(phrasec, ' ') as t from phrase_combinete where phrasec is not null),
w as (select word, count(*) as freq from (select unnest(t[2:]) as word from s) group by 1), cl as (select word, least(row_number() over (order by freq desc, word), 8) as class, freq from w),
bi as (select t[k] as v, t[k + 1] as w, count(*) as n from s, range(1, len(t)) u(k) group by 1, 2), cb as (select v, class, cast(sum(n) as bigint) as n from bi join cl on w = word group by 1, 2),
cs as (select class, cast(sum(freq) as bigint) as n from cl group by 1)
"""


def _classes(spark, d, side="phrasec", k=8):
    s = table(spark, d, "phrase_combinete").where(F.col(side).isNotNull()).select(T.terms(side).alias("tokens"))
    freq = s.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return A.bigrams(s), A.first_classes(C.ranked(freq, [], 1), k)


@query(_CL + "select word, class, freq from cl")
def cls_init(spark, d):
    return _classes(spark, d)[1]


@query(_CL + "select * from bi")
def cls_bigram(spark, d):
    return _classes(spark, d)[0]


@query(_CL + "select * from cb")
def cls_class_bigram(spark, d):
    return A.class_bigrams(*_classes(spark, d))


@query(_CL + "select 'bigrams' as part, round(sum(n * ln(n)), 6) as value from cb union all select 'classes', round(-sum(freq * ln(n)), 6) from cl join cs using (class)")
def cls_likelihood(spark, d):
    bi, cl = _classes(spark, d)
    return _round(A.likelihood_parts(A.class_bigrams(bi, cl), cl))


@query(_CL + """, h as (select w, v, n, cl.class as own, freq from bi join cl on w = word), k as (select unnest(range(1, 9)) as class),
x as (select h.w, own, freq, k.class, sum(case when coalesce(cb.n, 0) + h.n > 0 then (coalesce(cb.n, 0) + h.n) * ln(coalesce(cb.n, 0) + h.n) else 0 end - case when coalesce(cb.n, 0) > 0 then cb.n * ln(cb.n) else 0 end) as g,
  sum(case when cb.n > 0 then cb.n * ln(cb.n) else 0 end - case when cb.n - h.n > 0 then (cb.n - h.n) * ln(cb.n - h.n) else 0 end) as outg from h cross join k left join cb on cb.v = h.v and cb.class = k.class group by 1, 2, 3, 4),
y as (select x.w, x.own, x.class, case when x.class = x.own then 0.0 else round(x.g - o.outg + so.n * ln(so.n) - case when so.n > x.freq then (so.n - x.freq) * ln(so.n - x.freq) else 0 end - (coalesce(sc.n, 0) + x.freq) * ln(coalesce(sc.n, 0) + x.freq) + case when sc.n > 0 then sc.n * ln(sc.n) else 0 end, 6) end as gain
  from x join x o on o.w = x.w and o.class = x.own join cs so on so.class = x.own left join cs sc on sc.class = x.class)
select w as word, own as class, first(class order by gain desc, class) as best, max(gain) + 0 as gain from y group by 1, 2""")
def cls_best_move(spark, d):
    return A.best_moves(*_classes(spark, d), 8)


@query(None)
def cls_exchange(spark, d):
    """Classes of both sides after three full passes, or fewer if no word moves any more."""
    out = None
    for side in ("phrasec", "phrasee"):
        part = A.exchanged(*_classes(spark, d, side, CLASSES), CLASSES, 3).select(F.lit(side).alias("side"), "word", "class", "freq")
        out = part if out is None else out.unionByName(part)
    return out


@query(_CL.replace("phrasec", "phrasee") + "select word, class, freq from cl")
def cls_init_target(spark, d):
    return _classes(spark, d, "phrasee")[1]


@query(_CL + "select word, class + 1 as class from cl")
def cls_word_map(spark, d):
    return _classes(spark, d)[1].select("word", (F.col("class") + 1).alias("class"))
