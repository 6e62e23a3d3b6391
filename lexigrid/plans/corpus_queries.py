"""Corpus, set, sort and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.written import written
from lexigrid.operators import classify as K
from lexigrid.operators import corpus as C
from lexigrid.operators import joins as J
from lexigrid.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


QUERIES = Q
_TOK = f"regexp_extract_all(text, '{T.TOKEN}')"
_PAIR = "select row_id, phrasec, phrasee, string_split(phrasec, ' ') as src, string_split(phrasee, ' ') as tgt, alignstr from phrase_combinete where phrasec is not null and phrasee is not null and alignstr is not null"
_FREQ = f"select word, count(*) as freq from (select unnest({_TOK}) as word from documents) group by 1"


def bitext(spark: SparkSession, d: str) -> DataFrame:
    """Phrase pairs as aligned sentences: row_id, src, tgt, links."""
    p = table(spark, d, "phrase_combinete", spark.sparkContext.defaultParallelism).where("phrasec is not null and phrasee is not null and alignstr is not null")
    src, tgt = T.terms("phrasec"), T.terms("phrasee")
    return p.select("row_id", src.alias("src"), tgt.alias("tgt"), T.links("alignstr", F.size(src), F.size(tgt)).alias("links"))


@query("select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(line) > 0")
def scan_nonempty(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.lines("text")).alias("line")).where(F.length("line") > 0)


@query(_PAIR.replace("select row_id, phrasec, phrasee, string_split(phrasec, ' ') as src, string_split(phrasee, ' ') as tgt, alignstr", "select row_id, len(string_split(phrasec, ' ')) as rows, len(string_split(phrasee, ' ')) as cols, len(string_split(alignstr, ' ')) as links"))
def scan_bitext(spark, d):
    b = bitext(spark, d)
    return b.select("row_id", F.size("src").alias("rows"), F.size("tgt").alias("cols"), F.size("links").alias("links"))


@query(f"with t as ({_PAIR}), w as (select src as words from t union all select tgt from t), f as (select word, count(*) as freq from (select unnest(words) as word from w) group by 1), dict as (select word, 1 + row_number() over (order by freq desc, word) as id from f), s as (select row_id, k, src[k] as a from t, range(1, len(src) + 1) u(k)), e as (select row_id, k, tgt[k] as a from t, range(1, len(tgt) + 1) u(k)), x as (select row_id, string_agg(id::varchar, ' ' order by k) as v from s join dict on a = word group by 1), y as (select row_id, string_agg(id::varchar, ' ' order by k) as v from e join dict on a = word group by 1) select row_id, x.v || ' ||| ' || y.v || ' ||| ' || alignstr as line from t join x using (row_id) join y using (row_id)")
def sink_encoded_bitext(spark, d):
    b = bitext(spark, d)
    words = b.select(F.explode(F.concat("src", "tgt")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    dic = C.ranked(words, [], 2)
    ids = lambda c: C.encode(b, dic, "row_id", F.col(c)).select("row_id", F.array_join("ids", " ").alias(c))
    j = b.select("row_id", T.link_text(F.col("links")).alias("links")).join(ids("src"), "row_id").join(ids("tgt"), "row_id")
    return j.select("row_id", F.concat_ws(" ||| ", "src", "tgt", "links").alias("line"))


@query("select * from (values (0, '<s>'), (1, '</s>'), (2, 'unk')) t(id, word)")
def literal_rows(spark, d):
    return spark.createDataFrame([(0, "<s>"), (1, "</s>"), (2, "unk")], "id int, word string")


@query("select e.item_id, e.text || chr(10) || 'notree' || chr(10) || d.text || chr(10) || '========' as block from eval_items e join documents d on d.doc_id = e.item_id where d.text is not null and e.text is not null")
def dev_block_format(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"), "text")
    return C.dev_blocks(table(spark, d, "eval_items").where("text is not null"), docs, "item_id", "text")


@query(f"select doc_id, array_to_string({_TOK}, '|') as tokens from documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens("text"), "|").alias("tokens"))


@query("select row_id, replace(coalesce(syntaxinfo, '') || ' ||| ' || phrasec, ' ||| ', ' -S:P- ') as line from phrase_combinete where phrasec is not null")
def escape_separator(spark, d):
    p = table(spark, d, "phrase_combinete").where("phrasec is not null")
    return p.select("row_id", T.escape_reserved(F.concat_ws(" ||| ", F.coalesce("syntaxinfo", F.lit("")), "phrasec")).alias("line"))


@query("select row_id from phrase_combinete where len(string_split(phrasec, ' ')) <= 3 and len(string_split(phrasee, ' ')) <= 3")
def filter_sentlen(spark, d):
    p = table(spark, d, "phrase_combinete")
    return C.within_length(p, T.terms("phrasec"), T.terms("phrasee"), 3).select("row_id")


@query("select doc_id from documents where not starts_with(text, '<s>')")
def filter_prefix(spark, d):
    return table(spark, d, "documents").where(~F.startswith("text", F.lit("<s>"))).select("doc_id")


@query("select row_id, array_to_string(list_transform(string_split(alignstr, ' '), lambda x: split_part(x, '-', 2) || '-' || split_part(x, '-', 1)), ' ') as back from (" + _PAIR + ")")
def align_reverse(spark, d):
    return bitext(spark, d).select("row_id", T.link_text(T.reverse_links(F.col("links"))).alias("back"))


@query("select row_id, cast(split_part(x, '-', 1) as int) as s, cast(split_part(x, '-', 2) as int) as t from (select distinct row_id, unnest(string_split(alignstr, ' ')) as x from (" + _PAIR + "))")
def align_parse(spark, d):
    return bitext(spark, d).select("row_id", F.inline("links"))


@query("with l as (select distinct row_id, cast(split_part(x, '-', 1) as int) as s, cast(split_part(x, '-', 2) as int) as t from (select row_id, unnest(string_split(alignstr, ' ')) as x from (" + _PAIR + ")) ) select p.row_id, k - 1 as t, (select count(*) from l where l.row_id = p.row_id and l.t = k - 1) as fan from (" + _PAIR + ") p, range(1, len(tgt) + 1) u(k)")
def align_fanout(spark, d):
    b = bitext(spark, d).withColumn("t", F.explode(F.sequence(F.lit(0), F.size("tgt") - 1)))
    return b.select("row_id", "t", F.expr("size(filter(links, x -> x.t = t))").alias("fan"))


@query("select row_id, array_to_string(list_distinct_ordered, ' ') as tags from (select row_id, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select row_id, list_filter(string_split(postaginfo || ' ' || posframeinfo, ' '), lambda x: x <> '') as l from phrase_combinete where postaginfo is not null and posframeinfo is not null))")
def tagset_union(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null and posframeinfo is not null")
    return p.select("row_id", T.union_tags(F.col("postaginfo"), F.col("posframeinfo")).alias("tags"))


@query("select row_id, array_to_string(list_transform(string_split('-LRB- ' || postaginfo || ' -RRB-', ' '), lambda x: case x when '-LRB-' then '(' when '-RRB-' then ')' else x end), ' ') as tags from phrase_combinete where postaginfo is not null")
def pos_normalize(spark, d):
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null")
    return p.select("row_id", F.array_join(T.plain_brackets(F.concat(F.array(F.lit("-LRB-")), T.terms("postaginfo"), F.array(F.lit("-RRB-")))), " ").alias("tags"))


@query("select rec_id, case when num between 0 and 1073741823 and shard is not null then shard::bigint * 1073741824 + num end as packed, case when num between 0 and 1073741823 then shard::bigint end as a, case when num between 0 and 1073741823 and shard is not null then num end as b from ngram_join")
def pair_pack(spark, d):
    """Both numbers in one and back again; null where one of them is null or the second one has no place in 30 bits."""
    g = table(spark, d, "ngram_join")
    packed = F.when(F.col("num").between(0, (1 << 30) - 1), F.shiftleft(F.col("shard").cast("bigint"), 30) + F.col("num"))
    g = g.select("rec_id", packed.alias("packed"))
    return g.select("rec_id", "packed", F.shiftright("packed", 30).alias("a"), F.col("packed").bitwiseAND(F.lit((1 << 30) - 1)).alias("b"))


@query("select rec_id, round(ln(num), 6) as l, round(exp(ln(num) / 3), 6) as root, round(pow(num, 0.25), 6) as p from ngram_join where num > 0")
def math_ln_exp_pow(spark, d):
    g = table(spark, d, "ngram_join").where("num > 0")
    return g.select("rec_id", F.round(F.ln("num"), 6).alias("l"), F.round(F.exp(F.ln("num") / 3), 6).alias("root"), F.round(F.pow("num", F.lit(0.25)), 6).alias("p"))


@query(f"with w as ({_FREQ}) select lower(word) as lower, first(word order by freq desc, word) as cased from w group by 1")
def truecase_model(spark, d):
    return C.truecase(table(spark, d, "documents"))


@query("select rec_id, num from ngram_join where words = 'of the'")
def filter_eq_point(spark, d):
    return table(spark, d, "ngram_join").where("words = 'of the'").select("rec_id", "num")


@query(_FREQ)
def word_count(spark, d):
    return C.word_count(table(spark, d, "documents"))


def _dict(reserved: list[str], first: int) -> str:
    r = ", ".join(f"({i}, '{w}')" for i, w in enumerate(reserved))
    names = ", ".join(f"'{w}'" for w in reserved)
    return f"with f as ({_FREQ}), r as (select * from (values {r}) t(id, word)) select word, cast(id as bigint) as id, coalesce(freq, 0) as freq from r left join f using (word) union all select word, {first - 1} + row_number() over (order by freq desc, word), freq from f where word not in ({names})"


@query(_dict(["<s>", "</s>", "unk"], 3))
def dict_lm(spark, d):
    return C.ranked(C.word_count(table(spark, d, "documents")), ["<s>", "</s>", "unk"], 3)


@query(_dict(["#", "UNK"], 2))
def dict_tm(spark, d):
    return C.ranked(C.word_count(table(spark, d, "documents")), ["#", "UNK"], 2)


@query(_dict(["UNK", "<s>"], 2))
def dict_class(spark, d):
    return C.ranked(C.word_count(table(spark, d, "documents")), ["UNK", "<s>"], 2)


@query(f"with dict as ({_dict(['<s>', '</s>', 'unk'], 3)}), t as (select item_id, {_TOK} as w from eval_items) select item_id, string_agg(coalesce(id, 0)::varchar, ' ' order by k) as ids from (select item_id, k, w[k] as word from t, range(1, len(w) + 1) u(k)) left join dict using (word) group by 1")
def dict_encode(spark, d):
    e = C.encode(table(spark, d, "eval_items"), dict_lm(spark, d), "item_id", T.tokens("text"))
    return e.select("item_id", F.array_join("ids", " ").alias("ids"))


@query(f"select item_id, array_to_string({_TOK}, ' ') as text from eval_items")
def dict_decode(spark, d):
    items = table(spark, d, "eval_items")
    dic = C.ranked(C.word_count(items), ["<s>", "</s>", "unk"], 3)
    return C.decode(C.encode(items, dic, "item_id", T.tokens("text")), dic, "item_id")


@query(f"with dict as ({_dict(['<s>', '</s>', 'unk'], 3)}), t as (select doc_id, {_TOK} as w from documents), e as (select doc_id, string_agg(coalesce(id, 0)::varchar, ' ' order by k) as ids from (select doc_id, k, w[k] as word from t, range(1, len(w) + 1) u(k)) left join dict using (word) group by 1) select doc_id, coalesce(ids, '') as ids from documents left join e using (doc_id)")
def dict_encode_docs(spark, d):
    e = C.encode(table(spark, d, "documents"), dict_lm(spark, d), "doc_id", T.tokens("text"))
    return e.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query(f"select doc_id, coalesce(array_to_string({_TOK}, ' '), '') as text from documents")
def dict_decode_docs(spark, d):
    dic = dict_lm(spark, d)
    return C.decode(C.encode(table(spark, d, "documents"), dic, "doc_id", T.tokens("text")), dic, "doc_id")


@query("select word, freq, row_number() over (order by freq desc, word) as place from (" + _FREQ + ")")
def sort_desc_freq(spark, d):
    return C.ranked(C.word_count(table(spark, d, "documents")), [], 1).select("word", "freq", F.col("id").alias("place"))


@query("select word, freq from (" + _FREQ + ") order by freq desc, word limit 20")
def topk_words(spark, d):
    return C.word_count(table(spark, d, "documents")).orderBy(F.desc("freq"), "word").limit(20)


_DIE = "('0x' || substr(md5(doc_id::varchar), 1, 4))::int"


@query(f"select doc_id, case when {_DIE} % 100 < 10 then 'test' else 'train' end as part from documents")
def split_holdout(spark, d):
    return C.hold_out(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("select doc_id from documents order by md5(doc_id::varchar), doc_id limit 50")
def sample_rows(spark, d):
    return C.sampled(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("select words, row_number() over (order by words) as id from (select distinct words from n_gram where words is not null)")
def ngram_index(spark, d):
    g = table(spark, d, "n_gram").where("words is not null").select(F.col("words").alias("word")).distinct().withColumn("freq", F.lit(1))
    return C.ranked(g, [], 1).select(F.col("word").alias("words"), "id")


@query("select doc_id, cast(floor((sum(coalesce(n_chars, 0)) over (order by doc_id) - 1) / 20000) as bigint) as bucket from documents")
def corpus_split(spark, d):
    return C.split_by_size(table(spark, d, "documents"), "doc_id", F.coalesce("n_chars", F.lit(0)), 20000)


@query(f"select round(regr_slope(ln(b), ln(a)), 6) as slope, round(regr_intercept(ln(b), ln(a)), 6) as intercept from (select len(w) as a, len(list_distinct(w)) as b from (select {_TOK} as w from documents where text is not null) where len(w) > 0)")
def type_token_regression(spark, d):
    t = table(spark, d, "documents").select(T.tokens("text").alias("w")).where(F.size("w") > 0)
    return C.type_token_line(t, F.size(F.array_distinct("w")), F.size("w")).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("select words as word, num from n_gram union all select words, num from ngram_join")
def union_all(spark, d):
    pick = lambda t: table(spark, d, t).select(F.col("words").alias("word"), "num")
    return pick("n_gram").unionByName(pick("ngram_join"))


@query("select words, num from ngram_join where words is not null and words not in (select words from n_gram where words is not null)")
def except_keys(spark, d):
    return C.except_keys(table(spark, d, "ngram_join").where("words is not null").select("words", "num"), table(spark, d, "n_gram"), "words")


@query("select distinct phrasec, phrasee from phrase_combinete")
def distinct_pairs(spark, d):
    return table(spark, d, "phrase_combinete").select("phrasec", "phrasee").distinct()


@query("select max(len(string_split(phrasec, ' '))) as longest from phrase_combinete")
def max_sentlen(spark, d):
    return table(spark, d, "phrase_combinete").agg(F.max(F.size(F.when(F.col("phrasec").isNotNull(), T.terms("phrasec")))).alias("longest"))


@query("select user_id as key, count(*) as n from events where user_id is not null group by 1")
def key_frequency(spark, d):
    return J.key_frequency(table(spark, d, "events"), "user_id")


# Joins: customers (some without events) and events (skewed user_id), orders by customer.

_SIDES = "with a as (select user_id as k, event_id, event_type from events), b as (select o_custkey as k, o_orderkey, o_totalprice from orders)"
_SUM = " select k, count(*) as n, cast(sum(event_id) as bigint) as e, cast(sum(o_orderkey) as bigint) as o from {} group by 1"


def _sides(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", "event_type")
    return a, table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")


def _sum(j: DataFrame) -> DataFrame:
    return j.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("e"), F.sum("o_orderkey").alias("o"))


def _join(name: str, how: str, f):
    def run(spark, d):
        return _sum(f(*_sides(spark, d)))

    run.__name__ = name
    query(_SIDES + _SUM.format(f"a {how} join b using (k)"))(run)


for _how in ("inner", "left", "right"):
    _join(f"join_block_{_how}", _how, lambda a, b, h=_how: J.block_join(a, b, "k", 3, 2, h))
    _join(f"join_lean_{_how}", _how, lambda a, b, h=_how: J.lean_join(a, b, "k", how=h))
_join("join_broadcast", "inner", lambda a, b: J.broadcast_join(a, b, "k"))


@query(_SIDES + " select coalesce(a.k, b.k) as key, a.n as n_left, b.n as n_right, a.s as sum_left, b.s as sum_right from (select k, count(*) as n, cast(sum(event_id) as bigint) as s from a where k is not null group by 1) a full join (select k, count(*) as n, cast(sum(o_orderkey) as bigint) as s from b where k is not null group by 1) b using (k)")
def cogroup_sizes(spark, d):
    a, b = _sides(spark, d)
    c = J.cogroup_sizes(a, b, "k", "event_id", "o_orderkey")
    return c.select("key", "n_left", "n_right", F.col("sum_left").cast("bigint"), F.col("sum_right").cast("bigint"))


@query(_SIDES + ", r as (select k as key, event_id as v, null as w from a union all select k, null, o_orderkey from b) select key, coalesce(string_agg(v::varchar, ' ' order by v), '') as lefts, coalesce(string_agg(w::varchar, ' ' order by w), '') as rights from r where key is not null group by 1")
def cogroup_lists(spark, d):
    """The lists of either side, as text; at these sizes a key has one cell."""
    c = J.cogroup(*_sides(spark, d), "k", "event_id", "o_orderkey")
    return c.select("key", F.array_join("lefts", " ").alias("lefts"), F.array_join("rights", " ").alias("rights"))


@query("select rec_id, id, first_seen_at from ngram join ngram_seen using (id)")
def join_bloom(spark, d):
    """Records whose key can't have been counted before stop at a Bloom filter of the known keys."""
    return J.bloom_join(table(spark, d, "ngram").select("rec_id", "id"), table(spark, d, "ngram_seen"), "id", 5000)


@query("select k, greatest(least(case when n >= 50 then 8 else 1 end, 32), 1) as fixed, greatest(least(cast(floor(sqrt(32.0 * 10 / n)) as int), 32), 1) as root from (select user_id as k, count(*) as n from events where user_id is not null group by 1)")
def replication_policies(spark, d):
    n = J.key_frequency(table(spark, d, "events"), "user_id")
    return n.select(F.col("key").alias("k"), J.fixed_replication(F.col("n"), 8, 50).alias("fixed"), J.root_replication(F.col("n"), F.lit(10), 32).alias("root"))


@query("select n_name, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def join_star(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    n = J.broadcast_join(c, table(spark, d, "nation"), "n_nationkey").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return J.broadcast_join(n, table(spark, d, "region"), "r_regionkey").groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id as k, greatest(least(cast(floor(count(*) * 0.01) as int), 32), 1) as copies from events where user_id is not null group by 1")
def lean_replication_factor(spark, d):
    return J.key_frequency(table(spark, d, "events"), "user_id").select(F.col("key").alias("k"), J.replication(F.col("n"), 32).alias("copies"))


@query("select rec_id, words, num, cast(total as bigint) as total from ngram_join join (select words, sum(num) as total from n_gram group by 1) using (words)")
def join_inner_history(spark, d):
    totals = table(spark, d, "n_gram").where("words is not null").groupBy("words").agg(F.sum("num").alias("total"))
    return J.lean_join(table(spark, d, "ngram_join").where("words is not null").select("rec_id", "words", "num"), totals, "words")


@query("select distinct words from n_gram where words is not null and words not in (select words from ngram_join where words is not null)")
def join_anti_nobow(spark, d):
    g = table(spark, d, "n_gram").where("words is not null").select("words").distinct()
    return C.except_keys(g, table(spark, d, "ngram_join"), "words")


@query("select words, num, regexp_extract(words, '^[^ ]+( [^ ]+)?') as key from n_gram where words is not null")
def partition_by_history(spark, d):
    """n-grams laid out by their first two words, sorted within partitions: grams of a history lie together."""
    g = table(spark, d, "n_gram").where("words is not null").select("words", "num", F.regexp_extract("words", "^[^ ]+( [^ ]+)?", 0).alias("key"))
    return g.repartition("key").sortWithinPartitions("words")


@query("select row_id, regexp_extract_all(line, 'w[0-9]+_NNS? w[0-9]+_VB[A-Z]*( |$)') as hits from (select row_id, list_aggregate(list_transform(string_split(postaginfo, ' '), lambda x, i: 'w' || (i - 1) || '_' || x), 'string_agg', ' ') as line from phrase_combinete where postaginfo is not null)".replace("regexp_extract_all(line, 'w[0-9]+_NNS? w[0-9]+_VB[A-Z]*( |$)') as hits", "list_aggregate(list_transform(regexp_extract_all(line, 'w[0-9]+_NNS? w[0-9]+_VB[A-Z]*(?: |$)'), lambda x: trim(x)), 'string_agg', '|') as hits"))
def token_regex(spark, d):
    """Nouns that a verb follows, by a pattern over word_tag tokens."""
    p = table(spark, d, "phrase_combinete").where("postaginfo is not null").select("row_id", T.terms("postaginfo").alias("tags"))
    words = F.transform("tags", lambda x, i: F.concat(F.lit("w"), i.cast("string")))
    hits = F.array_join(T.token_pattern({"word": words, "tag": F.col("tags")}, r"w[0-9]+_NNS? w[0-9]+_VB[A-Z]*"), "|")
    return p.select("row_id", F.when(hits != "", hits).alias("hits"))


@query(None)
def classify_language(spark, d):
    """Documents with the language that a classifier over hashed characters gives them, learned on nine tenths of the labelled ones."""
    return K.predicted(table(spark, d, "documents").select("doc_id", "text", "lang"), "text", "lang", "doc_id").select("doc_id", "lang", "part", "predicted")


@query(None)
def classify_accuracy(spark, d):
    return K.accuracy(K.predicted(table(spark, d, "documents").select("doc_id", "text", "lang"), "text", "lang", "doc_id"), "lang")


@query("select words from n_gram where words is not null intersect select words from ngram_join where words is not null")
def set_intersect(spark, d):
    pick = lambda t: table(spark, d, t).where("words is not null").select("words")
    return pick("n_gram").intersect(pick("ngram_join"))


@query("select words, shard, num from ngram_join where words is not null")
def partition_by_pair(spark, d):
    """Rows laid out by a pair of columns."""
    return table(spark, d, "ngram_join").where("words is not null").select("words", "shard", "num").repartition("words", "shard")


@query(f"select doc_id, array_to_string(({_TOK})[2:4], ' ') as part from documents")
def span_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.span_text(T.tokens("text"), 1, 3).alias("part"))


@query("select rec_id, shard::bigint * 51 + num % 51 as packed, shard::bigint as word, num % 51 as class from ngram_join where num is not null and num >= 0 and shard is not null")
def class_pack(spark, d):
    g = table(spark, d, "ngram_join").where("num >= 0 and shard is not null").select("rec_id", T.packed_class(F.col("shard").cast("bigint"), F.col("num") % 51, 50).alias("packed"))
    word, cls = T.unpacked_class(F.col("packed"), 50)
    return g.select("rec_id", "packed", word.alias("word"), cls.alias("class"))


@query("select o_orderkey, round((o_totalprice::decimal(18,4) + o_custkey)::double, 4) as plus, round((o_totalprice::decimal(18,4) - o_custkey)::double, 4) as minus, round((o_totalprice::decimal(18,4) * o_custkey)::double, 4) as times, case when o_custkey <> 0 then round(o_totalprice * 100)::bigint * 10 // o_custkey end as over_thousandths, round(greatest(o_totalprice::decimal(18,4), o_custkey)::double, 4) as larger, round(least(o_totalprice::decimal(18,4), o_custkey)::double, 4) as smaller from orders")
def math_decimals(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *(F.floor(x * 1000).cast("bigint").alias("over_thousandths") if k == "over" else F.round(x.cast("double"), 4).alias(k) for k, x in T.decimals(F.col("o_totalprice"), F.col("o_custkey")).items()))


@query("with r as (select row_id, string_split(case when len(string_split(phrasec, ' ')) > 1 then '# ' || phrasec || ' #1' else phrasec end, ' ') as w from phrase_combinete where phrasec is not null) select row_id, len(list_filter(w, lambda x: regexp_full_match(x, '#[0-9]*'))) as slots, array_to_string(list_transform(w, lambda x: case x when '#' then '#1' when '#1' then '#' else x end), ' ') as turned from r")
def rule_slots(spark, d):
    """Non-terminals of a rule side, and the side with its slots' tags as they are seen from the other side."""
    p = table(spark, d, "phrase_combinete").where("phrasec is not null").select("row_id", T.terms("phrasec").alias("w"))
    p = p.withColumn("w", F.when(F.size("w") > 1, F.concat(F.array(F.lit("#")), "w", F.array(F.lit("#1")))).otherwise(F.col("w")))
    return p.select("row_id", F.size(F.filter("w", T.is_slot)).cast("bigint").alias("slots"), F.array_join(T.swap_slots(F.col("w")), " ").alias("turned"))


@query("select row_id, array_to_string(list_transform(string_split(phrasec, ' '), lambda x, i: case when i = 1 then '#' when i = 2 then '# ' || x else x end), ' ') as text from phrase_combinete where phrasec is not null")
def rule_decode(spark, d):
    """Rule sides of word ids (the first word a slot, the second one a slot with its word) in words again."""
    p = table(spark, d, "phrase_combinete").where("phrasec is not null").select("row_id", T.terms("phrasec").alias("w"))
    words = p.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    dic = written(C.ranked(words, [], 2), "dictionary")
    e = C.encode(p, dic, "row_id", F.col("w"))
    toks = F.transform("ids", lambda x, i: F.when(i == 0, "#").when(i == 1, F.concat(F.lit("#"), x.cast("string"))).otherwise(x.cast("string")))
    return C.decode_rules(e, dic, "row_id", toks)


@query(f"with dict as ({_dict(['UNK', '<s>'], 2)}), t as (select doc_id, {_TOK} as w from documents), e as (select doc_id, string_agg(coalesce(id, 0)::varchar, ' ' order by k) as ids from (select doc_id, k, w[k] as word from t, range(1, len(w) + 1) u(k)) left join dict using (word) group by 1) select doc_id, coalesce(ids, '') as ids from documents left join e using (doc_id)")
def class_encode(spark, d):
    """Documents as word ids for the training of classes."""
    e = C.encode(table(spark, d, "documents"), dict_class(spark, d), "doc_id", T.tokens("text"))
    return e.select("doc_id", F.array_join("ids", " ").alias("ids"))


_SIZES = "select row_id, coalesce(len(string_split(phrasec, ' ')), 0) as a, coalesce(len(string_split(phrasee, ' ')), 0) as b from phrase_combinete"


@query(f"select row_id, case when least(a, b) < 1 then 'empty' when greatest(a, b) > 4 then 'long' when greatest(a, b) > least(a, b) * 2.5 then 'ratio' end as verdict from ({_SIZES}) where least(a, b) < 1 or greatest(a, b) > 4 or greatest(a, b) > least(a, b) * 2.5")
def clean_rejects(spark, d):
    """What a length and ratio filter leaves out, and why."""
    p = table(spark, d, "phrase_combinete").select("row_id", *(F.coalesce(T.terms(c), F.array()).alias(c) for c in ("phrasec", "phrasee")))
    return C.clean(p, F.col("phrasec"), F.col("phrasee"), 4, 2.5)[1].select("row_id", "verdict")


@query("select doc_id from documents where len(" + _TOK + ") <= 100 and text is not null")
def filter_one_side(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.where(F.size(T.tokens("text")) <= 100).select("doc_id")


@query(f"with w as ({_FREQ}), m as (select lower(word) as lower, first(word order by freq desc, word) as cased from w group by 1), l as (select doc_id, k, (string_split(text, chr(10)))[k] as line from documents, range(1, len(string_split(text, chr(10))) + 1) u(k) where text is not null), f as (select *, regexp_extract(line, '{T.TOKEN}') as first from l), j as (select f.*, case when first = '' or cased is null then line else split_part(line, first, 1) || cased || substr(line, length(split_part(line, first, 1)) + length(first) + 1) end as new from f left join m on m.lower = lower(first)) select doc_id, string_agg(new, chr(10) order by k) as text from j group by 1 union all select doc_id, null from documents where text is null")
def truecase_apply(spark, d):
    docs = table(spark, d, "documents")
    return C.truecased(docs, C.truecase(docs), "doc_id")
