"""Full-text, BM25 and vector queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import scalars as S
from brindle.operators import retrieval as R
from brindle.operators import vectors as V
from brindle.operators.blockindex import BlockIndex, write_segment
from brindle.operators.pivots import nearest
from brindle.operators.relational import rank_in_group
from brindle.plans.registry import query, table
from brindle.session import scratch, stored
from brindle.sources.sinks import results_json

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+')"
T = TOKENS.format("text")
BASE = rf"""
tok as (select doc_id as id, {T} as t from documents),
c as (select term, id, doc_len, count(*) as tf from (select id, len(t) as doc_len, unnest(t) as term from tok) group by all),
q as (select item_id as qid, array_to_string(list_filter({T}, lambda x: length(x) >= 4)[1:2], ' ') as query from benchmark),
qt as (select qid, term, count(*) as times, any_value(k) as n_terms from (select qid, unnest(ts) as term, len(list_distinct(ts)) as k from (select qid, {TOKENS.format("query")} as ts from q)) group by qid, term),
st as (select count(*) as n_docs, sum(len(t)) / count(*)::double as avg_len from tok),
df as (select term, count(*) as df from c group by term),
s as (select qid, id, n_terms, sum(ln(1e0 + (n_docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * doc_len / avg_len)) * times) as score, count(*) as n_matched
  from c join df using (term) join qt using (term), st group by all)
"""
WITH = "with " + BASE


def asked(spark, d):
    """Two longer words of each benchmark text as a query."""
    t = F.filter(S.tokenize("text"), lambda x: F.length(x) >= 4)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(t, 1, 2), " ").alias("query"))


def docs(spark, d):
    return table(spark, d, "documents")


#: Indexes of this application by the folder of the tables: written once, and read by every search after that.
INDEXES: dict[tuple[str, str], str] = {}


def index(spark, d):
    """The stored index of the documents, which are written in two segments."""
    key = (spark.sparkContext.applicationId, d)
    if key not in INDEXES:
        path = scratch(spark, "index")
        write_segment(docs(spark, d).where("doc_id % 4 > 0"), path)
        write_segment(docs(spark, d).where("doc_id % 4 = 0"), path)
        INDEXES[key] = path
    return BlockIndex(spark, INDEXES[key])


def counted(spark, d):
    """The counts of the terms asked for, and these terms: each read several times, the texts once."""
    terms = stored(R.query_terms(asked(spark, d)), "terms")
    return stored(R.term_counts(docs(spark, d), terms=terms), "counts"), terms


def ascii_benchmark(spark, d):
    """Byte n-grams equal character n-grams only here."""
    return table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))


@query("bm_01", "select doc_id, source || ' ' || coalesce(lang, '') || ' ' || coalesce(text, '') as s from documents")
def bm_01(spark, d):
    return docs(spark, d).select("doc_id", F.concat("source", F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("s"))


@query("bm_02", WITH + "select term, df, n_docs, round(avg_len, 6) as avg_len from df, st")
def bm_02(spark, d):
    return R.document_frequencies(docs(spark, d)).select("term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("bm_03", WITH + "select term, round(ln(1e0 + (n_docs - df + 5e-1) / (df + 5e-1)), 6) as idf from df, st")
def bm_03(spark, d):
    return R.with_idf(bm_02(spark, d)).select("term", F.round("idf", 6).alias("idf"))


BM_04 = WITH + "select * from (select qid, id, round(score, 6) as score, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10"


@query("bm_04", BM_04)
def bm_04(spark, d):
    """From the stored index, whose blocks are skipped where they can't reach the tenth place."""
    return index(spark, d).search(asked(spark, d), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("bm_04_unindexed", BM_04)
def bm_04_unindexed(spark, d):
    """The same from the texts themselves."""
    return R.top_k(R.bm25(docs(spark, d), asked(spark, d)), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("bm_05", WITH + """, q2 as (select distinct qid, term from qt)
select s.qid, s.id as doc_id, bool_or(regexp_matches(lower(split_part(text, chr(10), 1)), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) as boosted from s join documents on id = doc_id join q2 using (qid) group by all""")
def bm_05(spark, d):
    """All documents that have a term of a query, and whether their first line doubles their score."""
    hits = R.bm25(docs(spark, d), asked(spark, d)).select("qid", "id")
    terms = R.query_terms(asked(spark, d)).groupBy("qid").agg(F.collect_set("term").alias("terms"))
    lines = docs(spark, d).select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("line"))
    boosted = F.exists("terms", lambda t: S.contains_word("line", t))
    return hits.join(terms, "qid").join(lines, "id").select("qid", F.col("id").alias("doc_id"), boosted.alias("boosted"))


@query("bm_06", r"with b as (select item_id, regexp_replace(lower(text), '[^\x00-\x7F]', '?', 'g') as t from benchmark), g as (select item_id, hex(substr(t, i, 3)) as gram from b, unnest(range(1, length(t) - 1)) as u(i)) select item_id, gram, count(*) as n from g group by all")
def bm_06(spark, d):
    return R.ngram_bag(ascii_benchmark(spark, d), "item_id", "text")


@query("bm_07", r"""
with b as (select item_id, regexp_replace(lower(text), '[^\x00-\x7F]', '?', 'g') as t from benchmark), g as (select item_id, substr(t, i, 3) as gram, count(*) as n from b, unnest(range(1, length(t) - 1)) as u(i) group by all),
l as (select item_id, sqrt(sum(n * n)) as len from g group by 1),
p as (select a.item_id as x, b.item_id as y, sum(a.n * b.n) as dot from g a join g b on a.gram = b.gram where a.item_id % 50 = 0 group by all)
select x, y, round(dot / (la.len * lb.len), 6) as cosine from p join l la on x = la.item_id join l lb on y = lb.item_id""")
def bm_07(spark, d):
    """The items whose number 50 divides against all."""
    bag = R.ngram_bag(ascii_benchmark(spark, d), "item_id", "text")
    a, b = bag.where("item_id % 50 = 0").withColumnRenamed("item_id", "x"), bag.withColumnRenamed("item_id", "y")
    return R.shared_cosine(a, b).select("x", "y", F.round("cosine", 6).alias("cosine"))


@query("bm_08", WITH + """, r as (select qid, id, row_number() over (partition by qid order by score desc, id) as r1, row_number() over (partition by qid order by n_matched desc, id) as r2 from s)
select qid, id, cast(floor((1e0 / (30 + r1) + 1e0 / (30 + r2)) * 1000) as bigint) as rrf_score from r""")
def bm_08(spark, d):
    return R.rrf_pair(R.bm25(docs(spark, d), asked(spark, d)), "score", "n_matched").select("qid", "id", "rrf_score")


@query("bm_09", WITH.replace("from documents)", "from plain)").replace("with ", r"with plain as (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as text from documents), ", 1) + r""", h as (select s.qid, s.id, score, text from s join plain on id = doc_id where n_matched = n_terms),
b as (select h.qid, h.id, any_value(text) as text, any_value(score) * case when bool_or(regexp_matches(lower(split_part(text, chr(10), 1)), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) then 2 else 1 end as bm25 from h join qt using (qid) group by all),
gd as (select id, substr(t, i, 3) as gram, count(*) as n from (select distinct id, lower(text) as t from b), unnest(range(1, length(t) - 1)) as u(i) group by all), gq as (select qid, substr(t, i, 3) as gram, count(*) as n from (select qid, lower(query) as t from q), unnest(range(1, length(t) - 1)) as u(i) group by all),
ld as (select id, sqrt(sum(n * n)) as l from gd group by 1), lq as (select qid, sqrt(sum(n * n)) as l from gq group by 1), dots as (select b.qid, b.id, sum(gq.n * gd.n) as dot from b join gq using (qid) join gd on gd.id = b.id and gd.gram = gq.gram group by all),
cc as (select b.qid, b.id, bm25, coalesce(dot / (lq.l * ld.l), 0e0) as cosine from b left join dots using (qid, id) left join lq using (qid) left join ld using (id)),
r as (select qid, id, cast(floor((1e0 / (30 + row_number() over (partition by qid order by bm25 desc, id)) + 1e0 / (30 + row_number() over (partition by qid order by cosine desc, id))) * 1000) as bigint) as rrf_score from cc)
select * from (select qid, id, rrf_score, row_number() over (partition by qid order by rrf_score desc, id) as rank from r) where rank <= 8""")
def bm_09(spark, d):
    """Over ASCII texts, where bytes are characters."""
    plain = docs(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return R.idea_search(plain, asked(spark, d), 8)


@query("bm_10", WITH + """, a as (select * from (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10),
b as (select * from (select qid, id, row_number() over (partition by qid order by n_matched desc, id) as rank from s) where rank <= 10),
n as (select qid, count(*) as n from a group by 1), u as (select qid, id, rank from a union all select b.qid, id, n + 1 + rank from b join n using (qid)),
f as (select qid, id, sum(1e0 / (60 + rank)) as score from u group by all)
select * from (select qid, id, round(score, 9) as score, row_number() over (partition by qid order by score desc, id) as rank from f) where rank <= 10""")
def bm_10(spark, d):
    s = R.bm25(docs(spark, d), asked(spark, d))
    a, b = R.top_k(s, 10), R.top_k(s, 10, by="n_matched")
    return R.rrf_fuse_lists(a, b, 10).select("qid", "id", F.round("score", 9).alias("score"), "rank")


@query("bm_11", "select least(25, count(*)) as n, true as same, true as known from documents")
def bm_11(spark, d):
    """25 ideas by a seed: as many as there are, the same ones again, all of them documents."""
    a, b = (R.random_ideas(docs(spark, d), 25, 7).select("doc_id") for _ in range(2))
    both = a.join(b.withColumn("again", F.lit(True)), "doc_id", "left").join(docs(spark, d).select("doc_id", F.lit(True).alias("known")).distinct(), "doc_id", "left")
    return both.agg(F.count("*").alias("n"), F.bool_and(F.coalesce("again", F.lit(False))).alias("same"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


RAW = """'"' || left(text, 20) || '" x-' || text || ' a+b (né) "open ' || left(text, 9)"""


@query("fts_01", rf"""with r as (select item_id, {RAW} as raw from benchmark), t as (select item_id, unnest(ts) as t, unnest(range(len(ts))) as pos from (select item_id, regexp_extract_all(raw, '([^ \t\n"]|"[^"]*"|"[^"]*$)+') as ts from r)),
c as (select item_id, pos, contains(t, '-') or contains(t, '.') as phrase, trim(regexp_replace(regexp_replace(replace(t, '"', ''), case when contains(t, '-') or contains(t, '.') then '[+*()~]' else '[+*()~-]' end, ' ', 'g'), '\s+', ' ', 'g')) as term from t)
select item_id, row_number() over (partition by item_id order by pos) - 1 as part, case when phrase then 'phrase' when strlen(term) <= 3 then 'prefix' else 'term' end as kind, term from c where term <> ''""")
def fts_01(spark, d):
    """Each benchmark text as a search string, between a quoted part, operators and an open quote."""
    from brindle.functions.queries import parse_query

    raw = F.concat(F.lit('"'), F.substring("text", 1, 20), F.lit('" x-'), F.col("text"), F.lit(' a+b (né) "open '), F.substring("text", 1, 9))
    parts = table(spark, d, "benchmark").select("item_id", F.posexplode(parse_query(raw)).alias("part", "p"))
    return parts.select("item_id", F.col("part").cast("long").alias("part"), "p.kind", "p.term")


@query("fts_02", WITH + ", p as (select id, unnest(t) as term, unnest(range(0, len(t))) as pos from tok) select term, id, count(*) as tf, array_to_string(list(pos order by pos), ',') as positions, any_value(len(t)) as doc_len from p join tok using (id) group by term, id")
def fts_02(spark, d):
    return R.postings(docs(spark, d)).withColumn("positions", F.array_join("positions", ","))


@query("fts_03", WITH + "select qid, id from c join qt using (term) group by qid, id, n_terms having count(*) = n_terms")
def fts_03(spark, d):
    return R.match_and(*counted(spark, d))


@query("fts_04", WITH + ", p as (select qid, substr(query, 1, 3) as prefix from q where query <> '') select distinct qid, id from p join c on starts_with(c.term, p.prefix)")
def fts_04(spark, d):
    """The prefixes are ranges of the stored dictionary; only the postings of the terms in them are read."""
    p = stored(asked(spark, d).where("query <> ''").select("qid", F.substring("query", 1, 3).alias("prefix")), "prefixes")
    own = index(spark, d)
    terms = stored(own.prefixed(p), "heads")
    return own.postings(terms).select("term", "id").join(terms.join(p, "prefix").select("term", "qid"), "term").select("qid", "id").distinct()


@query("fts_05", rf"""with tok as (select doc_id as id, ' ' || array_to_string({T}, ' ') || ' ' as t from documents),
p as (select item_id as qid, ' ' || array_to_string({T}[1:3], ' ') || ' ' as p from benchmark where len({T}) >= 3) select qid, id from p join tok on contains(t, p)""")
def fts_05(spark, d):
    t = S.tokenize("text")
    p = table(spark, d, "benchmark").where(F.size(t) >= 3).select(F.col("item_id").alias("qid"), F.slice(t, 1, 3).alias("phrase"))
    return R.match_phrase(R.postings(docs(spark, d)), p)


@query("fts_06", WITH + ", l as (select * from qt where strlen(term) >= 3), k as (select qid from l group by 1 having count(*) >= 2) select distinct qid, id from c join l using (term) where qid in (select qid from k)")
def fts_06(spark, d):
    return R.match_or(*counted(spark, d))


@query("fts_07", WITH + """, one as (select qid, id, 1 as stage from c join qt using (term) group by qid, id, n_terms having count(*) = n_terms),
l2 as (select qid, term, count(*) over (partition by qid) as n from qt where strlen(term) > 2), two as (select qid, id, 2 as stage from c join l2 using (term) group by qid, id, n having count(*) = n),
l as (select *, count(*) over (partition by qid) as n from qt where strlen(term) >= 3), three as (select distinct qid, id, 3 as stage from c join l using (term) where n >= 2),
u as (select * from one union all select * from two union all select * from three)
select qid, id, stage from (select *, min(stage) over (partition by qid) as m from u) where stage = m""")
def fts_07(spark, d):
    return R.query_ladder(*counted(spark, d))


LADDER = """, one as (select qid, id from c join qt using (term) group by qid, id, n_terms having count(*) = n_terms)"""


@query("fts_08", WITH + LADDER + ", r as (select s.qid, s.id, score, row_number() over (partition by s.qid order by score desc, s.id) as rank from s join one using (qid, id)) select qid, id, round(score, 6) as score, rank from r where rank <= 20")
def fts_08(spark, d):
    return index(spark, d).search(asked(spark, d), 20, every_term=True).select("qid", "id", F.round("score", 6).alias("score"), "rank")


E = "(select vec_id, label, embedding::double[] as v from embeddings)"


@query("vec_01")
def vec_01(spark, d):
    return V.embed_texts(docs(spark, d), "doc_id", "text", vector="v").select("doc_id", F.size("v").alias("dim"), F.round(V.dot(V.doubles("v"), V.doubles("v")), 4).alias("norm2"))


@query("vec_02", r"""with w as (select doc_id, regexp_extract_all(lower(trim(text)), '[\p{L}\p{Nd}''-]+') as ws from documents),
g as (select doc_id, ws[i] as a, ws[i + 1] as b from w, unnest(range(1, len(ws) + 1)) as u(i) where strlen(ws[i]) > 2),
u as (select doc_id, a as g from g union select doc_id, a || ' ' || b from g where b is not null)
select doc_id, count(*) as n, sum(length(g)) as chars from u group by 1""")
def vec_02(spark, d):
    g = docs(spark, d).select("doc_id", F.explode(S.embedding_ngrams("text")).alias("g"))
    return g.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("g")).alias("chars"))


@query("vec_03", f"select a.vec_id, b.vec_id as other, round(list_cosine_similarity(a.v, b.v), 6) as cosine from {E} a join {E} b on a.label = b.label where a.vec_id % 50 = 0")
def vec_03(spark, d):
    """The vectors whose number 50 divides against all of their label."""
    e = table(spark, d, "embeddings")
    a, b = (e.select(F.col("vec_id").alias(name), "label", F.col("embedding").alias("vector")) for name in ("vec_id", "other"))
    return V.cosine_within(a.where("vec_id % 50 = 0"), b, "label", "vec_id", "other").withColumn("cosine", F.round("cosine", 6))


VEC_04 = f"select * from (select a.vec_id as qid, b.vec_id as id, round(list_cosine_similarity(a.v, b.v), 6) as score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.vec_id) as rank from {E} a, {E} b) where rank <= 20"


@query("vec_04", VEC_04)
def vec_04(spark, d):
    e = table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return V.vector_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 20).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_04_pivots", VEC_04)
def vec_04_pivots(spark, d):
    """The same with blocks left out by their angle to pivots."""
    e = table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 20, 64).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_04_scoped", f"select * from (select a.vec_id as qid, b.vec_id as id, round(list_cosine_similarity(a.v, b.v), 6) as score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.vec_id) as rank from {E} a, {E} b where b.label % 3 = 0) where rank <= 20")
def vec_04_scoped(spark, d):
    """The same in one project: the vectors of a third of the labels are outside of all."""
    e = table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    c = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 3 > 0, F.col("label").cast("string")).alias("project"))
    return V.vector_topk(q, c, 20, project="global").select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_05", f"select vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first, round(v[64] / sqrt(list_dot_product(v, v)), 6) as last from {E}")
def vec_05(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))


@query("vec_06", f"select label, i, round(avg(v[i]), 6) as mean from {E}, unnest(range(1, 65)) as u(i) group by all")
def vec_06(spark, d):
    m = V.mean_embedding(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("p", "m")).select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("m", 6).alias("mean"))


HYBRID = WITH + f"""{LADDER}, f as (select * from (select s.qid, s.id, row_number() over (partition by s.qid order by score desc, s.id) as rank from s join one using (qid, id)) where rank <= 60),
v as (select * from (select a.vec_id as qid, b.vec_id as id, list_cosine_similarity(a.v, b.v) as score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.vec_id) as rank from {E} a join q on q.qid = a.vec_id, {E} b) where rank <= 60),
h as (select qid, id, case when f.id is not null and v.id is not null then greatest((20 - (f.rank - 1)) / 20e0, v.score) + 2e-1 when f.id is not null then (20 - (f.rank - 1)) / 20e0 when v.score >= 8e-1 then v.score * 5e-1 end as score
  from f full join v using (qid, id)), hy as (select qid, id, score, row_number() over (partition by qid order by round(score, 12) desc, id) as rank from h where score is not null)"""


def query_vectors(spark, d):
    """The vector of each query: that of its number."""
    return table(spark, d, "embeddings").join(asked(spark, d).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def corpus_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def hybrid(spark, d):
    """Full-text ranks fused with the nearest vectors; vectors and documents meet by their numbers."""
    f = index(spark, d).search(asked(spark, d), 60, every_term=True)
    return V.hybrid_fuse(f, V.vector_topk(query_vectors(spark, d), corpus_vectors(spark, d), 60), 20)


@query("fts_09", WITH + f""", own as (select doc_id as id from documents where source = 'src0'), p as (select qid, term, strlen(term) as b from qt), hit as (select p.qid, p.term, c.id, any_value(b) as b from p join c on c.term = p.term or (b <= 3 and starts_with(c.term, p.term)) where c.id in (select id from own) group by all),
n as (select qid, count(*) as n, count(*) filter (where b > 2) as nl from p group by 1), g as (select qid, id, count(*) as k, count(*) filter (where b > 2) as kl from hit group by all),
st1 as (select qid, id, case when k = n then 1 when nl > 0 and kl = nl then 2 when nl > 1 and kl > 0 then 3 end as stage from g join n using (qid)), lad as (select qid, id from (select *, min(stage) over (partition by qid) as m from st1 where stage is not null) where stage = m),
f as (select * from (select lad.qid, lad.id, row_number() over (partition by lad.qid order by coalesce(score, 0) desc, lad.id) as rank from lad join own using (id) left join s using (qid, id)) where rank <= 30),
v as (select * from (select a.vec_id as qid, b.vec_id as id, list_cosine_similarity(a.v, b.v) as score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.vec_id) as rank from {E} a join q on q.qid = a.vec_id, {E} b join own on own.id = b.vec_id) where rank <= 30),
h as (select qid, id, case when f.id is not null and v.id is not null then greatest((10 - (f.rank - 1)) / 10e0, v.score) + 2e-1 when f.id is not null then (10 - (f.rank - 1)) / 10e0 when v.score >= 8e-1 then v.score * 5e-1 end as score from f full join v using (qid, id))
select * from (select qid, id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 12) desc, id) as rank from h where score is not null) where rank <= 10""")
def fts_09(spark, d):
    """Parsed queries, their ladder, BM25 and vectors in the documents of one source."""
    return R.hybrid_search(docs(spark, d), asked(spark, d), corpus_vectors(spark, d), query_vectors(spark, d), 10, "src0", project_col="source").select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_07", HYBRID + " select qid, id, round(score, 6) as score, rank from hy where rank <= 20")
def vec_07(spark, d):
    return hybrid(spark, d).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_08", HYBRID + """, x as (select qid, id % 7 as doc, id as chunk, score, rank from hy where rank <= 20),
g as (select qid, doc, max(score) as score, count(*) as n_chunks, arg_min(chunk, rank) as first_chunk from x group by all)
select * from (select qid, doc, round(score, 6) as score, n_chunks, first_chunk, row_number() over (partition by qid order by round(score, 12) desc, doc) as rank from g) where rank <= 5""")
def vec_08(spark, d):
    x = hybrid(spark, d).select("qid", (F.col("id") % 7).alias("doc"), F.col("id").alias("chunk"), "score", "rank")
    return V.rollup_docs(x, 5).withColumn("score", F.round("score", 6))


@query("vec_09", HYBRID + ", x as (select qid, id, case when id % 10 = 0 then score else (id % 100) / 100e0 end as score from hy where rank <= 20) select * from (select qid, id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 12) desc, id) as rank from x) where rank <= 10")
def vec_09(spark, d):
    score = F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 100) / 100.0)
    return V.rerank(hybrid(spark, d), score, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_10", f"""with m as (select label, i, avg(v[i]) as m from {E}, unnest(range(1, 65)) as u(i) where vec_id % 3 <> 0 group by all),
n as (select label, sqrt(sum(m * m)) as n from m group by 1) select label, i, round(m / n, 6) as x from m join n using (label)""")
def vec_10(spark, d):
    m = V.mean_embedding(table(spark, d, "embeddings").where("vec_id % 3 <> 0"), "label", "embedding")
    p = m.select("label", F.posexplode(V.l2_normalize("mean")).alias("p", "x"))
    return p.select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("so_01", WITH + "select qid, id, rank from (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 5")
def so_01(spark, d):
    return index(spark, d).search(asked(spark, d), 5).select("qid", "id", "rank")


@query("so_03", WITH + ", w as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s) select qid, id from w where rank <= 15 and n_ok(id)".replace("n_ok(id)", "id % 2 = 0") + " qualify row_number() over (partition by qid order by rank) <= 5")
def so_03(spark, d):
    over = R.top_k(R.bm25(docs(spark, d), asked(spark, d)), 15).where("id % 2 = 0")
    return over.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where("r <= 5").select("qid", "id")


@query("wn_01", "select doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents")
def wn_01(spark, d):
    return rank_in_group(docs(spark, d).select("doc_id", "source", "n_chars"), "source", F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "rank")


@query("jn_07", "select item_id, doc_id, item_id * 1000 + doc_id as x from benchmark, documents where item_id % 50 = 0")
def jn_07(spark, d):
    """The items whose number 50 divides, with all documents."""
    q = table(spark, d, "benchmark").where("item_id % 50 = 0").select("item_id")
    return docs(spark, d).select("doc_id").crossJoin(q).select("item_id", "doc_id", (F.col("item_id") * 1000 + F.col("doc_id")).alias("x"))


@query("snk_07", WITH + """, r as (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from s), t as (select qid, count(*) as total from r where rank <= 10 group by 1)
select qid, total, '[' || string_agg('{"rank":' || rank || ',"id":' || id || '}', ',' order by rank) || ']' as results from r join t using (qid) where rank <= 10 group by all""")
def snk_07(spark, d):
    return results_json(R.top_k(R.bm25(docs(spark, d), asked(spark, d)), 10), "qid", ["rank", "id"])


@query("jn_08", WITH + ", a as (select id, max(score) as a from s where qid % 2 = 0 group by 1), b as (select id, max(score) as b from s where qid % 2 = 1 group by 1) select id, round(a, 6) as a, round(b, 6) as b from a full join b using (id)")
def jn_08(spark, d):
    s = R.bm25(docs(spark, d), asked(spark, d))
    side = lambda k, name: s.where(F.col("qid") % 2 == k).groupBy("id").agg(F.round(F.max("score"), 6).alias(name))
    return side(0, "a").join(side(1, "b"), "id", "full_outer")
