"""Filters, joins, aggregates, scalar functions, hygiene, provenance and series over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import scalars as S
from brindle.operators import chunking, hygiene, provenance, relational, series
from brindle.plans.registry import query, table
from brindle.session import scratch
from brindle.sources import versioned
from brindle.sources.loaders import page_title


def docs(spark, d):
    return table(spark, d, "documents")


LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents)"


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("n"), "line")


@query("flt_01", "select doc_id from documents where source = 'src3'")
def flt_01(spark, d):
    return relational.scope(docs(spark, d), "src3", "source").select("doc_id")


@query("flt_02", "select doc_id, lang, n_chars from documents where doc_id = 42")
def flt_02(spark, d):
    return docs(spark, d).where("doc_id = 42").select("doc_id", "lang", "n_chars")


@query("flt_03", """with k as (select sha256(text) as k from documents group by 1), p as (select distinct substr(k, 1, 2) as prefix from k union select substr(k, 1, 8) from k union select 'zz'),
m as (select prefix, count(k) as n, min(k) as f from p left join k on starts_with(k, prefix) group by 1)
select prefix, case when n = 0 then 'none' when n = 1 then 'one' else 'ambiguous' end as status, case when n = 1 then f end as found from m""")
def flt_03(spark, d):
    k = docs(spark, d).select(S.checksum("text").alias("k")).distinct()
    p = k.select(F.explode(F.array(F.substring("k", 1, 2), F.substring("k", 1, 8), F.lit("zz"))).alias("prefix")).distinct()
    return relational.find_by_prefix(k, p, "k")


@query("flt_04", "select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') as hit from documents")
def flt_04(spark, d):
    return docs(spark, d).select("doc_id", S.contains_word("text", F.lit("The")).alias("hit"))


@query("flt_07", f"with {LINES}, h as (select * from lines where regexp_matches(line, 'tion ') order by doc_id, n limit 50), w as (select doc_id, u.i as n, bool_or(u.i = h.n) as is_match from h, unnest(range(h.n - 1, h.n + 2)) as u(i) group by all) select doc_id, cast(n as integer) as line_no, line, is_match from lines join w using (doc_id, n)")
def flt_07(spark, d):
    return relational.grep(docs(spark, d), "tion ", context=1, limit=50)


@query("flt_09", "select event_id, event_type from events where event_type like '%c%' and event_type not like 'p%'")
def flt_09(spark, d):
    return relational.glob_allow_deny(table(spark, d, "events"), "event_type", ["*c*"], ["p*"]).select("event_id", "event_type")


@query("flt_10", "select event_id, value from events where value >= 50")
def flt_10(spark, d):
    return table(spark, d, "events").where("value >= 50").select("event_id", "value")


#: Links of other kinds than the given pages have, before the page's own: relative ones, single and no quotes, blanks, fragments, scripts, mail, another port, an entity.
MORE_LINKS = "<a href='/one'>1</a> <a class=x href=two>2</a> <a href='  ?q=1 '>3</a> <a href='#top'>4</a> <a href=''>5</a> <a href='javascript:go()'>6</a> <a href='mailto:a@b.c'>7</a> <a href='//other.example:81/z'>8</a> <a data-href='/no' href='/a?b&amp;c'>9</a> <a href='/one'>1</a>"
LINKS = rf"""p as (select page_id, url, regexp_extract(url, '^([a-z]+:)', 1) as scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as site, regexp_extract(url, '^[^?#]*') as bare, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1) as hs from pages),
own as (select *, regexp_replace(bare, '[^/]*$', '') as folder from p),
l as (select page_id, url, unnest([site || '/one', folder || 'two', bare || '?q=1', 'mailto:a@b.c', scheme || '//other.example:81/z', site || '/a?b&c']) as link, unnest(range(-6, 0)) as pos from own
  union all select page_id, url, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when starts_with(href, '//') then scheme || href when starts_with(href, '/') then site || href else '?' end, pos
  from (select *, unnest(hs) as href, unnest(range(len(hs))) as pos from own) where href <> '' and href not like '#%' and href not like 'javascript:%'),
k as (select page_id, url, link, min(pos) as pos from l group by all)"""


def linked(spark, d):
    return table(spark, d, "pages").withColumn("html", F.concat(F.lit(MORE_LINKS), "html"))


@query("src_08", f"with {LINKS} select page_id, row_number() over (partition by page_id order by pos) as n, link from k")
def src_08(spark, d):
    """The links of each page in order, each once."""
    from brindle.sources.loaders import extract_links

    own = W.partitionBy("page_id").orderBy("pos")
    return extract_links(linked(spark, d)).select("page_id", F.row_number().over(own).alias("n"), "link")


@query("flt_11", rf"with {LINKS} select page_id, link from k where regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) and not contains(link, 'mailto:') qualify row_number() over (partition by page_id order by pos) <= 5")
def flt_11(spark, d):
    from brindle.sources.loaders import extract_links, link_filter

    return link_filter(extract_links(linked(spark, d)), 5).select("page_id", "link")


@query("flt_12", "select doc_id, lang from documents where lang in ('en', 'zh') and trim(text) <> ''")
def flt_12(spark, d):
    return docs(spark, d).withColumn("lang", F.coalesce("lang", F.lit("en"))).where(F.col("lang").isin("en", "zh") & (F.trim("text") != "")).select("doc_id", "lang")


@query("flt_13", "select page_id, not contains(html, chr(0)) as is_text, starts_with(ltrim(html), '<') as is_html, page_id % 6 between 1 and 4 as image from pages")
def flt_13(spark, d):
    b = F.encode("html", "UTF-8")
    starts = ("", "89504E47", "FFD8FF", "47494638", "524946460000000057454250", "5249464600000000574542")
    magic = F.unhex(F.element_at(F.array(*map(F.lit, starts)), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", (F.locate("\0", F.decode(b, "ISO-8859-1")) == 0).alias("is_text"), F.ltrim(F.decode(F.substring(b, 1, 512), "ISO-8859-1")).startswith("<").alias("is_html"), S.is_likely_image(F.concat(magic, b)).alias("image"))


@query("flt_14", "select p_partkey, p_type from part where p_type = (select min(p_type) from part)")
def flt_14(spark, d):
    p = table(spark, d, "part")
    return p.join(F.broadcast(p.agg(F.min("p_type").alias("p_type"))), "p_type").select("p_partkey", "p_type")


@query("flt_15", f"with {LINES}, x as (select doc_id, n, regexp_replace(line, '[ 极]', '', 'g') as t from lines) select doc_id, n, length(t) > 0 and length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) > 0 as english from x")
def flt_15(spark, d):
    return lines(spark, d).select("doc_id", "n", S.is_english_line("line").alias("english"))


@query("flt_16", r"select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) in ('localhost', '127.0.0.1', '::1') as local from pages")
def flt_16(spark, d):
    return table(spark, d, "pages").select("page_id", F.btrim(S.hostname("url"), F.lit("[]")).isin(*S.LOCAL_HOSTS).alias("local"))


@query("jn_01", "select c_custkey, n_name, o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 100000")
def jn_01(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("c_custkey", "n_name", "o_orderkey")


@query("jn_02", "select vec_id, d.doc_id, l.toxic from embeddings e join documents d on e.vec_id = d.doc_id join labels l on l.doc_id = d.doc_id")
def jn_02(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id"))
    return e.join(docs(spark, d).select("doc_id"), "doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").select("vec_id", "doc_id", "toxic")


@query("jn_03", "select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)")
def jn_03(spark, d):
    x = docs(spark, d).select("doc_id", S.checksum("text").alias("checksum"))
    return relational.skip_known(x, x.where("doc_id % 2 = 0"), "checksum").select("doc_id")


@query("jn_04", "select doc_id from documents where doc_id in (select doc_id from labels where quality = 1)")
def jn_04(spark, d):
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("jn_05", "with x as (select p_partkey, case when p_partkey % 2 = 0 then 'ab' || lpad(p_size::varchar, 20, '0') || 'zz' else p_size::varchar end as code from part), t as (select lpad(i::varchar, 20, '0') as e, 'p' || i as provider from range(0, 25) as r(i) union all select i::varchar, 'q' || i from range(25, 60) as r(i)) select p_partkey, coalesce(t1.provider, t2.provider) as provider from x left join t t1 on length(code) >= 22 and substr(code, 3, 20) = t1.e left join t t2 on code = t2.e")
def jn_05(spark, d):
    size = F.col("p_size").cast("string")
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ab"), F.lpad(size, 20, "0"), F.lit("zz"))).otherwise(size).alias("code"))
    i = F.col("id").cast("string")
    t = spark.range(25).select(F.lpad(i, 20, "0").alias("entity"), F.concat(F.lit("p"), i).alias("provider")).union(spark.range(25, 60).select(i, F.concat(F.lit("q"), i)))
    return relational.entity_provider(x, t).select("p_partkey", "provider")


@query("jn_06", r"with r as (select 1 as n, 'com' as dom, 'commercial' as p union all select 2, 'org', 'organisation' union all select 3, 'example.org', 'sample'), h as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as h from pages), m as (select page_id, any_value(url) as url, arg_min(p, n) as p from h left join r on h = dom or ends_with(h, '.' || dom) group by 1) select page_id, case when p = 'organisation' and (ends_with(url, '=x') or ends_with(url, '=x/')) then 'compatible' else coalesce(p, 'any') end as provider from m")
def jn_06(spark, d):
    r = spark.createDataFrame([(1, "com", "commercial", None, None), (2, "org", "organisation", "=x", "compatible"), (3, "example.org", "sample", None, None)], "rule_no int, domain string, provider string, suffix string, suffix_provider string")
    return relational.provider_of_host(table(spark, d, "pages"), r, default="any").select("page_id", "provider")


@query("jn_09", "select page_id from pages where url not in (select url from pages where page_id % 5 = 0 or page_id % 7 = 0)")
def jn_09(spark, d):
    """Statuses of pages: missing, unreachable or fine."""
    k = F.col("page_id")
    p = table(spark, d, "pages")
    return relational.without_dead_urls(p, p.select("url", F.when(k % 5 == 0, 404).when(k % 7 == 0, None).otherwise(200 + k % 2 * 101).alias("status"))).select("page_id")


WORDS = r"regexp_extract_all(lower(text), '[a-z]+')"


DELETIONS = "unnest(list_distinct(list_append(list_transform(range(1, length({0}) + 1), lambda i: left({0}, i - 1) || substr({0}, i + 1)), {0})))"


@query("jn_10", f"with w as (select distinct word from (select unnest({WORDS}) as word from documents) where length(word) >= 4), t as (select distinct term from (select unnest({WORDS}) as term from benchmark)), a as (select word, {DELETIONS.format('word')} as k from w), b as (select term, {DELETIONS.format('term')} as k from t), m as (select distinct word, term, levenshtein(word, term) as x from a join b using (k)) select word, arg_min(term, (x, term)) as suggestion from m where x <= 1 group by word")
def jn_10(spark, d):
    w = docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    t = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return relational.within_one_edit(w, t)


@query("ag_01", "select count(*) as n from documents")
def ag_01(spark, d):
    return docs(spark, d).agg(F.count("*").alias("n"))


@query("ag_02", "select sha256(text) as checksum, count(*) as n, min(doc_id) as keeper from documents group by 1 having count(*) > 1")
def ag_02(spark, d):
    return relational.duplicate_groups(docs(spark, d), "doc_id", S.checksum("text"))


@query("ag_03", "with s as (select s_suppkey, coalesce(nullif(case when s_suppkey % 7 = 0 then '' when s_suppkey % 7 = 1 then null else s_name end, ''), 'Other') as vendor from supplier) select vendor, count(*) over (partition by vendor) as n, s_suppkey as model from s")
def ag_03(spark, d):
    s = table(spark, d, "supplier").withColumn("v", F.when(F.col("s_suppkey") % 7 == 0, "").when(F.col("s_suppkey") % 7 > 1, F.col("s_name")))
    return relational.catalog_by_vendor(s, "v", "s_suppkey")


@query("ag_04", "select p_brand as size, arg_min(p_type, (p_retailprice, p_type)) as quality, min(p_retailprice) as price from part group by 1")
def ag_04(spark, d):
    return relational.cheapest_variant(table(spark, d, "part"), "p_brand", "p_type", "p_retailprice")


@query("ag_05", "select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as mean from lineitem group by 1")
def ag_05(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(relational.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("mean"))


@query("ag_06", """with u as (select 'm' || conv_id % 3 as model, role = 'assistant' as made, cast(ceil(length(text) / 4e0) as bigint) as n from conversations)
select model, cast(coalesce(sum(n) filter (where not made), 0) as bigint) as prompt_tokens, cast(coalesce(sum(n) filter (where made), 0) as bigint) as completion_tokens, cast(coalesce(sum(n), 0) as bigint) as total_tokens, round(coalesce(sum(n) filter (where made), 0) * 2e-6, 6) as cost from u group by 1""")
def ag_06(spark, d):
    n, made = S.count_tokens("text").cast("long"), F.col("role") == "assistant"
    u = table(spark, d, "conversations").select(F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.when(~made, n).alias("prompt_tokens"), F.when(made, n).alias("completion_tokens"), F.when(made, n * 2e-6).alias("cost"))
    return relational.usage_totals(u).withColumn("cost", F.round("cost", 6))


@query("ag_07", "select c_nationkey, round(sum(c_acctbal), 2) as remain, bool_or(c_acctbal > 9900) as unlimited from customer group by 1")
def ag_07(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("remain"), F.bool_or(F.col("c_acctbal") > 9900).alias("unlimited"))


@query("ag_08", "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(kurtosis_pop(value), 6) as kurt from events group by 1")
def ag_08(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.kurtosis("value"), 6).alias("kurt"))


AG_09 = """with placed as (select {key}, v, row_number() over (partition by {key} order by v) as up, row_number() over (partition by {key} order by v desc) as down, count(*) over (partition by {key}) as n from {rows}),
r as (select {key}, min(v) filter (where up > floor(n * 2 / 100)) as lo, max(v) filter (where down > floor(n * (100 - 98) / 100)) as hi from placed group by {key})"""


@query("ag_09", "with g as (select event_type || event_id % 7 as event_type, cast(floor(value) as bigint) % 256 as v from events union all select 'whole', event_id % 50 from events where event_id < 100), " + AG_09.format(key="event_type", rows="g").removeprefix("with ") + " select event_type, lo, hi from r")
def ag_09(spark, d):
    """Groups of many sizes, and one (0 to 49, twice) of which 2 per cent are whole rows."""
    e = table(spark, d, "events")
    g = e.select(F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("event_type"), (F.floor("value").cast("long") % 256).alias("v"))
    return relational.percentile_range(g.union(e.where("event_id < 100").select(F.lit("whole"), F.col("event_id") % 50)), "event_type", "v")


@query("ag_10", r"select conv_id, bool_and(length(regexp_replace(coalesce(text, ''), '[\s\p{P}\p{Nd}]', '', 'g')) < 50) as is_scanned from conversations group by 1")
def ag_10(spark, d):
    return relational.is_scanned(table(spark, d, "conversations"), "conv_id", "text")


@query("ag_11", """with e as (select vec_id, embedding::double[] as v from embeddings), s as (select vec_id, cast(floor(sqrt((x - 9) * (x - 9) + (y - 9) * (y - 9))) as integer) as r, ln(v[x] * v[y] * v[x] * v[y] * 1e9 + 1e-10) as p from e, unnest(range(1, 17)) as a(x), unnest(range(1, 17)) as b(y)),
m as (select vec_id, r, avg(p) as p from s where r < 8 group by all), f as (select vec_id, sum(p) as total, coalesce(sum(p) filter (where r >= 5), 0) as hf, list({'a': ln(r::double), 'b': ln(p)}) filter (where r >= 3 and p > 0) as l from m group by 1),
g as (select vec_id, hf / (total + 1e-10) as high, len(l) as n, list_sum([z.a for z in l]) as sa, list_sum([z.b for z in l]) as sb, list_sum([z.a * z.b for z in l]) as sab, list_sum([z.a * z.a for z in l]) as saa from f)
select vec_id, round(high, 6) as high, round(case when n > 2 then (n * sab - sa * sb) / (n * saa - sa * sa + 1e-10) else -2e0 end, 6) as slope from g""")
def ag_11(spark, d):
    """A spectrum of 16 x 16 from each vector."""
    at = lambda c: F.element_at("embedding", (F.col(c) + 1).cast("int")).cast("double")
    cells = table(spark, d, "embeddings").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(15))))
    p = relational.radial_profile(cells.select("vec_id", "x", "y", (at("x") * at("y") * at("x") * at("y") * 1e9).alias("power")), "vec_id", 16, 16)
    return p.select("vec_id", F.round("high", 6).alias("high"), F.round("slope", 6).alias("slope"))


@query("ag_12", r"select term, count(distinct doc_id) as df from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) as term from documents) group by 1")
def ag_12(spark, d):
    return docs(spark, d).select(F.explode(F.array_distinct(S.tokenize("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("ag_13", "select case o_orderstatus when 'F' then 'completed' when 'P' then 'failed' else 'open' end as state, count(*) as n, round(sum(o_totalprice), 2) as cost, round(coalesce(sum(o_totalprice / 4) filter (where o_orderkey % 3 > 0), 0), 2) as credits, cast(sum(o_orderkey % 60) as bigint) as actual_time from orders group by 1")
def ag_13(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "Succeeded").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("in_progress")
    t = table(spark, d, "orders").select(status.alias("status"), F.col("o_totalprice").alias("cost"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 4).alias("credits"), (F.col("o_orderkey") % 60).alias("actual_time"))
    return relational.task_summary(t).withColumns({"cost": F.round("cost", 2), "credits": F.round("credits", 2)})


@query("wn_02", "select event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def wn_02(spark, d):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id")


@query("wn_03", f"with {LINES} select doc_id, n, max(regexp_matches(line, 'the')::int) over (partition by doc_id order by n rows between 2 preceding and 2 following) as near from lines")
def wn_03(spark, d):
    w = W.partitionBy("doc_id").orderBy("n").rowsBetween(-2, 2)
    return lines(spark, d).select("doc_id", "n", F.max(F.col("line").rlike("the").cast("int")).over(w).alias("near"))


@query("wn_04", f"with {LINES} select doc_id, n, cast(sum(contains(line, 'the')::int) over (partition by doc_id order by n) as bigint) as section from lines")
def wn_04(spark, d):
    return lines(spark, d).select("doc_id", "n", F.sum(F.col("line").contains("the").cast("int")).over(W.partitionBy("doc_id").orderBy("n")).alias("section"))


@query("so_02", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 50 offset 20")
def so_02(spark, d):
    return relational.list_documents(docs(spark, d), "n_chars", "doc_id", 9999, 20).select("doc_id", "n_chars")


@query("so_04", "select doc_id, least(greatest(strlen(text) - 100, 0), 5000) as got, greatest(strlen(text) - 100 - 5000, 0) as remaining from documents")
def so_04(spark, d):
    p = docs(spark, d).select("doc_id", relational.page_text(F.col("text"), 100).alias("p"))
    return p.select("doc_id", F.octet_length("p.page").alias("got"), "p.remaining")


@query("so_05", "with r as (select l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc) as n from lineitem) select l_suppkey, coalesce(max(l_extendedprice) filter (where n = 3), 0) as kth from r group by 1")
def so_05(spark, d):
    return relational.kth_largest(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 3)


@query("st_02", r"""with e as (select doc_id, 'u' || doc_id % 50 as source_url, ['img/' || doc_id % 3 || '.png'] as image_urls, lang, split_part(text, chr(10), 1) as title, text as prompt from documents),
k as (select *, [source_url, doc_id % 3 || '.png', title || '|' || prompt, substr(regexp_replace(regexp_replace(regexp_replace(lower(prompt), '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g'), '[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'), 1, 200)] as key,
  md5('{"image_urls": ' || to_json(image_urls) || ', "lang": ' || to_json(lang) || ', "prompt": ' || to_json(prompt) || ', "source_url": ' || to_json(source_url) || ', "title": ' || to_json(title) || '}') as h from e),
n as (select * from k where doc_id % 3 > 0 and key not in (select key from k where doc_id % 3 = 0) qualify row_number() over (partition by key order by doc_id) = 1)
select doc_id, 0 as origin, row_number() over (order by doc_id) as place from e where doc_id % 3 = 0 union all select doc_id, 1, row_number() over (order by source_url, lang, title, h) from n""")
def st_02(spark, d):
    """A third of the documents as what there is, the others as what comes: those with an unknown key, in the order of a merged file."""
    e = docs(spark, d).select("doc_id", F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("source_url"), F.array(F.concat(F.lit("img/"), (F.col("doc_id") % 3).cast("string"), F.lit(".png"))).alias("image_urls"), "lang", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("prompt"))
    made = hygiene.merge_entries(e.where("doc_id % 3 = 0"), e.where("doc_id % 3 > 0"), "doc_id")
    return made.select("doc_id", "origin", "place")


@query("st_01", r"""with recursive t as (select doc_id, source || '/' || doc_id % 400 as u, split_part(text, chr(10), 1) || '|' || text as c,
  substr(regexp_replace(regexp_replace(regexp_replace(lower(text), '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g'), '[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'), 1, 200) as k from documents),
k as (select doc_id, row_number() over (order by doc_id) as n, list_filter([hash('u:' || u), hash('c:' || c), case when k <> '' then hash('t:' || k) end], lambda x: x is not null) as ks from t),
r(n, seen, kept) as (select 0::bigint, []::ubigint[], null::bigint union all
  select k.n, case when list_has_any(seen, ks) then seen else list_concat(seen, ks) end, case when not list_has_any(seen, ks) then doc_id end from r join k on k.n = r.n + 1)
select kept as pos from r where kept is not null""")
def st_01(spark, d):
    p = docs(spark, d).select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("/"), (F.col("doc_id") % 400).cast("string")).alias("source_url"), F.array().cast("array<string>").alias("image_urls"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("prompt"))
    return hygiene.dedup_keep_first(p, hygiene.entry_keys()).select("pos")


@query("st_03", "select min(doc_id) as doc_id from documents group by sha256(text)")
def st_03(spark, d):
    return hygiene.prune_duplicates(docs(spark, d), "doc_id", S.checksum("text")).select("doc_id")


@query("st_04", "select item_id as id, 'b' as kind from benchmark union all select doc_id, 'd' from documents")
def st_04(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("kind")).unionByName(docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("d").alias("kind")))


SNK_01 = "select doc_id as id, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end as size, doc_id % 100 as created_at, case when doc_id % 3 = 0 then 1000 else doc_id % 100 end as updated_at from documents union all select -doc_id - 1, n_chars, 1000, 1000 from documents where doc_id % 7 = 0"


def updates_of(spark, d):
    """A third of the documents anew, and some that were not there."""
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), (F.col("doc_id") % 100).alias("created_at"), (F.col("doc_id") % 100).alias("updated_at"))
    u = t.where("id % 3 = 0").select("id", (F.col("size") + 1).alias("size")).union(t.where("id % 7 = 0").select(-F.col("id") - 1, "size"))
    now = F.lit(1000).cast("long")
    return t, u.withColumn("created_at", now), now


@query("snk_01", SNK_01)
def snk_01(spark, d):
    return hygiene.upsert_documents(*updates_of(spark, d))


@query("snk_01_stored", SNK_01)
def snk_01_stored(spark, d):
    """The same on a stored table, with a second update of a few rows that changes nothing but their buckets."""
    path = scratch(spark, "store")
    t, u, now = updates_of(spark, d)
    versioned.create(spark, path, {"documents": (t, "id")}, 16)
    versioned.upsert(spark, path, "documents", u, now)
    versioned.upsert(spark, path, "documents", u.where("id % 300 = 0"), now)
    return versioned.read(spark, path, "documents")


SNK_02 = (f"with {LINES}, c as (select 'chunks' as t, doc_id, case when doc_id % 4 = 0 then 1 else n end as n from lines where doc_id % 4 <> 0 or n = 1) select * from c union all select 'embeddings', doc_id, n from c union all select 'postings', doc_id, n from c where doc_id % 8 <> 4")


@query("snk_02", SNK_02)
def snk_02(spark, d):
    """Every fourth document is given one chunk; every other of those is kept out of the index."""
    c = lines(spark, d).select("doc_id", "n")
    new = c.where("doc_id % 4 = 0 and n = 1")
    made = hygiene.replace_chunks({"chunks": c, "embeddings": c, "postings": c}, new, new, new.where("doc_id % 8 = 0"))
    part = lambda k: made[k].select(F.lit(k).alias("t"), "doc_id", "n")
    return part("chunks").union(part("embeddings")).union(part("postings"))


@query("snk_02_stored", SNK_02)
def snk_02_stored(spark, d):
    """The same on three stored tables that change at once, after rows of a document number that is taken out again."""
    path = scratch(spark, "store")
    c = lines(spark, d).select("doc_id", "n")
    more = c.where("doc_id % 100 = 1").select((-F.col("doc_id")).alias("doc_id"), "n")
    versioned.create(spark, path, {k: (c.union(more), "doc_id") for k in ("chunks", "embeddings", "postings")}, 16)
    new = c.where("doc_id % 4 = 0 and n = 1")
    versioned.replace(spark, path, {"chunks": new, "embeddings": new, "postings": new.where("doc_id % 8 = 0")})
    versioned.delete(spark, path, more.select("doc_id"))
    part = lambda k: versioned.read(spark, path, k).select(F.lit(k).alias("t"), "doc_id", "n")
    return part("chunks").union(part("embeddings")).union(part("postings"))


@query("snk_03", f"with {LINES} select 'documents' as t, count(*) as n from documents where doc_id % 3 <> 0 union all select 'chunks', count(*) from lines where doc_id % 3 <> 0")
def snk_03(spark, d):
    x = docs(spark, d)
    left = hygiene.delete_documents({"documents": x.select("doc_id"), "chunks": lines(spark, d).select("doc_id")}, x.where("doc_id % 3 = 0"))
    one = lambda k: left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("t"), "n")
    return one("documents").union(one("chunks"))


@query("snk_06", "select doc_id, '' as content from documents")
def snk_06(spark, d):
    return hygiene.save_vault(docs(spark, d).select("doc_id", F.col("text").alias("content")))


def pick_text(key, *forms):
    """One of forms by key, with the key put in."""
    return F.replace(pick(key, *forms), F.lit("{}"), F.col(key).cast("string"))


def pick(key, *values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


SC = {
    "sc_01": (r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), ' ')", lambda: F.array_join(S.tokenize("text"), " ")),
    "sc_02": (r"len(regexp_extract_all(lower(trim(text)), '[\p{L}\p{Nd}''-]+'))", lambda: F.size(S.words("text"))),
    "sc_03": ("sha256(text)", lambda: S.checksum("text")),
    "sc_05": (r"substr(regexp_replace(regexp_replace(regexp_replace(lower(chr(160) || ' .' || text || ' m²  - ½' || chr(160) || '!'), '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g'), '[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]', '', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'), 1, 200)", lambda: S.text_key(F.concat(F.lit("\xa0 ."), "text", F.lit(" m²  - ½\xa0!")))),
    "sc_07": ("regexp_replace(source || '/' || coalesce(lang, '') || ' x', '[^A-Za-z0-9._-]', '_', 'g')", lambda: S.project_dir(F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("")), F.lit(" x")))),
    "sc_08": ("case when doc_id % 2 = 0 then 'h.org/' || source || '/r' else 'h.org/o/' || source end", lambda: S.git_project_id(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("git@h.org:"), "source", F.lit("/r.git"))).otherwise(F.concat(F.lit("https://u@h.org/o/"), "source", F.lit(".git"))))),
    "sc_15": (r"len(regexp_extract_all(text, '[^\s\p{P}]+'))", lambda: S.word_count("text")),
    "sc_16": ("cast(ceil(length(text) / 4e0) as bigint)", lambda: S.count_tokens("text").cast("long")),
    "sc_17": ("case when strlen(text) * 997 >= 1048576 then printf('%.2f MB', strlen(text) * 997 / 1048576e0 + 1e-9) when strlen(text) * 997 >= 1024 then printf('%.2f KB', strlen(text) * 997 / 1024e0 + 1e-9) else (strlen(text) * 997)::varchar || ' B' end", lambda: S.human_size(F.octet_length("text") * 997)),
    "sc_23": (r"case when len(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '^[0-9]{1,3}[.,!?%]*$') and contains(x, '%') and try_cast(regexp_extract(x, '^[0-9]+') as int) <= 100)) > 0 then try_cast(regexp_extract(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '^[0-9]{1,3}[.,!?%]*$') and contains(x, '%'))[1], '^[0-9]+') as int) / 100e0 else 5e-1 end", lambda: S.parse_llm_score("text")),
    "sc_24": ("case when doc_id % 100 >= 90 then 4 when doc_id % 100 >= 65 then 3 when doc_id % 100 >= 40 then 2 when doc_id % 100 >= 20 then 1 else 0 end", lambda: S.score_level((F.col("doc_id") % 100) / 100.0)),
    "sc_25": ("[0e0, null, doc_id * 3600e0 + 125e-1, doc_id * 60e0 + 9, doc_id::double, null, null, null][doc_id % 8 + 1]", lambda: S.seconds(pick_text("doc_id", "", "-{}", "{}:00:12.5", "{}:9", "{}", "1:2:3:{}", " {}", "{}::1"))),
    "sc_26": (r"length(regexp_replace(text, '[\s\p{P}\p{Nd}]', '', 'g'))", lambda: S.meaningful_chars("text")),
    "sc_27": (r"trim(regexp_replace(regexp_replace(replace(text, chr(34), ''), '[+\-*()~]', ' ', 'g'), '\s+', ' ', 'g'))", lambda: S.strip_reserved("text")),
    "txt_02": (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'th', '极') || ' x.y z,9 q.) r:s t;; u?v', '极', ' '), ' +', ' ', 'g'), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g'), '([.,])([A-Za-z])', '\1 \2', 'g'), '([:;?!])', '\1 ', 'g')", lambda: S.post_process_line(F.concat(F.replace("text", F.lit("th"), F.lit("极")), F.lit(" x.y z,9 q.) r:s t;; u?v")))),
    "txt_04": ("replace(replace(text, 'tion', 'TION'), 'the', 'THE')", lambda: S.apply_corrections("text", {"the": "THE", "tion": "TION"})),
    "txt_09": ("case when doc_id % 4 = 2 and doc_id % 7 in (2, 3, 4) then '' when doc_id % 4 = 1 or right(text, 1) = '-' and doc_id % 4 = 0 then '' when doc_id % 7 in (3, 4, 5, 6) then '' else ' ' end", lambda: S.word_separator(F.concat("text", pick("doc_id", "", "-", "猫", "。a")), pick("doc_id", "x", "9", "ア", "。", "（", "(", "!"))),
}
for _name, (_sql, _col) in SC.items():
    query(_name, f"select doc_id, {_sql} as x from documents")(lambda spark, d, c=_col: docs(spark, d).select("doc_id", c().alias("x")))


#: First bytes of files, each before a page, and the kind that they tell.
MAGIC = [("", ""), ("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("89504E47", ""), ("474946383761", "gif"), ("474946383961", "gif"), ("4749463830", ""), ("424D", "bmp"), ("524946460000000057454250", "webp"), ("524946460000000057415645", ""), *((f"00000018{b'ftyp'.hex()}{b.encode().hex()}", k) for b, k in (("avif", "avif"), ("avis", "avif"), ("heic", "heic"), ("hevx", "heic"), ("mif1", "heic"), ("msf1", "heic"), ("abcd", "heif"))), ("FF0A", "jxl"), ("0000000C4A584C20", "")]


def pick_url(key, *urls):
    """A page's own URL or one of urls."""
    k = F.col(key) % (len(urls) + 1)
    return F.when(k == 0, F.col("url")).otherwise(F.element_at(F.array(*map(F.lit, urls)), F.greatest(k, F.lit(1)).cast("int")))


PAGE = {
    "src_07": (r"replace(replace(replace(replace(regexp_extract(replace(html, '</title>', ' &lt;&#169; &eacute;&amp;lt;</title>'), '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&#169;', '©'), '&eacute;', 'é'), '&amp;', '&')", lambda: page_title(F.replace("html", F.lit("</title>"), F.lit(" &lt;&#169; &eacute;&amp;lt;</title>")))),
    "sc_09": (r"[regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'Ex.org:81', 'ex.org', '', '', '[::1]:5'][page_id % 6 + 1]", lambda: S.host(pick_url("page_id", "http://Ex.org:81/a", "https://u:p@ex.org?q=@z", "a/b", "mailto:a@b.c", "http://[::1]:5#x"))),
    "sc_11": (r"[regexp_extract(url, '^[a-z]+://[^/?#]*/?([^/?#]*/)*([^/?#;]*)', 2), '', 'b.png', '', 'c', 'e'][page_id % 6 + 1]", lambda: S.url_basename(pick_url("page_id", "http://ex.org", "img/b.png?x=/y#/z", "http://ex.org/d/", "c;v=1", "//h/e"))),
    "sc_13": (f"{[k for _, k in MAGIC]}[page_id % {len(MAGIC)} + 1]", lambda: S.sniff_media(F.concat(F.unhex(pick("page_id", *(m for m, _ in MAGIC))), F.encode("html", "UTF-8")))),
    "sc_19": ("html", lambda: F.decode(S.decode_base64_any(F.rtrim(F.base64(F.encode("html", "UTF-8")), F.lit("="))), "UTF-8")),
}
for _name, (_sql, _col) in PAGE.items():
    query(_name, f"select page_id, {_sql} as x from pages")(lambda spark, d, c=_col: table(spark, d, "pages").select("page_id", c().alias("x")))


@query("sc_14", r"""with t as (select doc_id, regexp_replace(text, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') as t from documents), h as (select *, left(t, list_max(list_filter(range(0, 301), lambda k: strlen(left(t, k)) <= 300))) as h from t),
p as (select *, case when contains(h, chr(10)) then strlen(split_part(h, chr(10), 1)) else -1 end as nl, strlen(regexp_extract(h, '(?s)^(.*)\. ', 1)) as dot from h)
select doc_id, case when strlen(t) <= 300 then t when nl > 50 then split_part(t, chr(10), 1) when dot > 50 then regexp_extract(h, '(?s)^(.*)\. ', 1) || '.' else h || '...' end as x from p""")
def sc_14(spark, d):
    return docs(spark, d).select("doc_id", S.first_paragraph("text").alias("x"))


SLUG = r"regexp_replace(translate(regexp_replace({}, '[^A-Za-z0-9 _-]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ _-]+', '-', 'g')"
TITLE = "case when doc_id % 10 = 9 then 'é' else split_part(text, chr(10), 1) end"


@query("sc_06", f"select doc_id, {SLUG.format("' K' || split_part(text, chr(10), 1) || ' é _x-'")} as x, coalesce(nullif(substr({SLUG.format(TITLE)}, 1, 60), ''), 'untitled') as file from documents")
def sc_06(spark, d):
    """The slug of each title, of any length, and as a file name holds it; a tenth of the titles have nothing that a slug keeps."""
    line = F.substring_index("text", "\n", 1)
    title = F.when(F.col("doc_id") % 10 == 9, "é").otherwise(line)
    return docs(spark, d).select("doc_id", S.slugify(F.concat(F.lit(" K"), line, F.lit(" é _x-"))).alias("x"), S.file_slug(title).alias("file"))


@query("sc_28", r"with w as (select regexp_extract_all(lower(text), '[\p{L}]+') as w from documents), p as (select distinct w[i] as a, w[i + 1] as b from w, unnest(range(1, len(w))) as u(i)) select a, b, levenshtein(a, b) as x from p")
def sc_28(spark, d):
    """Each word of the whole texts and the next one."""
    w = docs(spark, d).select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("w"))
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p")).select("p.a", "p.b").distinct()
    return pairs.select("a", "b", S.levenshtein_bytes("a", "b").alias("x"))


@query("sc_21", "select p_partkey, case when p_partkey % 5 = 4 then '—' else printf('$%.4f', p_retailprice) || case p_partkey % 3 when 0 then '/unit' else '/次' end end as x, (100 - p_size) || '%' as discount from part")
def sc_21(spark, d):
    """Parts without a price, and prices with, without and with an empty unit."""
    price = F.when(F.col("p_partkey") % 5 < 4, F.col("p_retailprice"))
    return table(spark, d, "part").withColumns({"price": price, "unit": pick("p_partkey", "/unit", "", None)}).select("p_partkey", S.format_price("price", "unit").alias("x"), S.format_discount(F.col("p_size") / 100.0).alias("discount"))


@query("txt_05", f"select distinct w from (select unnest({WORDS}) as w from benchmark) where length(w) between 3 and 20")
def txt_05(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.where(F.col("w").rlike("^[a-z]{3,20}$")).distinct()


SIGNALS = "select d.doc_id, l.quality = 1 as camera, case when d.doc_id % 17 = 0 then 'AI Generated' end as src, l.toxic * 8e-1 as model, (n_chars % 100) / 100e0 as llm from documents d left join labels l using (doc_id)"


def fused(spark, d):
    x = docs(spark, d).select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    c = {"camera": F.col("quality") == 1, "c2pa_source": F.when(F.col("doc_id") % 17 == 0, "AI Generated"), "model": F.col("toxic") * 0.8, "llm": (F.col("n_chars") % 100) / 100.0}
    return x.select("doc_id", provenance.fused_signals(c).alias("f"))


@query("med_09", f"""with s as ({SIGNALS}), w as (select doc_id, src, case when camera then 1e-1 * 40 else 55e-2 * 10 end + coalesce(model * 20, 0) + llm * 20 as num, case when camera then 40 else 10 end + case when model is null then 0 else 20 end + 20 as den from s),
r as (select doc_id, case when src is not null then 99e-2 else num / den end as rate from w)
select doc_id, round(rate, 6) as rate, case when rate >= 9e-1 then 4 when rate >= 65e-2 then 3 when rate >= 4e-1 then 2 when rate >= 2e-1 then 1 else 0 end as level from r""")
def med_09(spark, d):
    return fused(spark, d).select("doc_id", F.round("f.rate", 6).alias("rate"), "f.level")


@query("med_10", f"""with s as ({SIGNALS}), w as (select doc_id, src, case when camera then 1e-1 * 40 else 55e-2 * 10 end + coalesce(model * 20, 0) + llm * 20 as num, case when camera then 40 else 10 end + case when model is null then 0 else 20 end + 20 as den, camera, model, llm from s)
select doc_id, case when src is not null then 'C2PA Content Credentials=100%' else case when camera then 'Camera EXIF=10%' else 'No Camera EXIF=55%' end || case when model is null then '' else '; AI Model=' || cast(round(model * 100) as integer) || '%' end || '; LLM Assessment=' || cast(round(llm * 100) as integer) || '%' end as x,
case when src is not null then '🤖 99%  Confirmed AI-generated' else case when num / den >= 9e-1 then '🤖 ' when num / den >= 65e-2 then '🔴 ' when num / den >= 4e-1 then '🟠 ' when num / den >= 2e-1 then '🟡 ' else '🟢 ' end || cast(floor(num / den * 100 + 5e-1) as integer) || '%  ' ||
case when num / den >= 9e-1 then 'Confirmed AI-generated' when num / den >= 65e-2 then 'Likely AI-generated' when num / den >= 4e-1 then 'Possibly AI-generated' when num / den >= 2e-1 then 'Slightly suspicious' else 'Likely human-made' end end as summary from w""")
def med_10(spark, d):
    return fused(spark, d).select("doc_id", provenance.signal_breakdown(F.col("f.signals")).alias("x"), S.level_summary("f.rate").alias("summary"))


@query("med_01", "select page_id, case when page_id % 3 = 0 then 'jumb' when page_id % 3 = 1 then 'C2PA' end as marker from pages")
def med_01(spark, d):
    mark = F.when(F.col("page_id") % 3 == 0, F.lit("C2PA jumb")).when(F.col("page_id") % 3 == 1, F.lit("C2PA")).otherwise(F.lit(""))
    b = F.encode(F.concat(F.lit("x" * 100), mark, "html"), "UTF-8")
    return table(spark, d, "pages").select("page_id", provenance.marker_scan(b)["marker"].alias("marker"))


@query("med_07", "select p_partkey, case when p_partkey % 3 in (0, 1) then true end as likely from part")
def med_07(spark, d):
    k = F.col("p_partkey") % 3
    s = provenance.infer_synthid(F.when(k == 0, "Google LLC"), F.lit(None).cast("string"), F.when(k == 1, "AI Generated"))
    return table(spark, d, "part").select("p_partkey", s["likely"].alias("likely"))


@query("med_08", """with p as (select p_partkey, lpad((p_partkey % 40)::varchar, 20, '0') as code, p_partkey % 3 as k, lpad((p_size % 40)::varchar, 20, '0') as other from part)
select p_partkey, case when k < 2 then 'ab' || code || 'zzzzz' end as producer, case when k < 2 and p_partkey % 40 < 20 then 'p' || p_partkey % 40 when k > 0 and cast(other as integer) < 20 then 'p' || cast(other as integer) end as provider from p""")
def med_08(spark, d):
    """Labels with a producer, with both, and with a propagator alone; flat and escaped, or nested."""
    code = lambda c: F.concat(F.lit("ab"), F.lpad((F.col(c) % 40).cast("string"), 20, "0"), F.lit("zzzzz"))
    k = F.col("p_partkey") % 3
    body = F.to_json(F.struct(F.when(k < 2, code("p_partkey")).alias("ContentProducer"), F.when(k > 0, code("p_size")).alias("ContentPropagator")))
    text = F.when(F.col("p_partkey") % 2 == 0, F.replace(body, F.lit('"'), F.lit("&quot;"))).otherwise(F.concat(F.lit('{"AIGC":'), body, F.lit("}")))
    codes = spark.range(20).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("entity"), F.concat(F.lit("p"), "id").alias("provider"))
    labels = table(spark, d, "part").select("p_partkey", provenance.parse_tc260(text).alias("fields"))
    return provenance.label_provider(labels, "fields", codes).select("p_partkey", F.col("fields")["ContentProducer"].alias("producer"), "provider")


@query("ser_01", "with recursive s as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, value from events), r as (select user_id, n, value as y from s where n = 1 union all select s.user_id, s.n, 45e-2 * r.y + 55e-2 * s.value from r join s on s.user_id = r.user_id and s.n = r.n + 1) select user_id, n, round(y, 6) as blended from r")
def ser_01(spark, d):
    return series.temporal_blend(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").withColumn("blended", F.round("blended", 6))


@query("ser_03", "select event_id, round(greatest(0e0, least(1e0, (value - 10) / 50e0)), 6) as x from events")
def ser_03(spark, d):
    return table(spark, d, "events").select("event_id", F.round(series.range_normalize(F.col("value"), F.lit(10.0), F.lit(60.0)), 6).alias("x"))


def positions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("at"), "value")


@query("ser_04", """with s as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as at, value from events), n as (select user_id, count(*) as n from s group by 1),
t as (select user_id, i, i * 3 / 2e0 as x from n, unnest(range(cast(ceil(n * 2 / 3e0) as bigint))) as u(i))
select t.user_id, i, round(a.value + (coalesce(b.value, a.value) - a.value) * (x - floor(x)), 6) as value from t join s a on a.user_id = t.user_id and a.at = floor(x) left join s b on b.user_id = t.user_id and b.at = floor(x) + 1""")
def ser_04(spark, d):
    return series.resample_linear(positions(spark, d), "user_id", "at", "value", 3, 2).withColumn("value", F.round("value", 6))


@query("ser_05", "with p as (select user_id, max(abs(value)) as peak from events group by 1) select event_id, case when peak = 0 or peak >= 32767 then cast(trunc(value) as bigint) else cast(trunc(value * (9e-1 * 32767) / peak) as bigint) end as scaled from events join p using (user_id)")
def ser_05(spark, d):
    return series.peak_normalize(table(spark, d, "events"), "user_id", "value").select("event_id", "scaled")


@query("chk_01", f"with {LINES} select doc_id, count(*) as n_lines from lines group by 1")
def chk_01(spark, d):
    s = chunking.split_sections(docs(spark, d))
    return s.groupBy("doc_id").agg(F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


@query("chk_04")
def chk_04(spark, d):
    return chunking.chunk(docs(spark, d))


CUT = """case when pp > 0 and 1919 - pp > 1024 then 1919 - pp when pn > 0 and 1920 - pn > 682 then 1920 - pn else 1920 end"""


@query("chk_05", rf"""with recursive b as (select doc_id, regexp_replace(replace(text, '#', '.'), '[^\x00-\x7F]', '?', 'g') || chr(10) as b from documents where text <> ''),
c(doc_id, k, b) as (select doc_id, 0, b from b where length(b) > 2048 union all
  select doc_id, k + 1, substr(b, case when n > 128 then n - 127 else n + 1 end) from (
    select doc_id, k, b, {CUT} as n
    from (select doc_id, k, b, instr(reverse(left(b, 1920)), repeat(chr(10), 2)) as pp, instr(reverse(left(b, 1920)), chr(10)) as pn from c where length(b) > 2048))),
a as (select doc_id, k, b, case when length(b) <= 2048 then length(b) else {CUT} end as n
  from (select doc_id, k, b, instr(reverse(left(b, 1920)), repeat(chr(10), 2)) as pp, instr(reverse(left(b, 1920)), chr(10)) as pn from c)),
x as (select doc_id, k, repeat(chr(10), 2) || left(b, n) as content, lead(n) over (partition by doc_id order by k) + 2 as later, lag(n) over (partition by doc_id order by k) + 2 as before from a),
m as (select doc_id, k, content, coalesce(length(content) + later < 1024, false) as joins, coalesce(before + length(content) < 1024, false) as joined from x)
select m.doc_id, cast(m.k as integer) as chunk_index, '' as heading, m.content || case when m.joins then repeat(chr(10), 2) || y.content else '' end as content from m left join m y on y.doc_id = m.doc_id and y.k = m.k + 1 where not m.joined
union all select doc_id, 0, '', b from b where length(b) <= 2048""")
def chk_05(spark, d):
    """The chunks of every document as they are shown, over texts in ASCII, where bytes are characters, and without headings."""
    plain = docs(spark, d).withColumn("text", F.regexp_replace(F.replace("text", F.lit("#"), F.lit(".")), r"[^\x00-\x7F]", "?"))
    return chunking.chunk(plain).select("doc_id", "chunk_index", "heading", "content")


@query("str_02", "select user_id as task, arg_max(case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'in_progress' end, (ts, event_id)) as status, count(*) as polls from events group by 1")
def str_02(spark, d):
    from brindle.streaming.jobs import latest_state

    return latest_state(polls(table(spark, d, "events")))


def polls(e):
    return e.select(F.col("user_id").alias("task"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("in_progress").alias("status"))


TRACKED = """with s as (select user_id as task, arg_max(case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'in_progress' end, (ts, event_id)) as status, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 as span, count(*) as polls from events group by 1)
select task, status, case when status in ('completed', 'failed') then status when span > 180 then 'timed_out' else 'open' end as state, polls from s"""


@query("str_02_states", TRACKED)
def str_02_states(spark, d):
    from brindle.streaming.jobs import tracked_tasks

    return tracked_tasks(polls(table(spark, d, "events")))


@query("str_02_stream", TRACKED)
def str_02_stream(spark, d):
    """The same from a stream of polls."""
    from brindle.session import scratch
    from brindle.streaming.jobs import tracked_tasks

    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    target = scratch(spark, "tasks")
    # each micro-batch writes the tasks that it changes; of a task's versions the last one counts
    out = tracked_tasks(polls(source)).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{target}/batch={n}"))
    out.option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    one = F.max_by(F.struct("status", "state", "polls"), "batch").alias("x")
    return spark.read.parquet(target).groupBy("task").agg(one).select("task", "x.*")


SAID = "select conv_id, string_agg(text, '' order by turn) as content from conversations where role = 'assistant' group by 1"


def chat_lines(c):
    """A line a turn of the assistant, and the end of each conversation."""
    delta = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))
    return c.where("role = 'assistant'").select(F.col("conv_id").alias("response_id"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), F.to_json(delta)).alias("line"))


@query("str_01", SAID)
def str_01(spark, d):
    from brindle.streaming.jobs import assemble_chat

    return assemble_chat(chat_lines(table(spark, d, "conversations"))).select(F.col("response_id").alias("conv_id"), "content")


@query("str_01_stream", SAID)
def str_01_stream(spark, d):
    """The same from a stream of lines in several micro-batches, with an end for each response."""
    from brindle.session import scratch
    from brindle.streaming.jobs import stream_chat

    lines_path, target = scratch(spark, "lines"), scratch(spark, "said")
    rows = chat_lines(table(spark, d, "conversations"))
    ends = rows.groupBy("response_id").agg((F.max("seq") + 1).alias("seq")).withColumn("line", F.lit("data: [DONE]"))
    for part in (rows.where("seq < 2"), rows.where("seq >= 2").union(ends)):  # a response's end comes last
        part.repartition(4).write.mode("append").parquet(lines_path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(lines_path)
    stream_chat(stream, target, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select(F.col("response_id").cast("long").alias("conv_id"), "content")


@query("str_03", """with recursive l as (select * from (values ('click', 50, 3600), ('purchase', 0, 86400), ('view', 1000, 2592000), ('all', 7, 3600), ('never', 5, null)) as l(provider, total, span)),
e0 as (select event_type as p, ts from events union all select 'all', ts from events union all select 'never', ts from events where event_id % 9 = 0),
u as (select p as provider, epoch_us(ts) // 1000000 as t, coalesce(total, 0) as total, span from e0 left join l on l.provider = p),
w as (select provider, 1 as k, min(t) as start, any_value(span) as span, any_value(total) as total from u group by 1 union all select w.provider, w.k + 1, (select min(u.t) from u where u.provider = w.provider and u.t > w.start + w.span), w.span, w.total from w where w.start is not null),
e as (select provider, max(k) as windows, max(start) as start, any_value(total) as total from w where start is not null group by 1)
select e.provider, (select count(*) from u where u.provider = e.provider and u.t >= e.start) as used, e.start as window_start, e.windows, e.total, e.total <= 0 or (select count(*) from u where u.provider = e.provider and u.t >= e.start) < e.total as can_use from e""")
def str_03(spark, d):
    """Each kind of event as a provider, one with all events by the hour, one whose period is unknown, and others without limits: both never start anew."""
    from brindle.streaming.jobs import quota_ledger

    limits = spark.createDataFrame([("click", 50, "hourly"), ("purchase", 0, "daily"), ("view", 1000, "monthly"), ("all", 7, "hourly"), ("never", 5, "weekly")], "provider string, total long, period string")
    e = table(spark, d, "events")
    uses = e.select(F.col("event_type").alias("provider"), "ts").union(e.select(F.lit("all"), "ts")).union(e.where("event_id % 9 = 0").select(F.lit("never"), "ts"))
    return quota_ledger(uses, limits)
