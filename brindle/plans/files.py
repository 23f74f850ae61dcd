"""Sources, sinks, media, spelling, plug-ins and streams over files and values that Spark makes from the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import extensions
from brindle.functions import scalars as S
from brindle.operators import chunking, provenance, relational, series, spelling, vectors
from brindle.plans.registry import query, table
from brindle.plans.tables import AG_09
from brindle.session import scratch
from brindle.sources import loaders, sinks, versioned
from brindle.streaming import jobs


def docs(spark, d):
    return table(spark, d, "documents")


def ideas_json(spark, d, path, which="true"):
    """documents as files of a JSON array each: a folder a thousand ids, so that no array grows with the table. An entry is a line."""
    entry = F.struct(F.col("source").alias("title"), F.col("text").alias("prompt"), F.array(F.concat(F.lit("img/"), "doc_id")).alias("image_urls"), F.col("doc_id").cast("string").alias("source_url"), "lang")
    rows = docs(spark, d).where(which).select(F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.to_json(entry).alias("entry"))
    # an entry a line, so that no task holds an array; its first and last one have the brackets
    w = W.partitionBy("part").orderBy("doc_id", "entry")
    start, end = F.when(F.lag(F.lit(1)).over(w).isNull(), "[").otherwise(""), F.when(F.lead(F.lit(1)).over(w).isNull(), "]").otherwise(",")
    rows.select("part", F.concat(start, "entry", end).alias("value")).write.partitionBy("part").text(path)


def ideas_csv(spark, d, path):
    author = F.to_json(F.struct(F.col("lang").alias("name")))
    media = F.to_json(F.array(F.concat(F.lit("img/"), "doc_id")))
    rows = docs(spark, d).select(F.col("source").alias("title"), F.col("text").alias("content"), author.alias("author"), F.col("doc_id").cast("string").alias("sourceLink"), media.alias("sourceMedia"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query("src_01", "select source as title, text as prompt, 'img/' || doc_id as image, doc_id::varchar as source_url, lang from documents")
def src_01(spark, d):
    path = scratch(spark, "ideas-json")
    ideas_json(spark, d, path)
    return loaders.load_ideas_json(spark, path).select("title", "prompt", F.col("image_urls")[0].alias("image"), "source_url", "lang")


@query("src_02", "select source as title, text as prompt, 'img/' || doc_id as image, doc_id::varchar as source_url, lang as author, 'en' as lang from documents where trim(text) <> ''")
def src_02(spark, d):
    path = scratch(spark, "ideas-csv")
    ideas_csv(spark, d, path)
    return loaders.load_ideas_csv(spark, path).select("title", "prompt", F.col("image_urls")[0].alias("image"), "source_url", "author", "lang")


@query("src_03", """select n, name, source_url, len from (select 0 as n, 'a.json' as name, doc_id::varchar as source_url, length(text) as len from documents
union all select 1, 'b.csv', doc_id::varchar, length(text) from documents where trim(text) <> '' union all select 4, 'e.json', doc_id::varchar, length(text) from documents where doc_id % 2 = 0
union all select 5, 'f.json', doc_id::varchar, length(text) from documents where trim(text) <> '')""")
def src_03(spark, d):
    """A folder whose third, fourth and seventh sources, a broken array, a table without contents and arrays with more after their end, count for nothing; the sixth is a table under the name of an array."""
    path = scratch(spark, "ideas")
    ideas_json(spark, d, path + "/a.json")
    ideas_csv(spark, d, path + "/b.csv")
    docs(spark, d).select(F.concat(F.lit('[{"title": "'), "doc_id").alias("value")).write.text(path + "/c.json")
    docs(spark, d).select("doc_id").write.option("header", True).csv(path + "/d.csv")
    ideas_json(spark, d, path + "/e.json", "doc_id % 2 = 0")
    ideas_csv(spark, d, path + "/f.json")
    docs(spark, d).select(F.concat(F.lit('[{"prompt": "p"}] '), "doc_id").alias("value")).write.text(path + "/g.json")
    return loaders.scan_sources(spark, path).select("n", "name", "source_url", F.length("prompt").cast("long").alias("len"))


@query("src_04", "select source, 'txt' as ext, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by 1")
def src_04(spark, d):
    path = scratch(spark, "tree")
    docs(spark, d).select("source", "text").write.partitionBy("source").text(path)
    files = loaders.load_tree(spark, path).withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1))
    return files.groupBy("source", "ext").agg(F.sum("length").alias("bytes"))


KINDS = ("txt", "PY", "yml", "json", "xhtml", "mdown", "pdf", "docx", "bin", "log")


@query("src_05", f"""with f as (select doc_id, case when doc_id % 10 = 8 then chr(0) || text else text end as text, {list(KINDS)}[doc_id % 10 + 1] as ext from documents)
select doc_id, case ext when 'pdf' then 'unsupported: pdf' when 'docx' then 'unsupported: docx' when 'bin' then 'unsupported file type: .bin' end as error, case when ext in ('txt', 'mdown', 'log') then text when ext = 'PY' then '```PY' || chr(10) || text || chr(10) || '```' when ext = 'json' then '```json' || chr(10) || text || chr(10) || '```'
when ext = 'yml' then '```yaml' || chr(10) || text || chr(10) || '```' when ext = 'xhtml' then 'Source: d/' || doc_id || repeat(chr(10), 2) || '```html' || chr(10) || text || chr(10) || '```' end as markdown from f""")
def src_05(spark, d):
    ext = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 10 + 1).cast("int"))
    content = F.encode(F.when(ext == "bin", F.concat(F.lit("\0"), "text")).otherwise(F.col("text")), "UTF-8")
    files = docs(spark, d).select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), ext.alias("ext"), content.alias("content"))
    return loaders.load_document(files).select("doc_id", "error", "markdown")


@query("src_06_sizes", "select page_id, case when strlen(html) > 3000 then 'page too large' end as error from pages")
def src_06_sizes(spark, d):
    """With a small limit: what is beyond it carries an error."""
    return loaders.ingest_pages(table(spark, d, "pages"), 3000).select("page_id", "error")


@query("src_06")
def src_06(spark, d):
    return loaders.ingest_pages(table(spark, d, "pages"))


@query("src_09", "select p_partkey::varchar as id, p_name as name, p_type as media_type, case when p_partkey % 4 > 0 then p_brand end as vendor, p_retailprice as price from part")
def src_09(spark, d):
    """A catalog of pages of a thousand, with pages after the one that reaches the total, which are left out."""
    path = scratch(spark, "catalog")
    vendor = F.when(F.col("p_partkey") % 4 > 0, F.struct(F.col("p_brand").alias("name")))
    model = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("media_type"), vendor.alias("vendor"), F.struct(F.col("p_retailprice").alias("price")).alias("pricing"))
    parts = table(spark, d, "part")
    total = parts.agg(F.count("*").alias("total"))
    later = parts.where("p_partkey % 1000 = 1")
    rows = parts.select(F.floor(F.col("p_partkey") / 1000).alias("page"), model.alias("m")).union(later.select(F.col("p_partkey") + 10**9, model))
    pages = rows.groupBy("page").agg(F.collect_list("m").alias("models")).crossJoin(total)
    pages.select("page", F.to_json(F.struct(F.lit(True).alias("success"), F.struct("total", "page", "models").alias("data"))).alias("value")).write.partitionBy("page").text(path)
    return loaders.load_catalog_pages(spark, path).select("id", "name", "media_type", F.col("vendor.name").alias("vendor"), F.col("pricing.price").alias("price"))


SAVED = r"""select coalesce(nullif(regexp_replace(case when doc_id % 10 = 0 then '' else source end, '[^A-Za-z0-9._-]', '_', 'g'), ''), 'global') as project_dir, strftime(date '2024-01-01' + cast(doc_id % 28 as integer), '%Y-%m-%d') || '_' || substr(sha256(text), 1, 12) || '-' ||
coalesce(nullif(substr(regexp_replace(translate(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9 _-]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ _-]+', '-', 'g'), 1, 60), ''), 'untitled') || '.md' as name, text from documents"""


def saved_files(spark, d):
    path = scratch(spark, "docs")
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("timestamp")
    project = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source"))
    sinks.save_doc_files(docs(spark, d).select(S.checksum("text").alias("id"), at.alias("created_at"), project.alias("project"), F.substring_index("text", "\n", 1).alias("title"), "text"), path)
    return sinks.load_doc_files(spark, path)


@query("snk_04", f"select distinct project_dir, name, text from ({SAVED})")
def snk_04(spark, d):
    return saved_files(spark, d).select("project_dir", "name", "text")


@query("snk_05", f"select sha256(text) as id, case when project_dir = 'global' then '' else project_dir end as project, regexp_extract(name, '^[^-]*-(.*)[.]md$', 1) as title, strlen(text) as size, true as whole from (select distinct project_dir, name, text from ({SAVED}))")
def snk_05(spark, d):
    """Each document with whether its chunks are numbered without a gap and have a vector each."""
    t = sinks.reindex(saved_files(spark, d), 16)
    key = ["project", "name"]
    # one shuffle of what the tables have of a document: their rows lie together
    rows = t["documents"].select(*key, F.struct("id", "title", "size").alias("d"))
    for part in (t["chunks"].select(*key, "chunk_id", "chunk_index"), t["embeddings"].select(*key, F.col("chunk_id").alias("embedded"), F.size("vector").alias("dim"))):
        rows = rows.unionByName(part, allowMissingColumns=True)
    own = rows.groupBy(*key).agg(F.first("d", True).alias("d"), F.count("chunk_id").alias("n"), F.size(F.collect_set("chunk_index")).alias("k"), F.max("chunk_index").alias("last"), F.collect_set("chunk_id").alias("ids"), F.collect_set("embedded").alias("embedded"), F.min("dim").alias("dim"))
    each = F.size(F.array_except("ids", "embedded")) == 0
    # an empty document has no chunk, so nothing is missing
    whole = each & (F.coalesce("dim", F.lit(16)) == 16) & (F.col("n") == F.col("k")) & (F.col("n") == F.coalesce("last", F.lit(-1)) + 1)
    return own.where("d is not null").select("d.id", "project", "d.title", "d.size", whole.alias("whole"))


@query("snk_08", "select doc_id as n, '## ' || doc_id || '. ' || source || repeat(chr(10), 2) || '```' || chr(10) || text || chr(10) || '```' || repeat(chr(10), 2) || '![](img/' || doc_id || ')' || repeat(chr(10), 2) || 'a · u' as markdown from documents")
def snk_08(spark, d):
    ideas = docs(spark, d).select(F.col("doc_id").alias("n"), F.col("source").alias("title"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("prompt_zh"), F.array(F.concat(F.lit("img/"), "doc_id")).alias("image_urls"), F.lit("a").alias("author"), F.lit("").alias("license"), F.lit("u").alias("source_url"), "lang")
    return sinks.results_markdown(ideas)


@query("flt_05", r"select doc_id from documents where list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), ['the', 'and'])")
def flt_05(spark, d):
    return docs(spark, d).where(S.and_filter(S.tokenize("text"), F.array(F.lit("the"), F.lit("and")))).select("doc_id")


@query("flt_06", "with x as (select page_id, case when contains(lower(url), 'ref=x') then url when contains('img/a.png' || source, 'ref=x') then 'img' end as hit from (select page_id, split_part(url, '#', 1) as url, '' as source from pages)) select min(page_id) as page_id, hit from x where hit is not null group by hit")
def flt_06(spark, d):
    from brindle.operators.relational import search_by_image

    e = table(spark, d, "pages").select("page_id", F.array(F.lit("img/a.png"), F.substring_index("url", "#", 1)).alias("image_urls"))
    return search_by_image(e, "REF=x", order="page_id").select("page_id", "hit")


@query("flt_08", r"with f as (select regexp_extract(url, '^[^?#]*') as path, case when page_id % 4 = 0 then strlen(html) * 997 when page_id % 4 = 1 then 1024 else strlen(html) end as length from pages), n as (select *, regexp_extract(path, '[^/]*$') as name from f), m as (select path, length from n where regexp_matches(name, '^.*5$') or contains(lower(name), '*5') order by string_split(path, '/'), length limit 100) select path, length, case when length > 1048576 then printf('%.1f MB', length / 1048576e0) when length > 1024 then printf('%.1f KB', length / 1024e0) else length || ' B' end as size from m")
def flt_08(spark, d):
    """The limit is cut to 100."""
    n = F.octet_length("html").cast("long")
    size = F.when(F.col("page_id") % 4 == 0, n * 997).when(F.col("page_id") % 4 == 1, 1024).otherwise(n)
    files = table(spark, d, "pages").select(F.regexp_extract("url", "^[^?#]*", 0).alias("path"), size.alias("length"))
    return loaders.find_files(files, "*5", 1000)


@query("chk_02")
def chk_02(spark, d):
    s = loaders.spread(docs(spark, d).select("doc_id", "text"))
    parts = chunking.split_sections(s).select("doc_id", "section", F.posexplode(chunking.split_large("heading", "content")).alias("piece", "p"))
    return parts.select("doc_id", "section", "piece", F.octet_length("p.content").alias("bytes"))


@query("chk_03")
def chk_03(spark, d):
    pieces = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit("").alias("heading"), x.alias("content")))
    return docs(spark, d).select("doc_id", F.posexplode(chunking.merge_small(pieces)).alias("chunk_index", "p")).select("doc_id", "chunk_index", "p.content")


@query("sc_04", "select doc_id, md5('{\"lang\": \"' || lang || '\", \"n_chars\": ' || n_chars || ', \"source\": \"' || source || '\"}') as x from documents")
def sc_04(spark, d):
    return docs(spark, d).select("doc_id", S.content_hash("source", "lang", "n_chars").alias("x"))


@query("sc_10", r"""with l as (select distinct page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1)) as href from pages) select distinct page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href as link from l where starts_with(href, '/') and not contains(href, '&')""")
def sc_10(spark, d):
    links = loaders.raw_links(table(spark, d, "pages")).where("href like '/%' and href not like '%&%'")
    return links.select("page_id", loaders.resolve(F.col("url"), F.col("href")).alias("link")).distinct()


EXTS = ("md", "markdown", "mdown", "txt", "pdf", "docx", "go", "py", "rs", "ts", "tsx", "js", "jsx", "java", "c", "cpp", "h", "hpp", "rb", "php", "sh", "bash", "swift", "kt", "scala", "json", "yaml", "yml", "html", "htm", "xhtml", "png", "jpg", "jpeg", "jfif", "gif", "webp", "bmp", "wav", "mp3", "flac", "ogg", "opus", "aac", "m4a", "pcm", "PY", "PNG", "rst", "")


@query("sc_12", f"""with e as (select p_partkey, {list(EXTS)}[p_partkey % {len(EXTS)} + 1] as raw from part), l as (select *, lower(raw) as e from e)
select p_partkey, case when e in ('md', 'markdown', 'mdown') then 'markdown' when e = 'txt' then 'text' when e in ('yaml', 'yml') then 'yaml' when e in ('html', 'htm', 'xhtml') then 'html' when e in ('json', 'pdf', 'docx') then e
when e in ('go', 'py', 'rs', 'ts', 'tsx', 'js', 'jsx', 'java', 'c', 'cpp', 'h', 'hpp', 'rb', 'php', 'sh', 'bash', 'swift', 'kt', 'scala') then 'code' else 'unknown' end as kind,
case when raw in ('jpg', 'jpeg', 'jfif') then 'image/jpeg' when raw in ('png', 'gif', 'webp', 'bmp') then 'image/' || raw else '' end as mime, e in ('wav', 'mp3', 'flac', 'ogg', 'opus', 'aac', 'm4a', 'pcm') as audio, e in ('png', 'jpg', 'jpeg', 'jfif', 'gif', 'webp', 'bmp') as image from l""")
def sc_12(spark, d):
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("p_partkey") % len(EXTS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.file_kind(ext).alias("kind"), S.mime_type(ext).alias("mime"), S.is_audio(ext).alias("audio"), S.is_image(ext).alias("image"))


@query("sc_18", r"""with t as (select *, regexp_replace(regexp_replace('  ' || text, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g') as t from documents)
select doc_id, upper(lang[1]) || lang[2:] || ' ' || upper(lang[1]) || ' ' || upper(lang[1]) || source as spaced, case when strlen(t) > 160 then left(t, list_max(list_filter(range(0, 161), lambda k: strlen(left(t, k)) <= 160))) || '…' else t end as short, regexp_matches(text, '[\x01-\x1F]') as control from t""")
def sc_18(spark, d):
    first = F.upper(F.substring("lang", 1, 1))
    return docs(spark, d).select("doc_id", S.camel_to_words(F.concat(first, F.substr("lang", F.lit(2)), first, first, "source")).alias("spaced"), S.truncate_meta(F.concat(F.lit("  "), "text")).alias("short"), S.has_control_chars("text").alias("control"))


@query("sc_20", "select vec_id, embedding::float[] as back, 4 * len(embedding) as bytes from embeddings")
def sc_20(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.vec_to_blob("embedding").alias("blob"))
    return e.select("vec_id", vectors.blob_to_vec("blob").alias("back"), F.octet_length("blob").cast("long").alias("bytes"))


@query("sc_22", "select p_partkey, 'brand=' || array_to_string([p_brand || i for i in range(least(1 + p_partkey % 9, 6))], '|') || case when p_partkey % 9 > 5 then '|...' else '' end || ', hd, size=' || case when p_size % 2 = 0 then '1-' || p_size else '' end as x from part")
def sc_22(spark, d):
    brands = F.transform(F.sequence(F.lit(0), F.col("p_partkey") % 9), lambda i: F.concat("p_brand", i.cast("string")))
    p = lambda kind, values, least, most: F.struct(F.lit(kind).alias("kind"), values.cast("array<string>").alias("values"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    none, even = F.lit(None), F.col("p_size") % 2 == 0
    m = F.create_map(F.lit("size"), p("range", none, F.lit(1), F.when(even, F.col("p_size"))), F.lit("hd"), p("boolean", none, none, none), F.lit("brand"), p("enum", brands, none, none))
    x = S.param_summary(m)
    return table(spark, d, "part").select("p_partkey", F.when(even, x).otherwise(F.concat(x, F.lit("="))).alias("x"))


@query("txt_01", r"""with t as (select doc_id, replace(replace(replace(replace(text, 'e', '猫'), 'th', '（'), 'an', '）'), 'o', '。') as t from documents)
select doc_id, regexp_replace(regexp_replace(t, '([猫）。])([A-Za-z0-9])', '\1 \2', 'g'), '([A-Za-z0-9])([猫（。])', '\1 \2', 'g') as x from t""")
def txt_01(spark, d):
    t = F.col("text")
    for old, new in (("e", "猫"), ("th", "（"), ("an", "）"), ("o", "。")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return docs(spark, d).select("doc_id", S.cjk_latin_spacing(t).alias("x"))


@query("txt_03", """with t as (select doc_id, string_split(translate(text, 'lo', '10') || ['a1', 'b0', ' 1', '00'][doc_id % 4 + 1], '') as s from documents),
x as (select doc_id, s, list_transform(range(1, len(s) + 1), lambda i: case when s[i] in ('0', '1') and i > 1 and regexp_matches(s[i - 1], '^[A-Za-z]$') then
case when i = len(s) then case s[i] when '1' then 'l' else 'o' end when regexp_matches(s[i + 1], '^[A-Za-z]$') then case s[i] when '1' then 'l' else 'O' end else s[i] end else s[i] end) as f from t) select doc_id, array_to_string(f, '') as x from x""")
def txt_03(spark, d):
    end = F.element_at(F.array(*map(F.lit, ("a1", "b0", " 1", "00"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", S.fix_digit_confusion(F.concat(F.translate("text", "lo", "10"), end)).alias("x"))


def letters():
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))


def dictionary(spark, d):
    """Frequent words of the benchmark and the even documents, as a clean dictionary would have them."""
    w = docs(spark, d).where("doc_id % 2 = 0").select("text").unionByName(table(spark, d, "benchmark").select("text")).select(F.explode(letters()).alias("term"))
    return w.where("length(term) >= 2").distinct()


@query("txt_06", """with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z'']+')) as t from (select text from documents where doc_id % 2 = 0 union all select text from benchmark)), d as (select t from t where length(t) >= 2), w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z'']+')) as w from documents),
x as (select w, length(w) as n from w where length(w) > 1 or w in ('a', 'i')),
f as (select w, w as t from x union all select w, left(w, n - 2) from x where ends_with(w, '''s') union all select w, left(w, n - 1) from x where ends_with(w, 's') and n > 3 union all select w, left(w, n - 3) || 'y' from x where ends_with(w, 'ies') and n > 4 union all select w, left(w, n - 2) from x where ends_with(w, 'ed') and n > 4 union all select w, left(w, n - 1) from x where ends_with(w, 'ed') and n > 4
union all select w, left(w, n - 3) from x where ends_with(w, 'ing') and n > 5 union all select w, left(w, n - 3) || 'e' from x where ends_with(w, 'ing') and n > 5 union all select w, left(w, n - 2) from x where ends_with(w, 'er') and n > 4 union all select w, left(w, n - 3) from x where ends_with(w, 'est') and n > 5)
select distinct w as word from f where t in (select t from d)""")
def txt_06(spark, d):
    words = docs(spark, d).select(F.explode(letters()).alias("word"))
    return spelling.known_words(words, dictionary(spark, d))


@query("txt_07")
def txt_07(spark, d):
    misread = docs(spark, d).select("doc_id", F.regexp_replace("text", r"m\b", "rn").alias("text"))
    return spelling.spell_fix(misread, dictionary(spark, d))


@query("txt_08")
def txt_08(spark, d):
    joined = docs(spark, d).select("doc_id", F.regexp_replace("text", r"\b(\w{5,}) (\w{5,})\b", "$1$2").alias("text"))
    return spelling.split_words(joined, dictionary(spark, d))


@query("med_02", r"select p_partkey, case when p_partkey % 2 = 0 then 'by OpenAI API' end as vendor, case when p_partkey % 3 = 0 then 'Adobe Firefly ' || p_size end as software, case when p_partkey % 7 = 0 then '2.0.1' when p_partkey % 7 = 1 then '3.14.15' end as version, case when p_partkey % 5 = 0 then 'trained Algorithmic Media' end as source from part")
def med_02(spark, d):
    k = F.col("p_partkey")
    text = F.concat_ws("\x01", "p_brand", F.lit("2.0"), F.when(k % 2 == 0, "by OpenAI API"), F.when(k % 3 == 0, F.concat(F.lit("Adobe Firefly "), "p_size")), F.when(k % 7 == 0, "2.0.1"), F.when(k % 7 == 1, "3.14.15"), F.lit("4.5 is too long a run"), F.when(k % 5 == 0, "http://example.org/digitalsourcetype/trainedAlgorithmicMedia"), "p_type")
    c = provenance.c2pa_strings(text)
    return table(spark, d, "part").select("p_partkey", *(c[x].alias(x) for x in ("vendor", "software", "version", "source")))


def be32(n):
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def png_chunk(kind, data):
    body = F.concat(F.lit(kind).cast("binary"), data)
    return F.concat(be32(F.octet_length(data)), body, be32(F.crc32(body)))


def png(text):
    """A PNG of a header, a text chunk with text as comment and an end."""
    words = F.concat(F.lit("Comment").cast("binary"), F.unhex(F.lit("0000000000")), F.encode(text, "UTF-8"))
    return F.concat(F.unhex(F.lit("89504E470D0A1A0A")), png_chunk("iTXt", words), png_chunk("IEND", F.unhex(F.lit(""))))


@query("med_03", "select doc_id, text as comment from documents")
def med_03(spark, d):
    return docs(spark, d).select("doc_id", provenance.png_text_chunks(png(F.col("text")))["Comment"].alias("comment"))


def pictures(spark, d):
    """A gray image a vector: its outer product with itself."""
    row = lambda x: F.transform("embedding", lambda y: F.round(128 + 100 * x * y, 3).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", row).alias("pixels"))


@query("med_04")
def med_04(spark, d):
    return provenance.score_pixels(pictures(spark, d), "vec_id").select("vec_id", *(F.round(c, 4).alias(c) for c in ("fft", "slope", "high")), "error")


@query("med_05", """with m as (select p_partkey, (p_size % 16) / 1e2 as std, p_partkey % 15 - 3 as k from part)
select p_partkey, round(case when std < 15e-3 then 7e-1 when std < 3e-2 then 55e-2 when std > 12e-2 then 6e-1 when std > 8e-2 then 4e-1 else 2e-1 end * 5e-1 + case when k > 10 then 8e-1 when k > 5 then 6e-1 when k < -1 then 6e-1 else 3e-1 end * 5e-1, 6) as x from m""")
def med_05(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(provenance.noise_band((F.col("p_size") % 16) / 1e2, F.col("p_partkey") % 15 - 3), 6).alias("x"))


@query("med_05_moments")
def med_05_moments(spark, d):
    return provenance.score_pixels(pictures(spark, d), "vec_id").select("vec_id", *(F.round(c, 4).alias(c) for c in ("noise_std", "noise_kurtosis")), F.round(provenance.noise_band(F.col("noise_std"), F.col("noise_kurtosis")), 4).alias("score"))


def jpeg(k):
    """Bytes of an image file: by k mod 9 none, one without tables, one with an unusual table, the usual luminance, the usual chrominance, three segments, a third unusual segment, both usual tables in one segment, and a 16-bit table."""
    seg = lambda values, head=0: "FFDB0043" + bytes([head, *values]).hex()
    usual, colour, flat = seg(provenance.LUMINANCE), seg(provenance.CHROMINANCE, 1), seg([200] * 64)
    pair = "FFDB0084" + bytes([0, *provenance.LUMINANCE, 1, *provenance.CHROMINANCE]).hex()
    bodies = ("", flat, usual, colour, usual * 2 + colour, usual + colour + flat, pair, seg(provenance.LUMINANCE, 16))
    made = F.when(k % 9 == 0, F.unhex(F.lit("474946")))
    for i, body in enumerate(bodies, 1):
        made = made.when(k % 9 == i, F.unhex(F.lit("FFD8FFD0" + body + "FFDA")))
    return made


JPEG = "[-1e0, 4e-1, 65e-2, 45e-2, 45e-2, 25e-2, 25e-2, 45e-2, 65e-2][doc_id % 9 + 1]"


@query("med_06", f"select doc_id, {JPEG} as score from documents")
def med_06(spark, d):
    return docs(spark, d).select("doc_id", provenance.jpeg_scores(F.concat(jpeg(F.col("doc_id")), F.encode("text", "UTF-8"))).alias("score"))


@query("med_11", f"""with j as (select doc_id, {JPEG} as j, doc_id % 4 = 0 as n from documents)
select doc_id, case when doc_id % 5 = 0 then 'no content' end as error, case when doc_id % 5 > 0 then round((55e-1 + greatest(j, 0) * 20 + case when n then 65e-1 else 0 end) / (10 + case when j >= 0 then 20 else 0 end + case when n then 10 else 0 end), 6) end as rate from j""")
def med_11(spark, d):
    """A quarter of the items have an even picture, too small for a spectrum but not for its noise."""
    even = F.when(F.col("doc_id") % 4 == 0, F.array_repeat(F.array_repeat(F.lit(99.0), 20), 20))
    items = docs(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, jpeg(F.col("doc_id"))).alias("content"), even.alias("pixels"))
    return provenance.score_items(items).select(F.col("id").alias("doc_id"), "error", F.round("rate", 6).alias("rate"))


@query("ser_02", f"""with recursive g as (select event_type, date_trunc('day', ts) as day, value as v from events), {AG_09.format(key="event_type, day", rows="g").removeprefix("with ")}, s as (select *, row_number() over (partition by event_type order by day) as n from r),
l as (select event_type, day, n, lo, hi from s where n = 1 union all select s.event_type, s.day, s.n, 9e-1 * l.lo + 1e-1 * s.lo, 9e-1 * l.hi + 1e-1 * s.hi from l join s on s.event_type = l.event_type and s.n = l.n + 1)
select event_type, strftime(day, '%Y-%m-%d') as day, round(lo, 6) as lo_s, round(hi, 6) as hi_s from l""")
def ser_02(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"), "value")
    r = relational.percentile_range(e, ["event_type", "day"], "value")
    return series.ema_range(r, "event_type", "day", "lo", "hi").select("event_type", F.col("n").alias("day"), F.round("lo_s", 6).alias("lo_s"), F.round("hi_s", 6).alias("hi_s"))


def streamed(spark, d):
    """A store that a stream of two micro-batches fills."""
    target, source = scratch(spark, "ingested"), scratch(spark, "arriving")
    # two micro-batches of as many files as the table has parts, so that no task reads a batch
    rows = loaders.spread(docs(spark, d)).select("text", F.col("source").alias("project"))
    (rows if rows.rdd.getNumPartitions() > 1 else rows.repartition(2)).write.parquet(source)
    n = max(2, len(spark.read.parquet(source).inputFiles()))
    files = spark.readStream.schema("text string, project string").option("maxFilesPerTrigger", (n + 1) // 2).parquet(source)
    jobs.ingest_stream(files, target, scratch(spark, "progress"), 16).awaitTermination()
    return target


@query("str_04", "select distinct sha256(text) as checksum from documents")
def str_04(spark, d):
    return versioned.read(spark, streamed(spark, d), "documents").select(F.col("doc_id").alias("checksum"))


@query("str_04_tables", "select sha256(text) as doc_id, any_value(strlen(text)) as size, text <> '' as chunked, true as whole from documents group by text")
def str_04_tables(spark, d):
    """Each document with whether it has chunks, and whether these are numbered without a gap and have a vector and their tokens' postings each."""
    path = streamed(spark, d)
    t = {n: versioned.read(spark, path, n) for n in ("documents", "chunks", "embeddings", "postings")}
    terms = t["postings"].groupBy("doc_id", "chunk_id").agg(F.sum("tf").alias("tokens"), F.max("doc_len").alias("doc_len"))
    own = t["chunks"].join(t["embeddings"], ["doc_id", "chunk_id"], "left").join(terms, ["doc_id", "chunk_id"], "left")
    n = S.token_count("content")
    fine = (F.size("vector") == 16) & (n == F.coalesce("tokens", F.lit(0))) & (n == F.coalesce("doc_len", F.lit(0)))
    g = own.groupBy("doc_id").agg((F.bool_and(F.coalesce(fine, F.lit(False))) & (F.count("*") == F.count_distinct("chunk_index")) & (F.count("*") == F.max("chunk_index") + 1)).alias("fine"))
    return t["documents"].join(g, "doc_id", "left").select("doc_id", "size", F.col("fine").isNotNull().alias("chunked"), F.coalesce("fine", F.col("size") == 0).alias("whole"))


@query("str_05", """with p as (select n_name as provider, n_nationkey % 3 = 0 as free, n_nationkey % 4 = 0 as good, n_nationkey % 5 as used, n_nationkey % 3 * 2 as total from nation), u as (select * from p where total <= 0 or used < total),
l as (select s, array_to_string(list(provider order by provider), ',') as eligible from u, (values ('quality'), ('cheap'), ('auto')) as v(s) where case s when 'quality' then good when 'cheap' then free else free or good end group by s)
select event_id as req, eligible from events join l on s = case event_type when 'click' then 'quality' when 'view' then 'cheap' else 'auto' end""")
def str_05(spark, d):
    k = F.col("n_nationkey")
    tags = F.array_compact(F.array(F.when(k % 3 == 0, "free"), F.when(k % 4 == 0, "quality")))
    providers = table(spark, d, "nation").select(F.col("n_name").alias("provider"), (1 + k % 5).alias("weight"), (k % 5).alias("used"), (k % 3 * 2).alias("total"), tags.alias("tags"))
    strategy = F.when(F.col("event_type") == "click", "quality").when(F.col("event_type") == "view", "cheap").otherwise("auto")
    requests = table(spark, d, "events").select(F.col("event_id").alias("req"), strategy.alias("strategy"), F.lit(None).cast("array<string>").alias("preferred"))
    return jobs.route_provider(requests, providers).select("req", F.array_join(F.array_sort("ordered"), ",").alias("eligible"))


@query("udf_01", "select doc_id, 2 as dim, cast(length(text) as float) as x from documents")
def udf_01(spark, d):
    extensions.register_embedder("lengths", lambda: lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32))
    v = docs(spark, d).select("doc_id", extensions.embed_with("lengths", "text").alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.col("v")[0].alias("x"))


@query("udf_02", "select item_id as qid, doc_id as id, cast(length(d.text) as double) / length(b.text) as score from benchmark b, documents d where item_id % 50 = 0 qualify row_number() over (partition by item_id order by cast(length(d.text) as double) / length(b.text) desc, doc_id) <= 3")
def udf_02(spark, d):
    """The items whose number 50 divides, each against all documents."""
    b = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    r = docs(spark, d).select(F.col("doc_id").alias("id"), "text").crossJoin(b).withColumn("score", F.lit(0.0))
    score = extensions.scorer(lambda q, t: len(t) / len(q))
    return vectors.rerank(r, score(F.col("q"), F.col("text")), 3).select("qid", "id", "score")


@query("udf_03", "select doc_id::varchar as path, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then left(text, 5) end as text, case when doc_id % 3 = 2 then 'no loader' end as error from documents")
def udf_03(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("all", "head", "none"))), (F.col("doc_id") % 3 + 1).cast("int"))
    files = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), ext.alias("ext"), F.encode("text", "UTF-8").alias("content"))
    return extensions.load_with(files, {"all": lambda b: bytes(b).decode(), "head": lambda b: bytes(b).decode()[:5]})


@query("udf_04", r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) as n, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') as the, case when doc_id % 100 >= 90 then 4 when doc_id % 100 >= 65 then 3 when doc_id % 100 >= 40 then 2 when doc_id % 100 >= 20 then 1 else 0 end as level from documents")
def udf_04(spark, d):
    extensions.register_sql(spark)
    return spark.sql("select doc_id, size(tokenize(text)) as n, contains_word(text, 'The') as the, score_level(doc_id % 100 / 100D) as level from {docs}", docs=docs(spark, d))
