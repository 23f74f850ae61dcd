"""Loaders: JSON and CSV corpora, file trees, pages and links, catalogs."""

from __future__ import annotations

import json
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions.scalars import CJK, FILE_KINDS, file_kind, glob_pattern, host

IDEAS = "title string, title_zh string, prompt string, prompt_zh string, image_urls array<string>, source_url string, author string, license string, lang string"
CATALOG = "success boolean, data struct<total:long,page:long,page_size:long,models:array<struct<id:string,name:string,media_type:string,vendor:struct<name:string>,pricing:struct<price:double,unit:string>,tags:array<string>>>>"
MOST_PAGE = 10 << 20
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df dealt over more tasks if it comes from fewer files than there are cores and is small by the planner's figures; else df.

    A file of one row group is read by one task, which would then do all the
    work on its texts. Tables beyond SPREAD_BYTES are never shuffled for this.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SPREAD_BYTES:  # no files are listed for large tables
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 1 + (size >> 20))) if 0 < len(df.inputFiles()) < cores else df


def load_ideas_json(spark: SparkSession, path: str) -> DataFrame:
    """The entries of files that hold a JSON array each; malformed files fail."""
    return spark.read.schema(IDEAS).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def load_ideas_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows with a content column; author and sourceMedia are JSON."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True).csv(path)
    if "content" not in raw.columns:
        raise ValueError("no content column")
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    zh = F.col("content").rlike(CJK)
    return raw.select(get("title").alias("title"), F.lit(None).cast("string").alias("title_zh"), F.col("content").alias("prompt"), F.when(zh, F.col("content")).alias("prompt_zh"), F.from_json(get("sourceMedia"), "array<string>").alias("image_urls"), get("sourceLink").alias("source_url"), F.get_json_object(get("author"), "$.name").alias("author"), F.lit(None).cast("string").alias("license"), F.when(zh, "zh").otherwise("en").alias("lang")).where(F.trim("prompt") != "")


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


#: Characters of a file's first line that tell whether it could be JSON.
HEAD = 1 << 16


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the start of the first line that isn't blank of each file, whose other lines are read one at a time; none for files without such a line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.substring("value", 1, HEAD).alias("value"))
    return lines.where(F.col("value").rlike(r"[^ \t\r\n]")).groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head"))


def could_be_json(head: Column) -> Column:
    """Whether a file that starts with this line can be JSON: an array or object, or one value that ends with the line, or a line too long to tell."""
    return head.rlike(r"^[ \t\r]*[\[{]") | head.rlike(r'^[ \t\r]*("(\\.|[^"\\])*"|true|false|null|NaN|-?Infinity|-?[0-9][0-9.eE+-]*)[ \t\r]*$') | (F.length(head) >= HEAD)


def json_kinds(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, kind): what each file is as JSON: array, other, or bad. A task has one text at a time as Python objects."""

    def kind(t):
        try:
            return "array" if isinstance(json.loads(t or ""), list) else "other"
        except ValueError:
            return "bad"

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind(t.as_py()) for t in b.column(1)], pa.string())], ["file", "kind"])

    return spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, "file string, kind string")


def scan_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(entry, name, n): all entries of the JSON and CSV sources (files, or folders of part files) of a folder, n being a source's place in the order of names.

    A JSON file must be an array from its start to its end; one that is no JSON is tried as CSV, and one that is other
    JSON gives no entries. Only what may be JSON by its first line is read as one text. A source without contents gives no entries and fails nothing.
    """
    parts, struct = [], IDEAS.replace(" ", ":").replace(",:", ",")
    names = [name for name in _children(spark, folder) if name.lower().endswith((".json", ".csv"))]
    for n, name in enumerate(names):
        path = f"{folder}/{name}"
        if name.lower().endswith(".json"):
            # names of files: Spark's own list of a folder has them on the driver too
            heads = [(r["file"], r["json"]) for r in file_heads(spark, path).select("file", could_be_json(F.col("head")).alias("json")).collect()]
            some = sorted(file for file, json_like in heads if json_like)
            kinds = [tuple(r) for r in json_kinds(spark, some).collect()] if some else []
            arrays = sorted(file for file, kind in kinds if kind == "array")
            bad = sorted([file for file, json_like in heads if not json_like] + [file for file, kind in kinds if kind == "bad"])
            found = spark.createDataFrame([], IDEAS)
            if arrays:
                found = spark.read.text(arrays, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{struct}>>")).alias("e")).select("e.*")
            try:
                found = found.unionByName(load_ideas_csv(spark, bad)) if bad else found
            except ValueError:
                pass
        else:
            try:
                found = load_ideas_csv(spark, path)
            except ValueError:
                continue
        parts.append(found.withColumns({"name": F.lit(name), "n": F.lit(n)}))
    none = spark.createDataFrame([], IDEAS + ", name string, n int")
    return reduce(DataFrame.unionByName, parts, none)


def load_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content, ext) of supported files; hidden folders below the given one are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = [e for es in FILE_KINDS.values() for e in es]
    return raw.withColumn("ext", ext).where(F.col("ext").isin(known) & ~below.rlike(r"/\.[^/]+/"))


def load_document(files: DataFrame) -> DataFrame:
    """files with markdown and error: text as it is, code and data fenced, HTML fenced after its source; PDF, DOCX and binary files are errors."""
    kind = file_kind("ext")
    binary = F.locate("\0", F.decode("content", "ISO-8859-1")) > 0
    bad = F.when(kind.isin("pdf", "docx"), F.concat(F.lit("unsupported: "), kind)).when((kind == "unknown") & binary, F.concat(F.lit("unsupported file type: ."), F.col("ext")))
    text = F.when(bad.isNull(), F.decode("content", "UTF-8"))
    fenced = lambda name: F.concat(F.lit("```"), name, F.lit("\n"), text, F.lit("\n```"))
    made = F.when(kind == "code", fenced(F.col("ext"))).when(kind.isin("json", "yaml"), fenced(kind)).when(kind == "html", F.concat(F.lit("Source: "), F.col("path"), F.lit("\n\n"), fenced(F.lit("html")))).otherwise(text)
    return files.withColumns({"error": bad, "markdown": F.when(bad.isNull(), made)})


class _Page(HTMLParser):
    """The main text of a page as Markdown."""

    SKIP = {"script", "style", "nav", "aside", "footer", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.main, self.skip, self.inside, self.title, self.in_title = [], [], 0, 0, "", False

    def handle_starttag(self, tag, attrs):
        self.in_title = self.in_title or tag == "title"
        self.skip += tag in self.SKIP
        self.inside += tag in ("article", "main")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.put("\n- ")
        elif tag in ("p", "div", "br", "tr", "section"):
            self.put("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        self.skip -= tag in self.SKIP and self.skip > 0
        self.inside -= tag in ("article", "main") and self.inside > 0

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        else:
            self.put(data)

    def put(self, s):
        if not self.skip:
            self.out.append(s)
            if self.inside:
                self.main.append(s)

    def text(self):
        lines = "".join(self.main or self.out).split("\n")
        return "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)


def page_markdown(html: str | None) -> tuple[str, str]:
    p = _Page()
    p.feed(html or "")
    return p.title.strip(), p.text()


def ingest_pages(pages: DataFrame, most: int = MOST_PAGE) -> DataFrame:
    """(page_id, url, title, markdown, size, error); pages of over `most` bytes (10 MiB) carry an error only."""

    def run(frames):
        for f in frames:
            made = [page_markdown(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "title": [t for t, _ in made], "markdown": [m for _, m in made], "size": [len(m.encode()) for _, m in made]})

    large = F.octet_length("html") > most
    fit = pages.where(F.coalesce(~large, F.lit(True))).select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, markdown string, size long")
    return fit.withColumn("error", F.lit(None).cast("string")).unionByName(pages.where(large).select("page_id", "url", F.lit("page too large").alias("error")), allowMissingColumns=True)


HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def raw_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of every link, in double, single or no quotes, in order."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))
    return found.withColumn("href", F.regexp_replace("href", r"""(?s)^(["'])(.*)\1$""", "$2"))


def resolve(base, href):
    """href, whose entities are undone, against base; null where that can't be."""

    @F.pandas_udf("string")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(x or "", unescape(y or ""))
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(b, h, strict=True)], dtype=object)

    return join(base, href)


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, link) of the links of each page, resolved against it, each once, pos being its first place; blank ones, fragments of the page and scripts are none."""
    raw = raw_links(pages).withColumn("href", F.regexp_replace("href", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).where(~F.col("href").rlike("^(#|javascript:|$)"))
    links = raw.select("page_id", "url", "pos", resolve(F.col("url"), F.col("href")).alias("link")).where("link <> ''")
    return links.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos")).select("page_id", "url", "pos", "link")


def link_filter(links: DataFrame, limit: int, same_host: bool = True) -> DataFrame:
    """The first `limit` (0 for all) of the resolved links (page_id, url, pos, link) of each page that have its host and port; mail is left out."""
    own = links.where(~F.col("link").contains("mailto:"))
    own = own.where(host("link") == host("url")) if same_host else own
    placed = own.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("pos", "link")))
    return placed.where(F.col("n") <= limit) if limit else placed


def page_title(html) -> Column:
    """The title of a page, its entities undone; '' without one."""

    @F.pandas_udf("string")
    def undone(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unescape(x))

    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(raw.contains("&"), undone(raw)).otherwise(raw)


def load_catalog_pages(spark: SparkSession, path: str) -> DataFrame:
    """The models of the pages of a catalog in order, until its total is reached; pages without success are left out. Only the pages' numbers and sizes are ordered."""
    pages = spark.read.schema(CATALOG).option("multiLine", True).option("recursiveFileLookup", True).json(path).where("coalesce(success, true)").select("data.*")
    sizes = pages.groupBy("page").agg(F.sum(F.size("models")).alias("n"), F.max("total").alias("total"))
    before = F.coalesce(F.sum("n").over(W.orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("before", before).where("total is null or before < total").select("page")
    return pages.join(wanted, "page", "left_semi").select(F.explode("models").alias("m")).select("m.*")


def find_files(files: DataFrame, pattern: str, limit: int = 0) -> DataFrame:
    """(path, length, size) of the first `limit` files (path, length) whose name matches the glob or holds pattern in any case, folder by folder in order of names; 30 if limit is none, 100 at most. Sizes above 1024 bytes are in KB or MB with one decimal."""
    limit = 30 if limit <= 0 else min(limit, 100)
    name = F.substring_index("path", "/", -1)
    hit = F.regexp_like(name, glob_pattern(F.lit(pattern))) | F.contains(F.lower(name), F.lit(pattern.lower()))
    n = F.col("length")
    size = F.when(n > 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n > 1 << 10, F.format_string("%.1f KB", n / float(1 << 10))).otherwise(F.concat(n.cast("string"), F.lit(" B")))
    return files.where(hit).select("path", "length", size.alias("size")).orderBy(F.split("path", "/"), "length").limit(limit)
