"""Inverted index, BM25, full-text matching, rank fusion."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from brindle.functions.queries import parse_query
from brindle.functions.scalars import contains_word, token_count, tokenize
from brindle.operators import vectors
from brindle.operators.relational import scope
from brindle.session import stored
from brindle.sources.loaders import spread

K1, B, RRF_PAIR, RRF_LISTS = 1.2, 0.75, 30, 60


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions, doc_len): the inverted index; write it partitioned by a hash of term to reuse it.

    A document's tokens are sorted within its row, and each run of equal ones
    is a posting, so nothing is shuffled; a row that repeats an id is a document of its own.
    """
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), tokenize(text_col).alias("t"))
    places = rows.select("id", F.size("t").alias("doc_len"), F.array_sort(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos")))).alias("s"))
    first = lambda i: (i == 1) | (F.col("s")[i - 1]["term"] != F.col("s")[F.greatest(i - 2, F.lit(0))]["term"])
    runs = places.select("id", "doc_len", "s", F.when(F.col("doc_len") > 0, F.filter(F.sequence(F.lit(1), F.greatest("doc_len", F.lit(1))), first)).alias("at"))

    def posting(i, k):
        n = F.coalesce(F.get("at", k + 1), F.col("doc_len") + 1) - i
        return F.struct(F.col("s")[i - 1]["term"].alias("term"), n.cast("long").alias("tf"), F.transform(F.slice("s", i, n), lambda x: x["pos"]).alias("positions"))

    found = runs.select("id", "doc_len", F.explode(F.transform("at", posting)).alias("p"))
    return found.select("p.term", "id", "p.tf", "p.positions", "doc_len")


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, doc_len) without positions: tokens are counted before they are shuffled. With terms (term) only of those, which the tokens meet first, so nothing else is counted or shuffled."""
    tokens = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), tokenize(text_col).alias("t")).select("id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    if terms is not None:
        tokens = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf")).select("term", "id", "tf", "doc_len")


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times, n_terms) from (qid, query)."""
    t = queries.select("qid", tokenize("query").alias("t")).select("qid", F.size(F.array_distinct("t")).alias("n_terms"), F.explode("t").alias("term"))
    return t.groupBy("qid", "term", "n_terms").agg(F.count("*").alias("times"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, avg_len (over at least one document)."""
    return spread(docs.select(text_col)).agg(F.count("*").alias("n_docs"), (F.coalesce(F.sum(token_count(text_col)), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, n_docs, avg_len): texts are read once, and a task sends each of its terms once; a row without a term carries the totals."""
    t = spread(docs.select(text_col)).select(F.coalesce(tokenize(text_col), F.array().cast("array<string>")).alias("t"))
    own = t.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("t"))).alias("term"), F.size("t").alias("n"))
    counts = own.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("n"))
    counts = stored(counts, "frequencies")
    totals = counts.where("term is null").select(F.col("df").alias("n_docs"), (F.col("n") / F.greatest("df", F.lit(1))).alias("avg_len"))
    return counts.where("term is not null").select("term", "df").join(F.broadcast(totals))


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", project: str | None = None, vault: str | None = None, buckets: int = 256) -> None:
    """Store the index of docs under path for many queries: postings by a hash of the term, frequencies, and lengths with the project of each document. Documents whose vault column holds are left out."""
    open_docs = docs.where(~F.coalesce(F.col(vault), F.lit(False))) if vault else docs
    p = postings(open_docs, id_col, text_col)
    p.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    document_frequencies(open_docs, text_col).write.mode("overwrite").parquet(f"{path}/frequencies")
    scoped = F.coalesce(F.col(project), F.lit("")) if project else F.lit("")
    open_docs.select(F.col(id_col).alias("id"), scoped.alias("project"), F.octet_length(text_col).alias("bytes")).write.mode("overwrite").parquet(f"{path}/documents")


def read_index(spark, path: str, terms: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """(term, id, tf, positions, doc_len, df, n_docs, avg_len) of an index, of the terms asked for only: their buckets are pruned from the scan by a bounded list."""
    p = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        asked = terms.select("term").distinct()
        found = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # at most `buckets` numbers
        p = p.where(F.col("bucket").isin(found)).join(asked, "term", "left_semi")
    return p.drop("bucket").join(spark.read.parquet(f"{path}/frequencies"), "term")


def with_idf(df: DataFrame, n_docs: str = "n_docs") -> DataFrame:
    return df.withColumn("idf", F.log(1.0 + (F.col(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25_of(counts: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, score, n_matched, n_terms): BM25 by counts (term, id, tf, doc_len), which need hold no terms but those asked for, stats (n_docs, avg_len) and terms of `query_terms`; repeated query terms count as often as they stand."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    scored = with_idf(df.join(F.broadcast(stats)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    hits = counts.join(scored, "term").withColumn("part", part).join(terms, "term")
    return hits.groupBy("qid", "id", "n_terms").agg(F.sum(F.col("part") * F.col("times")).alias("score"), F.count("*").alias("n_matched"))


def bm25(docs: DataFrame, queries: DataFrame, every_term: bool = False) -> DataFrame:
    """(qid, id, score, n_matched): BM25 of each document that has a term (or every term) of each query.

    Only terms that queries ask for are counted and shuffled: the corpus'
    tokens meet the distinct query terms first. Texts are read once, as each
    document's length comes along under the empty term, which no token is; the
    few counts that are left are stored for totals, frequencies and scores.
    """
    terms = query_terms(queries)
    asked = terms.select("term").distinct()
    asked = asked.union(asked.sparkSession.range(1).select(F.lit("")))
    tokens = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.coalesce(tokenize("text"), F.array().cast("array<string>")).alias("t"))
    found = tokens.select("id", F.size("t").alias("doc_len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).join(asked, "term")
    counts = stored(found.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf")), "asked-terms")
    own = counts.where("term = ''")
    stats = own.agg(F.sum("tf").alias("n_docs"), (F.coalesce(F.sum(F.col("doc_len") * F.col("tf")), F.lit(0)) / F.greatest(F.coalesce(F.sum("tf"), F.lit(0)), F.lit(1))).alias("avg_len"))
    out = bm25_of(counts.where("term <> ''"), stats, terms)
    if every_term:
        out = out.where("n_matched = n_terms")
    return out.select("qid", "id", "score", "n_matched")


def top_k(df: DataFrame, k: int, by: str = "score", group: str = "qid", key: str = "id", rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ties by key; Spark keeps k a partition before it shuffles."""
    w = W.partitionBy(group).orderBy(F.desc(by), F.col(key))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def match_and(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id) that hold every term."""
    return counts.join(terms, "term").groupBy("qid", "id", "n_terms").agg(F.count("*").alias("n")).where("n = n_terms").select("qid", "id")


def match_or(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id) that hold a term of three bytes or more, of queries with two such at least."""
    long = terms.where(F.octet_length("term") >= 3)
    asked = long.groupBy("qid").agg(F.count("*").alias("n")).where("n >= 2").select("qid")
    return counts.join(long.join(asked, "qid"), "term").select("qid", "id").distinct()


def match_prefix(counts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(qid, id) with a term that starts with prefix: the dictionary is searched by equal first bytes, then its terms are looked up."""
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct()
    heads = counts.select("term").distinct().join(F.broadcast(lengths.where("n > 0")), F.length("term") >= F.col("n")).select("term", F.substr("term", F.lit(1), F.col("n")).alias("prefix"))
    return counts.join(heads.join(prefixes, "prefix"), "term").select("qid", "id").distinct()


def match_phrase(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(qid, id) where the words of phrase (an array) stand in a row."""
    # a table of known size meets the index where it lies; places are shuffled as arrays, one a term of a document
    p = stored(phrases.select("qid", F.size("phrase").alias("n"), F.posexplode("phrase").alias("i", "term")), "phrase-terms")
    at = index.join(p, "term").select("qid", "id", "n", "i", F.transform("positions", lambda x: x - F.col("i")).alias("starts"))
    held = at.groupBy("qid", "id", "n").agg(F.collect_list(F.struct("i", "starts")).alias("h")).where(F.size(F.array_distinct("h.i")) == F.col("n"))
    of = lambda i: F.flatten(F.transform(F.filter("h", lambda x: x["i"] == i), lambda x: x["starts"]))
    common = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), of(F.lit(0)), lambda found, i: F.array_intersect(found, of(i)))
    return held.where(F.size(common) > 0).select("qid", "id").distinct()


def query_ladder(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, stage) of the first stage that finds anything: 1 all terms, 2 all of more than two bytes, 3 any of three bytes or more."""
    one = match_and(counts, terms).withColumn("stage", F.lit(1))
    longer = terms.where(F.octet_length("term") > 2)
    longer = longer.drop("n_terms").join(longer.groupBy("qid").agg(F.count("*").alias("n_terms")), "qid")
    two = match_and(counts, longer).withColumn("stage", F.lit(2))
    three = match_or(counts, terms).withColumn("stage", F.lit(3))
    every = one.unionByName(two).unionByName(three)
    best = every.groupBy("qid").agg(F.min("stage").alias("stage"))
    return every.join(best, ["qid", "stage"]).select("qid", "id", "stage")


def ngram_bag(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, gram, n): lower-cased byte n-grams with counts, in hexadecimal."""
    b = F.encode(F.lower(F.col(text)), "UTF-8")
    long = df.select(key, b.alias("b")).where(F.octet_length("b") >= n)
    grams = long.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("b") - n + 1), lambda i: F.hex(F.substr("b", i, F.lit(n))))).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("n"))


def shared_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, cosine) of the bags a (x, gram, n), a stated query set, and b (y, gram, n) that share a gram: one join, whose products are summed before the shuffle."""
    na = a.groupBy("x").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("na"))
    nb = b.groupBy("y").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("nb"))
    dot = a.withColumnRenamed("n", "n1").join(b.withColumnRenamed("n", "n2"), "gram").groupBy("x", "y").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    return dot.join(na, "x").join(nb, "y").select("x", "y", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def sparse_cosine(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y) with cosine of the bags a (x, gram, n) and b (y, gram, n); 0 if either is empty."""
    na = a.groupBy("x").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("na"))
    nb = b.groupBy("y").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("nb"))
    dot = pairs.join(a.withColumnRenamed("n", "n1"), "x").join(b.withColumnRenamed("n", "n2"), ["y", "gram"]).groupBy("x", "y").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    out = pairs.join(dot, ["x", "y"], "left").join(na, "x", "left").join(nb, "y", "left")
    return out.select("x", "y", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def byte_grams(raw: bytes, n: int = 3) -> np.ndarray:
    """The n-grams of raw (n up to 3) as numbers."""
    b = np.frombuffer(raw, np.uint8).astype(np.int32)
    return sum((b[i : len(b) - n + 1 + i] << (8 * (n - 1 - i)) for i in range(n)), np.zeros(max(0, len(b) - n + 1), np.int32))


def gram_cosines(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id, cosine) of pairs (qid, id, query): that of the bags of lower-cased byte triples (as of `ngram_bag`) of the query and of the texts of docs (id, text); 0 if either is empty.

    The texts meet all their queries in one row, where their triples are counted; none of these is a row or shuffled.
    """
    kind = pairs.schema
    low = lambda c: F.encode(F.lower(c), "UTF-8")
    asked = pairs.groupBy("id").agg(F.collect_set(F.struct("qid", low("query").alias("query"))).alias("asked"))
    rows = docs.join(asked, "id").groupBy("id").agg(F.first("asked").alias("asked"), F.collect_list(low("text")).alias("texts"))

    def run(batches):
        @lru_cache(1 << 14)
        def bag(query: bytes):
            return np.unique(byte_grams(query), return_counts=True)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for key, asked, texts in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    gram, n = np.unique(np.concatenate([byte_grams(t) for t in texts or [b""]]), return_counts=True)
                    for x in asked:
                        own, m = bag(x["query"])
                        i = np.searchsorted(gram, own)
                        i[i == len(gram)] = 0
                        dot = int((m * n[i] * (gram[i] == own)).sum()) if len(gram) else 0
                        out.append((x["qid"], key, dot, int((m * m).sum()), int((n * n).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names, types = ["qid", "id", "dot", "a", "b"], [to_arrow_type(kind["qid"].dataType), to_arrow_type(kind["id"].dataType), *[pa.int64()] * 3]
    schema = T.StructType([kind["qid"], kind["id"], *(T.StructField(c, T.LongType()) for c in names[2:])])
    made = rows.select("id", "asked", "texts").mapInArrow(run, schema)
    return made.select("qid", "id", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("dot") / (F.sqrt("a") * F.sqrt("b"))).otherwise(0.0).alias("cosine"))


def rrf_pair(df: DataFrame, first: str, second: str, k: int = RRF_PAIR) -> DataFrame:
    """df (qid, id, ...) with rrf_score: thousandths of the summed reciprocal ranks by two columns."""
    r = lambda c: F.row_number().over(W.partitionBy("qid").orderBy(F.desc(c), "id"))
    return df.withColumn("rrf_score", F.floor((1.0 / (k + r(first)) + 1.0 / (k + r(second))) * 1000).cast("long"))


def rrf_fuse_lists(a: DataFrame, b: DataFrame, limit: int, k: int = RRF_LISTS) -> DataFrame:
    """(qid, id, score) from two lists (qid, id, rank); the ranks of b go on after those of a and one more."""
    n = a.groupBy("qid").agg(F.count("*").alias("n"))
    later = b.join(n, "qid", "left").select("qid", "id", (F.coalesce("n", F.lit(0)) + 1 + F.col("rank")).alias("rank"))
    both = a.select("qid", "id", "rank").unionByName(later)
    scored = both.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return top_k(scored, limit)


def parsed_terms(queries: DataFrame) -> DataFrame:
    """(qid, part, kind, bytes, terms) of queries (qid, query): the parts of each parsed search string, with the tokens that they must match and the length of the part."""
    parts = queries.select("qid", F.posexplode(parse_query(F.col("query"))).alias("part", "p"))
    return parts.select("qid", "part", "p.kind", F.octet_length("p.term").alias("bytes"), tokenize("p.term").alias("terms")).where(F.size("terms") > 0)


def part_matches(index: DataFrame, parts: DataFrame) -> DataFrame:
    """(qid, part, id) of the documents of index (term, id, positions) that hold each part: a phrase's tokens in a row, a prefix's last token as the start of one, else the token. Joins by terms throughout."""
    key = F.struct("qid", "part")
    rows = parts.select(key.alias("qid"), "kind", "terms")
    single = rows.where("kind <> 'prefix' and size(terms) = 1").select("qid", F.col("terms")[0].alias("term"))
    found = index.select("term", "id").join(single, "term").select("qid", "id")
    found = found.union(match_phrase(index, rows.where("kind <> 'prefix' and size(terms) > 1").select("qid", F.col("terms").alias("phrase"))))
    found = found.union(match_prefix(index, rows.where("kind = 'prefix'").select("qid", F.element_at("terms", -1).alias("prefix"))))
    return found.distinct().select("qid.qid", "qid.part", "id")


def search_ladder(index: DataFrame, parts: DataFrame) -> DataFrame:
    """(qid, id, stage) of the first stage that finds anything: 1 all parts, 2 all parts of more than two bytes, 3 any part of three bytes or more, where there are two such at least."""
    hits = part_matches(index, parts).join(parts.select("qid", "part", (F.col("bytes") > 2).alias("long")), ["qid", "part"])
    n = parts.groupBy("qid").agg(F.count("*").alias("n"), F.count(F.when(F.col("bytes") > 2, 1)).alias("n_long"))
    g = hits.groupBy("qid", "id").agg(F.count("*").alias("k"), F.count(F.when(F.col("long"), 1)).alias("k_long")).join(n, "qid")
    stage = F.when(F.col("k") == F.col("n"), 1).when((F.col("n_long") > 0) & (F.col("k_long") == F.col("n_long")), 2).when((F.col("n_long") > 1) & (F.col("k_long") > 0), 3)
    g = g.select("qid", "id", stage.alias("stage")).where("stage is not null")
    best = g.groupBy("qid").agg(F.min("stage").alias("stage"))
    return g.join(best, ["qid", "stage"]).select("qid", "id", "stage")


def asked_postings(docs: DataFrame, terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of `postings` whose term is one of terms (term) or starts with one of prefixes (prefix): tokens meet these before they are shuffled, so nothing else is."""
    heads = prefixes.where("prefix <> ''").select(F.length("prefix").alias("k"), F.col("prefix").alias("key")).distinct()
    lengths = sorted(r[0] for r in heads.select("k").distinct().collect())  # few: prefixes are of up to three bytes
    keys = terms.select(F.lit(0).alias("k"), F.col("term").alias("key")).distinct().union(heads)
    # numbered before it is exploded, so that a row that repeats an id is a document of its own
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), tokenize("text").alias("t"))
    tokens = rows.select("id", "row", F.size("t").alias("doc_len"), F.posexplode("t").alias("pos", "term"))
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("term").alias("key")), *(F.struct(F.lit(n).alias("k"), F.substring("term", 1, n).alias("key")) for n in lengths))
    found = tokens.withColumn("a", F.explode(both)).select("id", "row", "doc_len", "pos", "term", "a.*").join(keys, ["k", "key"], "left_semi")
    held = found.groupBy("term", "id", "row", "doc_len").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return held.select("term", "id", F.size("positions").cast("long").alias("tf"), "positions", "doc_len")


def full_text_search(docs: DataFrame, queries: DataFrame, limit: int, project: str = "", project_col: str = "project") -> DataFrame:
    """(qid, id, score, stage, rank): the best `limit` documents of docs (doc_id, text, project) that the ladder of each parsed query finds in the project, by BM25 of the query's tokens (rank 0 where a document holds prefixes only).

    Each stage looks at the project's documents alone, so a query falls through to
    the next one though another project would have held it. The statistics of BM25 are those of all documents.
    """
    own = scope(docs, project, project_col).select(F.col("doc_id").alias("id"))
    parts = stored(parsed_terms(queries), "parsed")
    terms = stored(parts.select(F.explode("terms").alias("term")).union(query_terms(queries).select("term")).distinct(), "asked")
    index = stored(asked_postings(docs, terms, parts.where("kind = 'prefix'").select(F.element_at("terms", -1).alias("prefix"))), "postings")
    found = search_ladder(index if project == "" else stored(index.join(own, "id", "left_semi"), "scoped"), parts)
    scored = bm25_of(index.select("term", "id", "tf", "doc_len"), corpus_stats(docs), query_terms(queries))
    both = found.join(scored, ["qid", "id"], "left").select("qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"), "stage")
    return top_k(both, limit)


def hybrid_search(docs: DataFrame, queries: DataFrame, corpus_vectors: DataFrame, query_vectors: DataFrame, limit: int = 10, project: str = "", min_score: float = 0.8, project_col: str = "project") -> DataFrame:
    """(qid, id, score, rank): full-text and vector search (corpus id, vector; queries qid, vector) of three times `limit` each in the documents of a project, fused."""
    full = full_text_search(docs, queries, 3 * limit, project, project_col)
    own = scope(docs, project, project_col).select(F.col("doc_id").alias("id"))
    near = vectors.vector_topk(query_vectors, corpus_vectors.join(own, "id", "left_semi"), 3 * limit)
    return vectors.hybrid_fuse(full, near, limit, min_score)


def idea_search(docs: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(qid, id, rrf_score, rank): documents with every query term, by BM25 (twice it if the first line has a query term) and by cosine of byte triples, fused."""
    scored = bm25(docs, queries, every_term=True)
    own = docs.select(F.col("doc_id").alias("id"), "text")
    asked = query_terms(queries).groupBy("qid").agg(F.collect_set("term").alias("terms"))
    # queries first: what has a text is never dealt by its query, of which there are few
    small = scored.join(asked, "qid").join(queries, "qid")
    lines = own.select("id", F.substring_index("text", "\n", 1).alias("line"))
    boost = F.exists("terms", lambda t: contains_word("line", t))
    hit = small.join(lines, "id").select("qid", "id", "query", F.when(boost, F.col("score") * 2).otherwise(F.col("score")).alias("bm25"))
    hit = stored(hit, "hits")
    cos = gram_cosines(hit.select("qid", "id", "query"), own)
    fused = rrf_pair(hit.join(cos, ["qid", "id"]), "bm25", "cosine")
    return top_k(fused.select("qid", "id", "rrf_score"), k, by="rrf_score")


def random_ideas(docs: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n rows in the order of a seeded hash of key; the same seed gives the same rows."""
    return docs.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
