"""A stored index in blocks, with the best score that a block could give, for searches that skip blocks.

A term's postings lie in blocks of about 64 documents of like length, fewer where they are very long; a block
says how many documents it has and the greatest share that the term has in the score of
one of them, before its weight. An index has segments: documents that come later make one more, and
nothing that is there is written again. A segment counts once its totals, which come last, are there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scalars import token_count, tokenize
from brindle.operators.retrieval import K1, B, query_terms, top_k
from brindle.session import stored
from brindle.sources.loaders import spread

BLOCK, BUCKETS = 64, 8
#: Prefixes of one search that become ranges of the sorted dictionary; more of them are joined.
MOST_RANGES = 200
#: Postings of a search, each as often as queries ask for it, that are all scored at once; beyond that blocks are skipped.
FEW_POSTINGS = 20_000_000
BLOCKS = "term string, block long, n long, top double, docs array<struct<id:{kind},tf:long,doc_len:int,positions:array<int>>>, segment string, bucket int"
SEGMENTS = "segment string, n_docs long, n_tokens long, avg_len double, buckets int, id_kind string"
LAST = "\U0010ffff"
#: Bytes of texts that a task makes one file a bucket of, and the fewest that it is given for more tasks; tokens that it has in arrays at once.
TEXTS, LEAST_TEXTS, TOKENS = 8 << 20, 4 << 20, 1 << 18


def length_class(n: Column) -> Column:
    """Documents of one class differ in bytes by a fifth at most."""
    return F.floor(F.log2(n + 1.0) * 4).cast("int")


def share_of(tf, doc_len, avg_len: float):
    """What a posting adds to a score, before its term's weight; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / (avg_len or 1.0)))


def share(avg_len: float) -> Column:
    return share_of(F.col("tf"), F.col("doc_len"), avg_len)


def inverted(blocks: pa.Array, ids: pa.Array, texts: pa.Array, avg_len: float) -> pa.RecordBatch:
    """(term, block, n, top, docs) of the tokens of documents, which come by block and id."""
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = texts.flatten().dictionary_encode()
    names, own = np.unique(blocks.to_numpy(zero_copy_only=False), return_inverse=True)
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(names)) + own[doc]
    order = np.argsort(key, kind="stable")  # tokens of a key stay by document and place
    key, doc, pos = key[order], doc[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf, key, doc = np.diff(np.append(at, len(key))), key[at], doc[at]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(pos)).astype(np.int32)), pa.array(pos.astype(np.int32)))
    one = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf.astype(np.int64)), pa.array(size[doc].astype(np.int32)), places], ["id", "tf", "doc_len", "positions"])
    top = np.maximum.reduceat(share_of(tf, size[doc], avg_len), start) if len(start) else np.empty(0)
    rows = {"term": words.dictionary.take(pa.array(key[start] // max(1, len(names)))), "block": pa.array(names[key[start] % max(1, len(names))].astype(np.int64)), "n": pa.array(np.diff(np.append(start, len(key))).astype(np.int64)), "top": pa.array(top)}
    return pa.RecordBatch.from_pydict(rows | {"docs": pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), one)})


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by block, in batches of whole blocks with about TOKENS tokens (of the column t)."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            held.append(part)
            n += pc.sum(pc.list_value_length(part.column("t"))).as_py() or 0
            if n < TOKENS:
                continue
            last = part.column("block")[-1].as_py()
            if held[0].column("block")[0].as_py() == last:
                continue
            rows = pa.concat_batches(held)
            end = int(np.searchsorted(rows.column("block").to_numpy(), last))
            yield rows.slice(0, end)
            held = [rows.slice(end)]
            n = pc.sum(pc.list_value_length(held[0].column("t"))).as_py() or 0
    if held:
        yield pa.concat_batches(held)


def write_segment(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> str:
    """Add docs to the index under path as a segment, and return its name. A document that is in the index already counts twice."""
    name = uuid.uuid4().hex[:12]
    spark, length = docs.sparkSession, F.coalesce(F.octet_length(text_col), F.lit(0))
    sizes = spread(docs.select(text_col)).groupBy(length_class(length).alias("c")).agg(F.count("*").alias("n"), F.sum(token_count(text_col)).alias("tokens"), F.sum(length.cast("long")).alias("bytes"))
    sizes = sizes.collect()  # a row a class of lengths, which are less than 200
    many = F.create_map(*(F.lit(x) for r in sizes for x in (r["c"], ceil(max(r["n"] / BLOCK, r["bytes"] / TEXTS))))) if sizes else F.create_map(F.lit(0), F.lit(1))
    avg_len = sum(r["tokens"] for r in sizes) / max(1, sum(r["n"] for r in sizes))
    n_bytes = sum(r["bytes"] for r in sizes)
    tasks = max(1, ceil(n_bytes / TEXTS), min(spark.sparkContext.defaultParallelism, ceil(n_bytes / LEAST_TEXTS)))
    # texts, not postings, are shuffled: a task has whole blocks, and writes what it makes of them
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), length_class(length).alias("c"))
    rows = rows.select((F.col("c").cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), many[F.col("c")])).alias("block"), "id", "text")
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", "id").select("block", "id", tokenize("text").alias("t"))

    def run(batches):
        for b in whole_blocks(batches):
            yield inverted(b.column("block"), b.column("id"), b.column("t"), avg_len)

    kind = docs.schema[id_col].dataType.simpleString()
    b = rows.mapInArrow(run, BLOCKS.format(kind=kind).split(", segment")[0])
    b = b.withColumns({"segment": F.lit(name), "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")})
    b.sortWithinPartitions("segment", "bucket", "term", "block").write.partitionBy("segment", "bucket").option("compression", "zstd").mode("append").parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks/segment={name}").groupBy("term").agg(F.sum("n").alias("df")).withColumn("segment", F.lit(name))
    # sorted files: a range of terms is in one or two of them, which their least and greatest terms tell
    terms.repartitionByRange("term").sortWithinPartitions("term").write.partitionBy("segment").mode("append").parquet(f"{path}/dictionary")
    totals = [(name, sum(r["n"] for r in sizes), sum(r["tokens"] for r in sizes), avg_len, buckets, kind)]
    spark.createDataFrame(totals, SEGMENTS).coalesce(1).write.mode("append").parquet(f"{path}/segments")
    return name


class BlockIndex:
    """An index to search, as it was when it was opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").collect()  # a row a segment
        self.segments = [r["segment"] for r in rows]
        self.buckets = rows[0]["buckets"]
        self.n_docs = sum(r["n_docs"] for r in rows)
        self.avg_len = sum(r["n_tokens"] for r in rows) / max(1, self.n_docs)
        # what a segment's shares grow by at most where documents are longer on average now than in it alone
        self.growth = {r["segment"]: max(1.0, self.avg_len / r["avg_len"]) if r["avg_len"] else 1.0 for r in rows}
        kinds = {"blocks": BLOCKS.format(kind=rows[0]["id_kind"]), "dictionary": "term string, df long, segment string"}
        self._read = {t: spark.read.schema(k).parquet(f"{path}/{t}").where(F.col("segment").isin(self.segments)) for t, k in kinds.items()}

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of terms (term), whose buckets alone are read."""
        b, asked = self._read["blocks"], terms.select("term").distinct()
        own = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # at most as many numbers as buckets
        return (b if len(own) == self.buckets else b.where(F.col("bucket").isin(own))).drop("bucket").join(asked, "term", "left_semi")

    def dictionary(self) -> DataFrame:
        """(term, segment, df), in files of sorted terms."""
        return self._read["dictionary"]

    def prefixed(self, prefixes: DataFrame) -> DataFrame:
        """(prefix, term) of the terms that start with each of prefixes (prefix): as ranges of the sorted dictionary, whose files tell whether they hold any."""
        asked = [r[0] for r in prefixes.where("prefix <> ''").select("prefix").distinct().limit(MOST_RANGES + 1).collect()]
        d = self.dictionary().select("term")
        if len(asked) <= MOST_RANGES:
            inside = F.lit(False)
            for p in sorted(asked):
                inside = inside | ((F.col("term") >= p) & (F.col("term") < p + LAST))
            d = d.where(inside)
        lengths = prefixes.where("prefix <> ''").select(F.length("prefix").alias("k")).distinct()
        heads = d.distinct().join(F.broadcast(lengths), F.length("term") >= F.col("k")).select("term", F.substr("term", F.lit(1), F.col("k")).alias("prefix"))
        return heads.join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "term").distinct()

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, id, tf, doc_len, positions) of terms (term)."""
        return self.blocks(terms).select("term", F.explode("docs").alias("d")).select("term", "d.*")

    def weights(self, queries: DataFrame) -> DataFrame:
        """(qid, term, n_terms, df, w): idf, as often as the term stands in the query."""
        terms = query_terms(queries)
        df = self.dictionary().join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1.0 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(df, "term").select("qid", "term", "n_terms", "df", (idf * F.col("times")).alias("w"))

    def bounds(self, blocks: DataFrame, weights: DataFrame, every_term: bool) -> DataFrame:
        """(qid, segment, block, bound, n): what a document of each block could score at most, and the postings it holds for the query."""
        hits = blocks.select("term", "segment", "block", "n", "top").join(weights, "term")
        growth = F.create_map(*(F.lit(x) for kv in self.growth.items() for x in kv))
        g = hits.groupBy("qid", "segment", "block", "n_terms").agg(F.sum(F.col("w") * F.col("top") * growth[F.col("segment")]).alias("bound"), F.count("*").alias("k"), F.sum("n").alias("n"))
        return (g.where("k = n_terms") if every_term else g).select("qid", "segment", "block", "bound", "n")

    def scored(self, pairs: DataFrame | None, blocks: DataFrame, weights: DataFrame, every_term: bool) -> DataFrame:
        """(qid, id, score, n_matched) of the documents of pairs (qid, segment, block), of all blocks for None."""
        if pairs is None:
            hits = blocks.select("term", "docs").join(weights, "term")
        else:
            hits = pairs.select("qid", "segment", "block").join(weights, "qid").join(blocks.select("term", "segment", "block", "docs"), ["term", "segment", "block"])
        each = hits.select("qid", "n_terms", "w", F.explode("docs").alias("d")).select("qid", "n_terms", "w", "d.id", "d.tf", "d.doc_len")
        out = each.groupBy("qid", "id", "n_terms").agg(F.sum(F.col("w") * share(self.avg_len)).alias("score"), F.count("*").alias("n_matched"))
        return (out.where("n_matched = n_terms") if every_term else out).select("qid", "id", "score", "n_matched")

    def search(self, queries: DataFrame, k: int = 10, every_term: bool = False, probe: int = 4, few: int = FEW_POSTINGS, seen: dict | None = None) -> DataFrame:
        """(qid, id, score, n_matched, rank): the k best documents by BM25 for queries (qid, query), with any or every term of theirs, ties by id.

        Up to `few` postings, told from the dictionary, are all scored, in one pass. Of more the
        `probe` blocks that could give most are scored first; then those
        that could still reach the k-th best score; the rows are the same. seen, if given, receives the frames of both and of all blocks with their postings.
        """
        weights = stored(self.weights(queries), "weights")
        blocks = self.blocks(weights)
        if (weights.agg(F.sum("df")).head()[0] or 0) <= few:
            return top_k(self.scored(None, blocks, weights, every_term), k)
        could = stored(self.bounds(blocks, weights, every_term), "bounds")
        first = top_k(could, probe, by="bound", key="block", rank="r").drop("r")
        sure = stored(self.scored(first, blocks, weights, every_term), "first-scores")
        least = top_k(sure, k).where(F.col("rank") == k).select("qid", (F.col("score") * (1 - 1e-9)).alias("least"))
        rest = could.join(first.select("qid", "segment", "block"), ["qid", "segment", "block"], "left_anti").join(least, "qid", "left").where("least is null or bound >= least")
        if seen is not None:
            seen.update(all=could, first=first, rest=rest)
        return top_k(sure.unionByName(self.scored(rest, blocks, weights, every_term)), k)
