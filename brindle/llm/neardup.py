"""MinHash near-duplicate detection by a multi-index Hamming join (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, stored
from brindle.llm.graph import components
from brindle.llm.shingles import MinHasher, digest, mixed, shingle_set, similar

KNUTH = np.uint64(6364136223846793005)


@dataclass(frozen=True)
class NearDup:
    """words: of a shingle. percent: least 100 * intersection / union of a link.

    A signature has chunks * width components of 16 bits. Two signatures that
    differ in at most `distance` components have a chunk that differs in one
    component at most (chunks > distance / 2), so they meet in the index of
    that chunk with that component left out.
    """

    words: int = 4
    percent: int = 80
    chunks: int = 12
    width: int = 4
    distance: int = 21
    tries: int = 4


def signatures(docs: DataFrame, how: NearDup) -> DataFrame:
    """(doc_id, n_shingles, cls, sig): cls names the whole shingle set, sig is its MinHash signature; both null for an empty set."""

    def run(batches):
        hasher = MinHasher(how.chunks * how.width)
        for b in batches:
            n, cls, sig = [], [], []
            for text in b.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), how.words)
                n.append(len(s))
                cls.append(digest(s) if len(s) else None)
                sig.append(hasher(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "cls", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, cls binary, sig binary")


def index_keys(reps: DataFrame, how: NearDup) -> DataFrame:
    """(key, node): each chunk of each signature, once with each of its components left out."""

    def run(batches):
        left = np.array([[j for j in range(how.width) if j != out] for out in range(how.width)])
        tag = np.arange(how.chunks * how.width, dtype=np.uint64).reshape(how.chunks, how.width)
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, how.chunks, how.width).astype(np.uint64)
            key = np.broadcast_to(tag, (b.num_rows, *tag.shape)) + np.uint64(1)
            for j in range(how.width - 1):
                key = mixed(key * KNUTH + sig[:, :, left[:, j]])
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), tag.size)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node, pa.int64())], ["key", "node"])

    return reps.select("node", "sig").mapInArrow(run, "key long, node long")


def node_sets(docs: DataFrame, nodes: DataFrame, how: NearDup) -> DataFrame:
    """(node, shingles): of the documents that stand for their class, the sorted shingles as 8-byte integers."""

    def run(batches):
        for b in batches:
            node, out = [], []
            for k, cls, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                s = shingle_set(text.as_py(), how.words)
                if len(s) and digest(s) == cls:  # an id may repeat with another text
                    node.append(k)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])

    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return own.join(nodes, "node").select("node", "cls", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar enough."""

    def run(batches):
        for b in batches:
            load = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
            keep = [similar(load(x), load(y), how.percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def nearest_links(multi: DataFrame, reps: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Links of each node to the `tries` nearest, by signature, of the most central nodes of its buckets; the other links are left to `remaining_links`."""

    def distances(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
            d = (x != y).sum(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.int32())], ["a", "b", "d"])

    weight = multi.groupBy("node").agg(F.sum("n").alias("weight"))
    center = multi.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    pairs = multi.join(center, "key").select((-F.col("top.minus")).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    sig = reps.select("node", "sig")
    signed = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "x"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "y"}), "b")
    near = signed.select("a", "b", "x", "y").mapInArrow(distances, "a long, b long, d int").where(F.col("d") <= how.distance)
    ranked = near.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("d", "a"))).alias("m"))  # a node has a few buckets only
    best = ranked.select("b", F.explode(F.slice("m", 1, how.tries)).alias("m")).select(F.col("m.a").alias("a"), "b")
    return confirmed(best, sets, how)


def remaining_links(multi: DataFrame, labels: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """All links between nodes that share a bucket and have different labels.

    The nodes of buckets with two labels or more go through an exact
    prefix join: with each set ordered from its rarest shingle, two similar
    sets share a shingle before either has too few left for the intersection.
    How many it needs depends on the other's size, so a row goes only to the
    size classes that it can still reach. Sets that are mostly their own
    (heavily edited copies of one text) thus meet nobody, and shingles under
    one label only are left out, so a group of copies makes no pairs.
    """
    named = multi.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_nodes = named.join(mixed_keys, "key").select("node", "label").distinct()

    def shingle_rows(batches):
        for b in batches:
            for node, label, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.repeat(node, len(s)), pa.repeat(label, len(s)), pa.repeat(len(s), len(s))], ["shingle", "node", "label", "size"])

    rows = open_nodes.join(sets, "node").select("node", "label", "shingles").mapInArrow(shingle_rows, "shingle long, node long, label long, size long")
    df = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(df, "shingle").groupBy("node", "label", "size").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    # at: how many shingles come before; those that nobody else has come first. reach: the largest partner that this shingle can be the first common one with
    ordered = ordered.select("node", "label", "size", F.posexplode("s").alias("i", "t"), (F.col("size") - F.size("s")).alias("own"))
    ordered = ordered.select("node", "label", "size", F.col("t.shingle").alias("shingle"), (F.col("own") + F.col("i")).alias("at"))
    reach = F.floor((F.col("size") - F.col("at")) * F.lit(100 + how.percent) / F.lit(how.percent) - F.col("size"))
    ordered = ordered.withColumn("reach", reach).where(100 * F.col("reach") >= how.percent * F.col("size"))
    step = lambda c: F.floor(F.log(c.cast("double")) / F.lit(float(np.log(1.03)))).cast("int")
    small = ordered.where("reach >= size").withColumn("cls", step(F.col("size"))).withColumn("probe", F.lit(False))
    least = F.ceil(F.col("size") * how.percent / 100)
    large = ordered.withColumn("cls", F.explode(F.sequence(step(F.greatest(least, F.lit(1))), step(F.least("size", "reach"))))).withColumn("probe", F.lit(True))
    both = cut(small.unionByName(large).select("shingle", "cls", "probe", "node", "label", "size", "reach"))
    useful = both.groupBy("shingle", "cls").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("probe").alias("p"), F.bool_and("probe").alias("q")).where("lo <> hi and p and not q").select("shingle", "cls")
    both = both.join(useful, ["shingle", "cls"])
    x, y = both.where("not probe").alias("x"), both.where("probe").alias("y")
    met = x.join(y, ["shingle", "cls"]).where("x.size <= y.size and x.size <= y.reach and y.size <= x.reach and x.label <> y.label")
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return confirmed(pairs, sets, how)


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...).

    Documents of one shingle set form a class whose smallest doc_id stands for
    it; classes are linked by `nearest_links`, then by `remaining_links` across
    what is still apart. component_id is the smallest doc_id that links reach.
    Null or blank texts have no shingles: they are linked with nothing and
    kept. Rows with a null doc_id are kept, not linked, and get a null
    component. Rows that repeat an id count as one document for linking. Texts
    count whole, however long; other columns are left out; an empty table gives no rows.
    """
    sigs = stored(signatures(docs, how), "signatures")
    classes = stored(sigs.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("node"), F.max("sig").alias("sig")), "classes")
    keys = index_keys(classes, how)
    multi = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "node", "n"))
    met = classes.join(multi.select("node").distinct(), "node").select("node", "cls")
    sets = stored(node_sets(docs, met, how), "sets")
    first = cut(nearest_links(multi, classes, sets, how))
    labels = components(first)
    links = first.union(remaining_links(multi, labels, sets, how))
    found = components(links)
    named = classes.select("cls", "node").join(found, "node", "left").select("cls", F.coalesce("label", "node").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, how: NearDup = NearDup(words=5)) -> DataFrame:
    """One document of each component, the one whose hash is smallest; all columns of docs.

    Rows are linked and go by the hash of their id and text, so a row without
    an id goes like any other and a row that repeats an id stays or goes by
    its own text; rows equal in both are one document. Five-word shingles, as
    for all stages that no contract binds to others.
    """
    found = near_duplicates(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), how)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["doc_id"], "left_anti")
