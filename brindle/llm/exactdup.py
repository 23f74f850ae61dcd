"""Exact duplicates by an extendible-hash index on shared files.

Rows are first combined within their Arrow batch, so a text that a third of all
rows share reaches the index once a batch. The directory of the index doubles
where buckets are overfull; a bucket is a range of hash keys, owned by one
task, which chains the entries of equal hashes and compares their bytes.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from brindle.llm.common import WHITE, new_path, sliced, stored

#: Bits of a hash key; bytes of text that a bucket holds before it splits.
KEY_BITS = 63
BUCKET_BYTES = 64 << 20
#: Rows that a task has in Python at once.
SLICE = 512


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITE.encode())


def key_of(text: bytes, bits: int = KEY_BITS) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest()) >> (64 - bits)


def combined(docs: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """(entry, at, doc_id, points, key, n, bytes, sha, text): a row for each row of docs (doc_id, text).

    Rows of a batch with equal normalised bytes share an entry; its first row
    carries its key, number of rows, size, digest and text, the others null.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    fields = [("entry", LongType()), ("at", IntegerType()), ("doc_id", kind), ("points", LongType()), ("key", LongType()), ("n", LongType()), ("bytes", LongType()), ("sha", StringType()), ("text", BinaryType())]

    def run(batches):
        made = TaskContext.get().partitionId() << 36
        for b in sliced(batches, SLICE):
            found: dict[bytes, list] = {}
            entry, at, first = [], [], []
            for t in b.column(2).to_pylist():
                t = normalised(t)
                own = found.get(t)
                first.append(own is None)
                if own is None:
                    own = found[t] = [made, 0]
                    made += 1
                entry.append(own[0])
                at.append(own[1])
                own[1] += 1
            heads = iter(found.items())
            head = [(key_of(t, bits), c[1], len(t), hashlib.sha256(t).hexdigest(), t) if f and (t := (x := next(heads))[0]) is not None and (c := x[1]) else (None,) * 5 for f in first]
            key, n, size, sha, text = zip(*head, strict=True) if head else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), pa.array(at, pa.int32()), b.column(0), b.column(1), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())], names=[f for f, _ in fields])

    return rows.mapInArrow(run, StructType([StructField(*f) for f in fields]))


def directory(entries: DataFrame, most: int = BUCKET_BYTES, bits: int = KEY_BITS) -> np.ndarray:
    """The least keys of the buckets of entries (key, bytes), in order.

    The directory starts as deep as evenly filled buckets need. Then buckets of
    over `most` bytes split by a bit more of their keys, together, until all
    fit or what is left in them beside their longest chain does: a chain of one
    key can't be split. Only totals by bucket come to the driver.
    """
    total = entries.agg(F.sum("bytes")).head()[0] or 0
    depth = min(bits, max(0, ceil(log2(2 * total / most))) if total > most else 0)
    prefix = lambda d: F.shiftright("key", bits - d)
    ends, open_entries = [], entries
    while True:
        sizes = open_entries.groupBy(prefix(depth).alias("p")).agg(F.sum("bytes").alias("b")).where(F.col("b") > most)
        over = open_entries.join(F.broadcast(sizes.select("p")), prefix(depth) == F.col("p"))
        chains = over.groupBy("p", "key").agg(F.sum("bytes").alias("b")).groupBy("p").agg((F.sum("b") - F.max("b")).alias("rest"))
        split = [r[0] for r in chains.where(F.col("rest") > most).select("p").collect()]  # overfull buckets, each of over `most` bytes
        parents = range(1 << depth) if open_entries is entries else np.repeat(parents_split, 2) * 2 + np.tile([0, 1], len(parents_split))
        ends += [int(p) << (bits - depth) for p in parents]
        if not split or depth >= bits:
            return np.unique(np.array(ends, dtype=np.int64))
        parents_split = np.array(split, dtype=np.int64)
        open_entries = over.drop("p").where(prefix(depth).isin(split))
        depth += 1


def chained(entries: DataFrame) -> DataFrame:
    """entries (bucket, key, entry, n, sha, doc_id, points, text) with chain, of tasks that hold whole buckets in order of keys: texts of equal keys are compared byte by byte with those that head the key's chains. Only heads keep their text."""

    def run(batches):
        last, heads = None, {}
        for b in sliced(batches, SLICE):
            key, texts = b.column("key").to_pylist(), b.column("text").to_pylist()
            chain, kept = [], []
            for k, t in zip(key, texts, strict=True):
                if k != last:
                    last, heads = k, {}
                new = t not in heads  # a dictionary compares bytes
                chain.append(heads.setdefault(t, len(heads)))
                kept.append(t if new else None)
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(chain, pa.int64()), pa.array(kept, pa.binary())], names=[*names, "chain", "text"])

    fields = [f for f in entries.schema.fields if f.name != "text"]
    return entries.mapInArrow(run, StructType([*fields, StructField("chain", LongType()), StructField("text", BinaryType())]))


def write_index(rows: DataFrame, path: str, most: int = BUCKET_BYTES, bits: int = KEY_BITS) -> DataFrame:
    """The index of the entries of `combined` under path, a folder a bucket, and read back."""
    heads = rows.where("key is not null")
    ends = directory(heads.select("key", "bytes"), most, bits)

    @F.pandas_udf("long")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, key.to_numpy(), "right") - 1)

    owned = heads.select(bucket("key").alias("bucket"), "key", "entry", "n", "sha", "text").repartition("bucket").sortWithinPartitions("bucket", "key", "entry")
    chained(owned).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema("key long, entry long, n long, sha string, chain long, text binary, bucket long").parquet(path)


def exact_duplicates(docs: DataFrame, most: int = BUCKET_BYTES, bits: int = KEY_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of docs (doc_id, text).

    Texts are equal if they are without the characters of WHITE; of equal ones
    the row with the most code points stays, then the one with the least doc_id
    (null after all others), then, among rows equal in both, one of them. Null texts
    count as empty, and all blank texts are a group. No rows: no rows. Extra
    columns are left alone. Fewer `bits` make longer chains and the same rows.
    """
    path = new_path(docs.sparkSession, "entries")
    combined(docs.select("doc_id", "text"), bits).write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    index = write_index(rows, new_path(docs.sparkSession, "index"), most, bits)
    # a chain has an entry a batch at most; its best row is told from each entry's
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "at"))
    own = rows.groupBy("entry").agg(best.alias("best")).join(index.select("entry", "key", "chain", "n", "sha"), "entry")
    rank = F.min(F.struct("best.short", "best.none", "best.doc_id", "entry", "best.at"))
    groups = own.groupBy("key", "chain").agg(rank.alias("keep"), F.sum("n").alias("group_size"), F.first("sha").alias("text_sha256"))
    entries = stored(index.select("entry", "key", "chain").join(groups, ["key", "chain"]).select("entry", "keep", "group_size", "text_sha256"), "groups")
    kept = (F.col("entry") == F.col("keep.entry")) & (F.col("at") == F.col("keep.at"))
    return rows.select("entry", "at", "doc_id").join(entries, "entry").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
