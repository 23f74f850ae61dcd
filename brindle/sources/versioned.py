"""Stored tables in hash buckets, with versions: an update reads and writes the buckets of its keys, and all tables change at once.

A store is a folder. Each table has rows in `<table>/v=<version>/bucket=<b>`;
the manifest of a version says which folders hold each bucket, and becomes the
current one by a rename. What a job wrote before it was stopped is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts that a bucket may have before an append rewrites it.
MOST_PARTS = 16


class ChangedMeanwhile(RuntimeError):
    """Another job has made the version that this one was about to make."""


@dataclass
class Append:
    """Rows to add to a table."""

    rows: DataFrame


@dataclass
class Rewrite:
    """make(old rows of the buckets of `keys`) is what these buckets hold from now on; keys has the table's key column."""

    keys: DataFrame
    make: Callable[[DataFrame], DataFrame]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:12]) for n in _names(spark, f"{path}/_manifest") if n.endswith(".json") and n[:12].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the current one if none is given: its number, tables (key, number of buckets, schema, folders of each bucket) and the last batch of each stream. Its size is that of the buckets."""
    found = versions(spark, path)
    if not found:
        return {"version": -1, "tables": {}, "streams": {}}
    name = f"{path}/_manifest/{found[-1] if version is None else version:012d}.json"
    return json.loads("".join(r[0] for r in spark.read.text(name, wholetext=True).collect()))


def _commit(spark: SparkSession, path: str, made: dict) -> None:
    fs, folder = _fs(spark, f"{path}/_manifest")
    fs.mkdirs(folder)
    jvm = spark._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    final = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{made['version']:012d}.json"))
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:  # never over a version that is there
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), final, none)
    except Exception as e:
        fs.delete(aside, False)
        raise ChangedMeanwhile(str(made["version"])) from e


def create(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, str]], buckets: int = 64) -> None:
    """Add tables (rows and key column) to a store, in one version."""
    now = manifest(spark, path)
    made = {**now, "tables": {**now["tables"], **{n: {"key": k, "buckets": buckets, "schema": df.schema.jsonValue(), "at": [[] for _ in range(buckets)]} for n, (df, k) in tables.items()}}}
    _write(spark, path, made, {n: Append(df) for n, (df, _) in tables.items()})


def read(spark: SparkSession, path: str, table: str, buckets: list[int] | None = None, version: int | None = None, state: dict | None = None) -> DataFrame:
    """A table of a store, or some buckets of it. Versions that `vacuum` left can be read too."""
    t = (state or manifest(spark, path, version))["tables"][table]
    wanted = range(t["buckets"]) if buckets is None else buckets
    folders = [f"{path}/{table}/v={v}/bucket={b}" for b in wanted for v in t["at"][b]]
    schema = StructType.fromJson(t["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def touched(spark: SparkSession, path: str, table: str, keys: DataFrame, state: dict | None = None) -> list[int]:
    """The buckets of keys: as many numbers as the table has buckets at most."""
    t = (state or manifest(spark, path))["tables"][table]
    return sorted(r[0] for r in keys.select(bucket_of(t["key"], t["buckets"]).alias("b")).distinct().collect())


def _write(spark: SparkSession, path: str, made: dict, changes: dict[str, Append | Rewrite]) -> int:
    made = {**made, "version": made["version"] + 1}
    run = f"{made['version']}-{uuid.uuid4().hex[:8]}"
    tables = dict(made["tables"])
    for name, change in changes.items():
        t = tables[name]
        own = None
        if isinstance(change, Append):
            rows = change.rows
            full = [b for b in range(t["buckets"]) if len(t["at"][b]) >= MOST_PARTS]
            if full:  # what has many parts becomes one again
                rows, own = rows.unionByName(read(spark, path, name, full, state=made)), full
        else:
            own = touched(spark, path, name, change.keys, made)
            rows = change.make(read(spark, path, name, own, state=made))
        columns = StructType.fromJson(t["schema"]).names
        placed = rows.select(*columns).withColumn("bucket", bucket_of(t["key"], t["buckets"]))
        folder = f"{path}/{name}/v={run}"
        placed.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        new = {int(n.split("=")[1]) for n in _names(spark, folder) if n.startswith("bucket=")}
        at = list(t["at"])
        for b in range(t["buckets"]):
            at[b] = ([] if own is not None and b in own else at[b]) + ([run] if b in new else [])
        tables[name] = {**t, "at": at}
    _commit(spark, path, {**made, "tables": tables})
    return made["version"]


def change(spark: SparkSession, path: str, changes: dict[str, Append | Rewrite], stream: str | None = None, batch: int | None = None) -> int | None:
    """Make changes of several tables as one new version and return its number.

    With a stream's name and a batch's number, None and nothing done if that batch or a later one of the
    stream is in the store. If another job has made a version in the meantime, ChangedMeanwhile is raised and nothing has changed.
    """
    now = manifest(spark, path)
    if stream is not None:
        if now["streams"].get(stream, -1) >= batch:
            return None
        now = {**now, "streams": {**now["streams"], stream: batch}}
    return _write(spark, path, now, changes)


def upsert(spark: SparkSession, path: str, table: str, updates: DataFrame, now=None) -> int | None:
    """`upsert_documents` on the buckets of updates."""
    from brindle.operators.hygiene import upsert_documents

    key = manifest(spark, path)["tables"][table]["key"]
    return change(spark, path, {table: Rewrite(updates, lambda old: upsert_documents(old, updates, now, key))})


def replace(spark: SparkSession, path: str, rows: dict[str, DataFrame], doc: str = "doc_id") -> int | None:
    """`replace_chunks` on the buckets of the documents of rows (chunks, embeddings, postings): checked before anything is written, then all at once."""
    from brindle.operators.hygiene import check_even

    check_even(rows["chunks"], rows["embeddings"], doc)
    keys = rows["chunks"].select(doc).distinct()
    made = {n: Rewrite(keys, lambda old, new=new: old.join(keys, doc, "left_anti").unionByName(new.select(*old.columns))) for n, new in rows.items()}
    return change(spark, path, made)


def delete(spark: SparkSession, path: str, ids: DataFrame, tables: list[str] | None = None) -> int | None:
    """All rows of the keys in ids (one column) go from the tables."""
    state = manifest(spark, path)["tables"]
    own = lambda n: ids.select(F.col(ids.columns[0]).alias(state[n]["key"])).distinct()
    return change(spark, path, {n: Rewrite(own(n), lambda old, n=n: old.join(own(n), state[n]["key"], "left_anti")) for n in tables or state})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the manifests but the last `keep` ones, and the folders that none of these names; return what went. Not while a job writes to the store."""
    found = versions(spark, path)
    used = {(n, v) for k in found[-keep:] for n, t in manifest(spark, path, k)["tables"].items() for vs in t["at"] for v in vs}
    gone = [f"{path}/_manifest/{k:012d}.json" for k in found[:-keep]]
    for n in manifest(spark, path)["tables"]:
        gone += [f"{path}/{n}/{f}" for f in _names(spark, f"{path}/{n}") if f.startswith("v=") and (n, f[2:]) not in used]
    for g in gone:
        fs, p = _fs(spark, g)
        fs.delete(p, True)
    return gone


def ingest(spark: SparkSession, path: str, docs: DataFrame, stream: str | None = None, batch: int | None = None, dim: int = 384, vault: bool = False) -> int | None:
    """Store documents (text, and title and project if they have them) that the store doesn't hold, with their chunks, a vector for each chunk and its postings, as one version.

    A document's id is its text's checksum. Only the ids of the buckets that
    the new ones fall into are read. Null and empty texts are documents without chunks;
    of equal texts one stays. Documents of a vault are kept out of the postings, and their chunks are blank.
    """
    from brindle.functions.scalars import checksum
    from brindle.operators.chunking import chunk
    from brindle.operators.hygiene import save_vault
    from brindle.operators.retrieval import postings
    from brindle.operators.vectors import hash_embed
    from brindle.session import stored

    if stream is not None and manifest(spark, path)["streams"].get(stream, -1) >= batch:
        return None
    some = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(checksum(text).alias("doc_id"), some("title").alias("title"), some("project").alias("project"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    rows = stored(rows.dropDuplicates(["doc_id"]), "batch")
    if manifest(spark, path)["version"] < 0:
        none = rows.limit(0)
        create(spark, path, {"documents": (none.drop("text"), "doc_id"), "chunks": (chunk(none), "doc_id"), "embeddings": (none.select("doc_id", F.lit(0).cast("long").alias("chunk_id"), F.array().cast("array<float>").alias("vector")), "doc_id"), "postings": (postings(none).withColumnRenamed("id", "chunk_id").withColumns({"chunk_id": F.lit(0).cast("long"), "doc_id": F.lit("")}), "doc_id")})
    known = read(spark, path, "documents", touched(spark, path, "documents", rows)).select("doc_id")
    new = stored(rows.join(known, "doc_id", "left_anti"), "new")
    chunks = stored(chunk(new), "chunks")
    owners = chunks.select("chunk_id", "doc_id")
    terms = postings(chunks.where(F.lit(not vault)), "chunk_id", "content").withColumnRenamed("id", "chunk_id")
    made = {
        "documents": new.drop("text"),
        "chunks": save_vault(chunks) if vault else chunks,
        "embeddings": chunks.select("doc_id", "chunk_id", hash_embed("content", dim).alias("vector")),
        "postings": terms.join(owners, "chunk_id"),
    }
    return change(spark, path, {n: Append(df) for n, df in made.items()}, stream, batch)
