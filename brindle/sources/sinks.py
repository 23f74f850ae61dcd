"""Sinks: result envelopes and document files."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scalars import checksum, file_slug, project_dir
from brindle.session import stored

#: Files whose texts a task has as Python objects at once.
ROWS = 256


def results_json(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, total, results): results as a JSON array ordered by columns, from the bounded rows of each key that `top_k` leaves."""
    g = df.groupBy(key).agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))
    return g.select(key, "total", F.to_json("r").alias("results"))


def results_markdown(df: DataFrame) -> DataFrame:
    """Numbered Markdown sections from ideas (n, title, prompt, prompt_zh, image_urls, author, license, source_url, lang)."""
    prompt = F.when((F.col("lang") == "zh") & (F.coalesce("prompt_zh", F.lit("")) != ""), F.col("prompt_zh")).otherwise(F.col("prompt"))
    images = F.array_join(F.transform(F.coalesce("image_urls", F.array().cast("array<string>")), lambda u: F.concat(F.lit("![]("), u, F.lit(")"))), "\n")
    head = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")))
    meta = F.concat_ws(" · ", F.nullif("author", F.lit("")), F.nullif("license", F.lit("")), F.nullif("source_url", F.lit("")))
    return df.select("n", F.concat_ws("\n\n", head, F.concat(F.lit("```\n"), prompt, F.lit("\n```")), F.nullif(images, F.lit("")), F.nullif(meta, F.lit(""))).alias("markdown"))


def save_doc_files(df: DataFrame, path: str) -> None:
    """docs/<project or global>/<date>_<id>-<slug>.md, a file a document, under path (any URI that all tasks reach). Other files there stay; a task that is tried again writes the same files."""
    name = F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit("_"), F.substring("id", 1, 12), F.lit("-"), file_slug("title"), F.lit(".md"))
    project = F.when(F.coalesce("project", F.lit("")) == "", "global").otherwise(project_dir("project"))

    def put(batches):
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        for b in batches:
            for folder in set(b.column(0).to_pylist()):
                store.create_dir(f"{root}/{folder}", recursive=True)
            for folder, file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                # written aside and moved, so that nobody sees half a file
                made, part = f"{root}/{folder}/{file}", f"{root}/{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(text.as_py() or b"")
                store.move(part, made)
            yield b.slice(0, 0)

    rows = df.select(project.alias("project_dir"), name.alias("name"), "text")
    rows.mapInArrow(put, "project_dir string, name string, text string").write.format("noop").mode("append").save()


def load_doc_files(spark: SparkSession, path: str) -> DataFrame:
    """(project_dir, name, text) of what `save_doc_files` wrote."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    store = lambda: fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")

    def found(kind, folder):
        place, root = store()
        return [x.base_name for x in place.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))) if x.type == kind]

    def folders(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(found(fs.FileType.Directory, ""), pa.string())], ["project_dir"])

    def names(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                own = [n for n in found(fs.FileType.File, folder) if n.endswith(".md") and not n.startswith((".", "_"))]
                for at in range(0, len(own), ROWS):
                    part = own[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * len(part), pa.string()), pa.array(part, pa.string())], ["project_dir", "name"])

    def read(batches):
        place, root = store()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = []
                for folder, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    with place.open_input_stream(f"{root}/{folder}/{name}") as f:
                        texts.append(f.read())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["project_dir", "name", "content"])

    listed = spark.range(0, 1, 1, 1).mapInArrow(folders, "project_dir string").repartition(tasks, "project_dir").mapInArrow(names, "project_dir string, name string")
    # files are dealt by number: Spark's reader lists them all on the driver and gives a task a few small files
    raw = listed.repartition(tasks, "project_dir", "name").mapInArrow(read, "project_dir string, name string, content binary")
    return raw.select("project_dir", "name", F.decode("content", "UTF-8").alias("text"))


def reindex(saved: DataFrame, dim: int = 384) -> dict[str, DataFrame]:
    """documents (id, project, name, title, size), chunks and embeddings made anew from saved files (project_dir, name, text): the project is the folder, none for global, and the title what follows the first - of the name. A chunk's id is that of its file and its place, so documents of equal text have chunks of their own. Files are read, cut and embedded once, here; the tables are columns of what that wrote."""
    from brindle.operators.chunking import chunk_array
    from brindle.operators.vectors import hash_embed

    project = F.when(F.col("project_dir") == "global", "").otherwise(F.col("project_dir"))
    docs = saved.select(checksum("text").alias("id"), project.alias("project"), "name", F.octet_length("text").cast("long").alias("size"), chunk_array(F.col("text")).alias("all"))
    cuts = docs.select("*", F.explode_outer("all").alias("c")).drop("all").select("*", "c.*").drop("c")
    made = stored(cuts.withColumn("vector", hash_embed("content", dim)), "reindexed", compression="zstd")
    # a document without chunks has a row without a chunk
    first = made.where("coalesce(chunk_index, 0) = 0").withColumn("title", F.regexp_extract("name", r"(?s)^[^-]*-(.*)\.md$", 1))
    chunks = made.where("chunk_index is not null").withColumn("doc_id", F.concat("project", F.lit("/"), "name")).withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))
    return {"documents": first.select("id", "project", "name", "title", "size"), "chunks": chunks.select("doc_id", "chunk_id", "chunk_index", "heading", "content", "project", "name"), "embeddings": chunks.select("chunk_id", "vector", "project", "name")}
