"""Heading-aware chunking of Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.sources.loaders import spread

HEADING = re.compile(r"#{1,6} ")
#: Texts of an Arrow batch that are Python objects at once.
ROWS = 256
PIECE = pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string())]))
CHUNK = pa.list_(pa.struct([("chunk_index", pa.int32()), ("heading", pa.string()), ("content", pa.string())]))
CHUNKS = "array<struct<chunk_index:int,heading:string,content:string>>"


def in_parts(values: pa.Array, kind: pa.DataType, f: Callable) -> pa.Array:
    """f of each value, a few at a time as Python objects."""
    made = [pa.array([f(v) for v in values.slice(at, ROWS).to_pylist()], kind) for at in range(0, len(values), ROWS)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def split_sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, heading, content): heading lines outside fences start sections; as window functions over lines."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).withColumn("t", F.trim("line"))
    w = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("fenced", F.sum(F.col("t").startswith("```").cast("int")).over(w) % 2 == 1)
    is_head = F.col("t").rlike("^#{1,6} ")
    start = ~F.col("fenced") & is_head
    lines = lines.withColumn("section", F.sum(start.cast("int")).over(w)).withColumn("starts", start)
    body = F.when(F.col("starts"), F.col("t")).otherwise(F.col("line"))
    names = F.min(F.when(is_head, F.struct("at", "t")))
    parts = lines.groupBy(key, "section").agg(names.alias("h"), F.array_sort(F.collect_list(F.struct("at", body.alias("l")))).alias("ls"))
    return parts.select(key, "section", F.coalesce("h.t", F.lit("")).alias("heading"), F.concat(F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")).alias("content"))


def sections_of(text: str) -> list[tuple[str, str]]:
    out, head, body, fenced = [], "", [], False
    for line in text.split("\n"):
        t = line.strip()
        fenced ^= t.startswith("```")
        named = bool(HEADING.match(t))
        if named and not fenced:
            if body:
                out.append((head, "".join(body)))
            head, body = t, [t + "\n"]
            continue
        if named and not head:
            head = t
        body.append(line + "\n")
    return [*out, (head, "".join(body))] if body else out


def pieces_of(head: str, content: str, most: int, overlap: int) -> list[tuple[str, str]]:
    """A section of at most `most` bytes as it is; a longer one in pieces of about that, each after its heading: cut at a blank line, a full stop, a line break or, backed up to a character, anywhere."""
    b, out = content.encode(), []
    if len(b) <= most:
        return [(head, content)]
    while len(b) > most:
        at = max(1, most - overlap) if overlap > 0 else most
        if (p := b.rfind(b"\n\n", 0, at)) > most // 2:
            at = p
        elif (p := b.rfind("。".encode(), 0, at)) > most // 2:
            at = p + 3
        elif (p := b.rfind(b"\n", 0, at)) > most // 3:
            at = p
        while at > 1 and b[at] & 0xC0 == 0x80:
            at -= 1
        out.append((head, f"{head}\n\n{b[:at].decode()}"))
        back = at - overlap
        if back <= 0:
            back = at
        while back < at and b[back] & 0xC0 == 0x80:
            back += 1
        b = b[back:]
    if b:
        out.append((head, f"{head}\n\n{b.decode()}"))
    return out


def merged(pieces: list[tuple[str, str]], most: int) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for head, text in pieces:
        if out and len(out[-1][1].encode()) + len(text.encode()) < most // 2:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + text)
        else:
            out.append((head, text))
    return out


def chunks_of(text: str | None, most: int = 2048, overlap: int = 128) -> list[tuple[int, str, str]]:
    """(number, heading, content) of the chunks of a text, none for null and ''. Without an overlap small ones are left alone."""
    parts = [p for head, content in sections_of(text) for p in pieces_of(head, content, most, overlap)] if text else []
    return [(i, h, c) for i, (h, c) in enumerate(merged(parts, most) if overlap > 0 else parts)]


def chunk_array(text: Column, most: int = 2048, overlap: int = 128) -> Column:
    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array) -> pa.Array:
        return in_parts(texts, CHUNK, lambda t: [{"chunk_index": i, "heading": h, "content": c} for i, h, c in chunks_of(t, most, overlap)])

    return run(text)


def chunk(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2048, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, heading, content) of each document."""
    rows = spread(df.select(key, text)).select(F.col(key).alias("doc_id"), F.explode(chunk_array(F.col(text), most, overlap)).alias("c"))
    return rows.select("doc_id", F.xxhash64("doc_id", "c.chunk_index").alias("chunk_id"), "c.chunk_index", "c.heading", "c.content")


PIECES = "array<struct<heading:string,content:string>>"


def split_large(heading, content, most: int = 2048, overlap: int = 128) -> Column:
    """The pieces of a section."""

    @F.pandas_udf(PIECES)
    def run(heads: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([[{"heading": h, "content": c} for h, c in pieces_of(head or "", body or "", most, overlap)] for head, body in zip(heads, contents, strict=True)])

    return run(heading, content)


def merge_small(pieces, most: int = 2048) -> Column:
    """Pieces in order, joined while both together are shorter than half of `most`; the first heading stays."""

    @F.arrow_udf(PIECES)
    def run(all_pieces: pa.Array) -> pa.Array:
        return in_parts(all_pieces, PIECE, lambda ps: [{"heading": h, "content": c} for h, c in merged([(p["heading"], p["content"]) for p in ps or []], most)])

    return run(pieces)
