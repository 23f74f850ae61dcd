"""Line deduplication across documents (operator 7): built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import WHITE, ascii_lower, stored

LAST = 2**63 - 1
LEAST_CHARS = 10
#: Rows of the sample that tells hot hashes.
SAMPLE = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hot_keepers(lines: DataFrame, parts: int) -> DataFrame:
    """(h, g, first): hashes that hold about 1 / (4 * parts) of all rows or more, so at most some 4 * parts, and the smallest document of each.

    A seeded sample finds them; the minimum is over all their rows and taken
    before the shuffle, so what the sample misses is merely not spread.
    """
    n = lines.count()
    every = max(1, n // SAMPLE)
    sample = lines.where(F.pmod(F.xxhash64("_id", "at", F.lit("hot")), F.lit(every)) == 0)
    hot = sample.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") > max(50, n // every // (4 * parts))).select("h", "g")
    return lines.join(F.broadcast(hot), ["h", "g"]).groupBy("h", "g").agg(F.min("_id").alias("first"))


def drop_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(_id, _text, _drop): for each document that loses lines, a map from 64-line block to the bits of the lines it loses.

    Only blocks and documents that lose something are there, so the bitmaps
    stay small. Texts are read once: the 128-bit hashes of the lines are
    stored, range-partitioned and sorted by hash, document and position; in
    that order the first document of each hash streams past its later ones.
    A hot hash is dealt over many ranges by document; its first document comes
    as a carry from `hot_keepers`, whichever range it lies in.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = own.select("_id", F.xxhash64("t").alias("_text"), F.posexplode(_lines(F.col("t"))).alias("at", "line"))
    keyed = rows.select("_id", "_text", "at", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key")).where(F.length("key") >= least_chars)
    lines = stored(keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "_id", "_text", "at"), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carried = lines.join(F.broadcast(hot_keepers(lines, parts)), ["h", "g"], "left")
    spread = F.when(F.col("first").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.lit(parts))).cast("int")
    ranged = carried.withColumn("s", spread).repartitionByRange("h", "g", "s")
    order = W.partitionBy("h", "g", "s").orderBy("_id", "at").rowsBetween(W.unboundedPreceding, 0)
    gone = ranged.withColumn("keeper", F.coalesce("first", F.first("_id").over(order))).where("_id > keeper")
    blocks = gone.groupBy("_id", "_text", F.expr("cast(at div 64 as int)").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
    return blocks.groupBy("_id", "_text").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("_drop"))


def with_unique_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    r"""(doc, n_lines, n_dropped, kept): doc is the row of docs as a struct, so no column name clashes; kept is its text without repeated lines.

    A line's key is the line without white space at its ends, A-Z lower-cased;
    keys of least_chars code points or more that several documents hold stay
    only in the smallest doc_id, there each time. Null and empty texts are one
    empty line. Rows without a doc_id count as one document after all others,
    rows that repeat a doc_id as one document; equal rows give equal rows. A
    text of any length is one row with a bit for each line; an empty table
    gives no rows.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(t).alias("_text"))
    out = keyed.join(drop_bitmaps(docs, least_chars), ["_id", "_text"], "left")
    kept = F.expr(r"array_join(filter(split(coalesce(doc.text, ''), '\n', -1), (l, i) -> (shiftright(coalesce(_drop[cast(i div 64 as int)], 0L), i % 64) & 1L) = 0L), '\n')")
    dropped = F.expr("aggregate(map_values(_drop), 0L, (n, b) -> n + bit_count(b))")
    t = F.coalesce(F.col("doc.text"), F.lit(""))
    return out.select(
        "doc",
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), t).otherwise(kept).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what stays of it, and n_chars to match where there is such a column. Documents of which only white space stays go, if they lost a line; null texts stay null."""
    text = F.when(F.col("doc.text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    some = with_unique_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(WHITE)) != ""))
    return some.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
