"""Exact vector search that skips blocks by the triangle inequality of angles.

A few vectors of the corpus are pivots. Vectors of one pivot and of like angle
to it share a block, so a query's angle to the pivot bounds its angle to all
of them: a block is multiplied with the queries alone that it could still serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.operators.relational import scope
from brindle.operators.vectors import HELD, Best
from brindle.session import stored

PIVOTS, BLOCK = 64, 1024
#: Slack of the bounds, in cosine: angles of like vectors are told to about 1e-8.
SLACK = 1e-6
BLOCKS = "pivot int, lo double, hi double, n int, ids binary, units binary"
RESULT = "qid long, id long, score double"


def unit_rows(column: pa.Array, n: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def pivots_of(corpus: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """n vectors of corpus (id, vector) by a hash of the id, as unit rows."""
    rows = corpus.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(n).select("vector").collect()
    v = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def blocked(vectors: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """BLOCKS of vectors (id, vector): up to `block` of one pivot, next to each other by angle. Range partitions, so a pivot with a third of all vectors spreads over many tasks."""

    def placed(batches):
        for b in batches:
            if b.num_rows:
                x = unit_rows(b.column(1), b.num_rows)
                a = angles(x, pivots)
                near = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(a[np.arange(len(a)), near]), b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["pivot", "angle", "id", "unit"])

    def packed(batches):
        for b in batches:
            pivot, angle, ids = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(pivot)) + 1
            rows = []
            for part in np.split(np.arange(len(pivot)), cuts):
                for at in range(0, len(part), block):
                    own = part[at : at + block]
                    order = own[np.argsort(ids[own], kind="stable")]
                    units = b.column(3).take(pa.array(order))
                    rows.append((int(pivot[own[0]]), float(angle[own].min()), float(angle[own].max()), len(own), ids[order].astype(np.int64).tobytes(), b"".join(u.as_py() for u in units)))
            if rows and len(pivot):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["pivot", "lo", "hi", "n", "ids", "units"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.mapInArrow(placed, "pivot int, angle double, id long, unit binary")
    return rows.repartitionByRange("pivot", "angle").sortWithinPartitions("pivot", "angle").mapInArrow(packed, BLOCKS)


def grouped(batches, sizes: str, wholes: list[str], most: int):
    """Rows of small blocks as rows of up to `most` vectors: binary columns are joined, and the numbers of each block (all other columns) become bytes."""
    for b in batches:
        n = b.column(sizes).to_numpy()
        part = np.cumsum(n) // most
        for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1) if len(n) else []:
            t = b.slice(int(own[0]), len(own))
            made = [b"".join(v.as_py() for v in t.column(c)) if c in wholes else t.column(c).to_numpy().tobytes() for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in made], b.schema.names)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 20, block: int = BLOCK, pivots: int = PIVOTS, project: str = "", project_col: str = "project", seen: dict | None = None) -> DataFrame:
    """(qid, id, score, rank): what `vector_topk` gives, with blocks skipped.

    Each block of queries first meets the blocks of its own pivot that are next to it, as many as hold
    2 * k vectors. The k-th score of each query so far, and of all that a task has
    seen since, then tells which blocks, and which queries, are multiplied. Pairs of blocks are never stored: what is written and shuffled is in proportion
    to the vectors. Query ids are distinct; rows without id or vector are left out. seen, if given, receives the number of pairs of blocks and of those that are multiplied.
    """
    spark = queries.sparkSession
    own = scope(corpus, project, project_col).select("id", "vector").where("id is not null and vector is not null")
    p = pivots_of(own, pivots)
    if not len(p):
        return spark.createDataFrame([], RESULT + ", rank int")
    blocks = stored(blocked(own, p, block).withColumn("b", F.monotonically_increasing_id()), "vector-blocks")
    asked = stored(blocked(queries.select(F.col("qid").alias("id"), "vector"), p, block).withColumn("q", F.monotonically_increasing_id()), "query-blocks")

    gap = F.greatest(F.col("b.lo") - F.col("a.hi"), F.col("a.lo") - F.col("b.hi"), F.lit(0.0))
    close = asked.select("q", "pivot", "lo", "hi").alias("a").join(blocks.select("b", "pivot", "lo", "hi", "n").alias("b"), "pivot").select("q", "b", "n", gap.alias("gap"))
    before = F.sum("n").over(W.partitionBy("q").orderBy("gap", "b").rowsBetween(W.unboundedPreceding, -1))
    first = close.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * k).select("q", "b")
    # at most 2 * k blocks each
    met = first.join(blocks.select("b", "ids", "units"), "b").groupBy("q").agg(F.collect_list(F.struct("ids", "units")).alias("near"))
    ready = asked.select("q", F.col("ids").alias("qids"), F.col("units").alias("qunits"), F.col("n").alias("qn")).join(met, "q", "left")

    def floors(batches):
        for b in batches:
            made = []
            for qids, qunits, near in zip(b.column("qids"), b.column("qunits"), b.column("near"), strict=True):
                q = np.frombuffer(qids.as_buffer(), np.int64)
                top = Best(q, np.frombuffer(qunits.as_buffer()).reshape(len(q), -1), k)
                for x in near.as_py() or []:
                    c = np.frombuffer(x["ids"], np.int64)
                    top.add(c, np.frombuffer(x["units"]).reshape(len(c), -1))
                made.append((top.floor - 1e-9).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("qids"), b.column("qunits"), b.column("qn"), pa.array(made, pa.binary())], ["qids", "qunits", "qn", "least"])

    ready = ready.mapInArrow(floors, "qids binary, qunits binary, qn int, least binary")
    ready = ready.mapInArrow(lambda batches: grouped(batches, "qn", ["qids", "qunits", "least"], BLOCK), "qids binary, qunits binary, qn binary, least binary")
    ready = stored(ready, "query-groups").repartition(2 * spark.sparkContext.defaultParallelism)
    groups = stored(blocks.drop("b").mapInArrow(lambda batches: grouped(batches, "n", ["ids", "units"], BLOCK), "pivot binary, lo binary, hi binary, n binary, ids binary, units binary"), "vector-groups")
    multiplied = spark.sparkContext.accumulator(0)

    def best(batches):
        held: dict[bytes, tuple[Best, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row in zip(*b.columns, strict=True):
                qids = row[0].as_py()
                if qids not in held:
                    q, qn = np.frombuffer(qids, np.int64), np.frombuffer(row[2].as_buffer(), np.int32)
                    y = np.frombuffer(row[1].as_buffer()).reshape(len(q), -1)
                    if len(held) == HELD:
                        yield held.pop(next(iter(held)))[0].rows()
                    held[qids] = Best(q, y, k, np.frombuffer(row[3].as_buffer())), angles(y, p), np.cumsum(qn) - qn
                top, a, starts = held[qids]
                pivot, n = (np.frombuffer(row[at].as_buffer(), np.int32) for at in (4, 7))
                lo, hi = (np.frombuffer(row[at].as_buffer()) for at in (5, 6))
                c = np.frombuffer(row[8].as_buffer(), np.int64)
                x = np.frombuffer(row[9].as_buffer()).reshape(len(c), -1)
                mine = a[:, pivot]
                could = np.cos(np.clip(np.maximum(mine - hi, lo - mine), 0, np.pi)) + SLACK >= top.floor[:, None]
                multiplied.add(int(np.logical_or.reduceat(could, starts, axis=0).sum()))
                if could.mean() > 0.5:
                    top.add(c, x)
                    continue
                at = 0
                for i, size in enumerate(n):
                    some = np.flatnonzero(could[:, i])
                    if len(some):
                        top.add(c[at : at + size], x[at : at + size], some)
                    at += size
        for top, _, _ in held.values():
            yield top.rows()

    every = ready.crossJoin(groups).mapInArrow(best, RESULT)
    if seen is not None:
        every = stored(every, "nearest")
        seen.update(pairs=asked.count() * blocks.count(), multiplied=multiplied.value)
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
