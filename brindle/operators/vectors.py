"""Embeddings and exact vector search."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions.scalars import CJK, col
from brindle.operators.relational import scope
from brindle.sources.loaders import spread

#: Texts of an Arrow batch that are Python objects at once, and their characters unless one text has more.
ROWS, LETTERS = 256, 1 << 20
#: Constants of the hash embedding (fixed values): FNV-1a and splitmix64.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GAMMA, MIX1, MIX2, SEED = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 42


def fnv(state: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each state carried on over `size` bytes of raw from `at`."""
    # longest first, so that a step touches only those that go on
    order = np.argsort(size.max(initial=0) - size, kind="stable")
    h, at, left = state[order], at[order], np.sort(size)
    for j in range(left.max(initial=0)):
        n = len(left) - np.searchsorted(left, j, side="right")
        h[:n] = (h[:n] ^ raw[at[:n] + j]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def components(state: np.ndarray, dim: int) -> np.ndarray:
    """A row of components in -3..1 for each state: remainders keep the sign."""
    z = (state ^ np.uint64(SEED))[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(GAMMA)
    for shift, mix in ((30, MIX1), (27, MIX2)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(mix)
    z ^= z >> np.uint64(31)
    return np.fmod(z.view(np.int64), 3) - 1


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, with where each starts and how long it is."""
    data = values.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2] or b"", np.uint8), at[:-1], np.diff(at)


def gram_states(grams: list[str]) -> np.ndarray:
    raw, at, size = flat(pa.array(grams, pa.string()))
    return fnv(np.full(len(grams), FNV_START, np.uint64), raw, at, size)


def gram_vectors(grams: list[str], dim: int) -> np.ndarray:
    """A row of components for each n-gram."""
    return components(gram_states(grams), dim)


def mostly_cjk(t: str) -> bool:
    return not t.isascii() and len(re.findall(CJK, t)) > len(t) // 2


def words_of(t: str) -> list[str]:
    return re.findall(r"[\w'-]+", t.replace("_", " "))


def cjk_grams(t: str) -> list[str]:
    skip = lambda c: c.isspace() or unicodedata.category(c).startswith("P")
    return list(dict.fromkeys(t[i : i + k] for i in range(len(t)) if not skip(t[i]) for k in (1, 2, 3) if i + k <= len(t)))


def text_grams(text: str | None) -> list[str]:
    """What `embedding_ngrams` gives, in Python."""
    t = (text or "").strip().lower()
    if mostly_cjk(t):
        return cjk_grams(t)
    w = words_of(t)
    return list(dict.fromkeys(g for i, x in enumerate(w) if len(x.encode()) > 2 for g in (x, *(f"{x} {y}" for y in w[i + 1 : i + 2]))))


def word_states(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(list, state) of the distinct n-grams of lists of words; a pair's state goes on from that of its first word."""
    own = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    made = pa.array([x for w in lists for x in w], pa.string()).dictionary_encode()
    word, n = made.indices.to_numpy().astype(np.int64), len(made.dictionary)
    raw, at, size = flat(made.dictionary)
    single = fnv(np.full(n, FNV_START, np.uint64), raw, at, size)
    starts = size[word] > 2
    one = np.flatnonzero(starts)
    one = one[~pd.Series(own[one] * n + word[one]).duplicated().to_numpy()]
    two = np.flatnonzero(starts[:-1] & (own[:-1] == own[1:]))
    two = two[~pd.Series((own[two] * n + word[two]) * n + word[two + 1]).duplicated().to_numpy()]
    then = word[two + 1]
    pair = fnv((single[word[two]] ^ np.uint64(32)) * np.uint64(FNV_PRIME), raw, at[then], size[then])
    return np.concatenate([own[one], own[two]]), np.concatenate([single[word[one]], pair])


def totals(own: np.ndarray, state: np.ndarray, n: int, dim: int) -> np.ndarray:
    """The sum of the components of the states of each of n texts."""
    out, rows = np.zeros((n, dim), np.int64), max(1, (1 << 16) // dim)
    for at in range(0, len(own), rows):
        part = own[at : at + rows]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        np.add.at(out, part[first], np.add.reduceat(components(state[at : at + rows], dim), first, axis=0))
    return out


def few(texts: list[str | None]):
    """Runs of texts, stripped and in small letters, of at most ROWS texts and LETTERS characters unless one text has more."""
    run, size = [], 0
    for text in texts:
        t = (text or "").strip().lower()
        if run and (len(run) == ROWS or size + len(t) > LETTERS):
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def embedded(texts: pd.Series, dim: int) -> pd.Series:
    out = []
    for run in few(texts):
        cjk = [mostly_cjk(t) for t in run]
        total = totals(*word_states([[] if c else words_of(t) for t, c in zip(run, cjk, strict=True)]), len(run), dim)
        for i in np.flatnonzero(cjk):
            state = gram_states(cjk_grams(run[i]))
            total[i] = totals(np.zeros(len(state), np.int64), state, 1, dim)[0]
        norm = np.sqrt((total * total).sum(axis=1))[:, None]
        out.extend(np.divide(total, norm, out=np.zeros(total.shape), where=norm > 0).astype(np.float32))
    return pd.Series(out, dtype=object)


def hash_embed(text, dim: int = 384) -> Column:
    """Unit vector of a text: the sum of the vectors of its distinct n-grams."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return embedded(texts, dim)

    return embed(col(text))


def embed_texts(df: DataFrame, key: str, text: str, dim: int = 384, vector: str = "vector") -> DataFrame:
    """(key, vector): hash_embed as a step of its own, for frames whose vectors then go into higher-order functions."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                made = embedded(pd.Series(part.column(1).to_pylist(), dtype=object), dim)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(list(made), pa.list_(pa.float32()))], [key, vector])

    return spread(df.select(key, text)).mapInArrow(run, f"{key} long, {vector} array<float>")


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """In double precision; 0 for a zero vector."""
    a, b = doubles(a), doubles(b)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalize(v) -> Column:
    v = doubles(v)
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def _packed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(ids, units): unit vectors of up to `rows` rows of a partition, by id, as bytes of 64-bit numbers; no shuffle."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
                order = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([ids[order].tobytes()], pa.binary()), pa.array([v[order].tobytes()], pa.binary())], ["ids", "units"])

    rows_of = df.select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows_of.mapInArrow(run, "ids binary, units binary")


def _nearest(q: np.ndarray, y: np.ndarray, c: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """(qid, id, score): the k best of x (by id) for each row of y; of equal scores the least ids."""
    s = y @ x.T
    r = np.round(s, 12)
    k = min(k, len(c))
    least = np.partition(r, -k, axis=1)[:, -k][:, None]
    above, level = r > least, r == least
    level &= level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)
    i, j = np.nonzero(above | level)
    return pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(c[j]), pa.array(s[i, j])], ["qid", "id", "score"])


#: Blocks of queries whose best rows a task holds at once, and candidates of a product that are worked out exactly at once.
HELD, EXACT = 32, 1 << 16


class Best:
    """The k best rows of each query of a block, over blocks of a corpus in any order; with least, only those of at least that score.

    Products are in single precision; what they can't rule out against the k-th score so far is worked out in double precision.
    """

    def __init__(self, q: np.ndarray, y: np.ndarray, k: int, least: np.ndarray | None = None):
        self.q, self.y, self.k = q.copy(), y.copy(), k
        self.single, self.slack = self.y.astype(np.float32), 2.0**-22 * (y.shape[1] + 8)
        self.floor = np.full(len(q), -np.inf) if least is None else least.copy()
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, c: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Meet a block (ids, unit vectors); with rows, of these queries only."""
        rows = np.arange(len(self.q)) if rows is None else rows
        known = self.floor[rows] > -np.inf
        at = rows[known]
        i = j = np.empty(0, np.int64)
        if len(at):
            near = self.single[at] @ x.T.astype(np.float32) >= (self.floor[at] - self.slack).astype(np.float32)[:, None]
            if np.count_nonzero(near) > 4 * self.k * len(at):
                known = np.zeros(len(rows), bool)  # many equal vectors: cut to k at once
            else:
                i, j = np.nonzero(near)
                i = at[i]
        if not known.all():
            new = rows[~known]
            got = _nearest(new, self.y[new], np.arange(len(c)), x, self.k)
            self._keep(got.column(0).to_numpy(), c[got.column(1).to_numpy()], got.column(2).to_numpy())
        for lo in range(0, len(i), EXACT):
            a, b = i[lo : lo + EXACT], j[lo : lo + EXACT]
            self._keep(a, c[b], np.einsum("ij,ij->i", self.y[a], x[b]))
        if self.n > 3 * self.k * len(self.q) or not known.all():
            self._cut()

    def _keep(self, i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        some = np.round(s, 12) >= self.floor[i]
        self.kept.append((i[some], ids[some], s[some]))
        self.n += int(some.sum())

    def _cut(self) -> None:
        if not self.kept:
            return
        i, ids, s = (np.concatenate(v) for v in zip(*self.kept, strict=True))
        r = np.round(s, 12)
        order = np.lexsort((ids, -r, i))
        i, ids, s, r = i[order], ids[order], s[order], r[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.floor[i[last]] = np.maximum(self.floor[i[last]], r[last])
        some = place < self.k
        self.kept, self.n = [(i[some], ids[some], s[some])], int(some.sum())

    def rows(self) -> pa.RecordBatch:
        """(qid, id, score)"""
        self._cut()
        i, ids, s = self.kept[0] if self.kept else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(self.q[i]), pa.array(ids), pa.array(s)], ["qid", "id", "score"])


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, block: int = 1024, project: str = "", project_col: str = "project") -> DataFrame:
    """(qid, id, score, rank): exact cosine top k of corpus (id, vector) for queries (qid, vector); with a project, of the vectors of that project ('global': of none) alone.

    Both sides are packed into blocks of at most `block` vectors; each pair of
    blocks is one product of matrices, and a task passes on k rows a query for all
    blocks that it meets, however many vectors are equal. The planner broadcasts a side only if its size
    allows it. Rows without id or vector are left out.
    """

    def best(batches):
        held: dict[tuple[bytes, int], Best] = {}
        for b in batches:
            for row in zip(*b.columns, strict=True):
                own = (row[0].as_py(), hash(row[1].as_py()))
                if own not in held:
                    q = np.frombuffer(row[0].as_buffer(), np.int64)
                    if len(held) == HELD:
                        yield held.pop(next(iter(held))).rows()
                    held[own] = Best(q, np.frombuffer(row[1].as_buffer()).reshape(len(q), -1), k)
                c = np.frombuffer(row[2].as_buffer(), np.int64)
                held[own].add(c, np.frombuffer(row[3].as_buffer()).reshape(len(c), -1))
        for top in held.values():
            yield top.rows()

    asked = _packed(queries, "qid", block).withColumnsRenamed({"ids": "qids", "units": "qunits"})
    # blocks of queries dealt evenly, so that products keep all cores busy however few files they come from
    asked = asked.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
    near = asked.crossJoin(_packed(scope(corpus, project, project_col), "id", block)).mapInArrow(best, "qid long, id long, score double")
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Vectors of a group that meet others of it in one product, and copies of a group's queries at most, one for each share of its blocks.
GROUPED, COPIES = 512, 32


def _grouped(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """(group, slot, copies, name): the vectors (key, vector) of each group in blocks of about GROUPED, and how many shares its blocks are dealt to."""
    rows = df.select(group, F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("v")).where(F.col(group).isNotNull())
    slots = F.ceil(F.col("n") / GROUPED)
    dealt = rows.join(rows.groupBy(group).agg(F.count("*").alias("n")), group).withColumns({"slot": F.pmod(F.xxhash64("id"), slots), "copies": F.least(slots, F.lit(COPIES))})
    return dealt.groupBy(group, "slot", "copies").agg(F.collect_list(F.struct("id", "v")).alias(name))


def _parted(block) -> list[tuple[pa.Array, np.ndarray | None]]:
    """(ids, unit vectors) of a block by the length of its vectors; None for those without one."""
    ids, v = block.field("id"), block.field("v")
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(size):
        at = pa.array(np.flatnonzero(size == n))
        x = v.take(at).flatten()
        if n < 0 or x.null_count:  # a vector with an empty place has no angle
            some = np.zeros(len(at), bool) if n < 0 else np.array([None not in r for r in v.take(at).to_pylist()])
            out.append((ids.take(at.filter(pa.array(~some))), None))
            at = at.filter(pa.array(some))
            x = v.take(at).flatten()
        if len(at):
            x = x.to_numpy(zero_copy_only=False).reshape(len(at), n)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            out.append((ids.take(at), np.where(norm == 0, 0.0, x / np.where(norm == 0, 1.0, norm))))
    return out


def _products(y: np.ndarray | None, x: np.ndarray | None, n: int) -> pa.Array:
    """The n products of rows of y and x; of different lengths, 0 for a zero vector and else null."""
    if y is None or x is None:
        return pa.nulls(n, pa.float64())
    if y.shape[1] == x.shape[1]:
        return pa.array((y @ x.T).ravel())
    return pa.array(np.zeros(n), mask=(y.any(axis=1)[:, None] & x.any(axis=1)).ravel())


def cosine_within(a: DataFrame, b: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """(left, right, cosine) of all pairs of a row of a (left, group, vector), a stated query set, and one of b (right, group, vector) of equal group; 0 for a zero vector, else null where one is missing or they differ in length.

    The groups' blocks of vectors meet as products of matrices; a large group's blocks are dealt to many tasks, each with a copy of its queries.
    """
    corpus = _grouped(b, group, right, "xs").withColumn("share", F.pmod("slot", "copies")).drop("slot")
    shares = corpus.select(group, "copies").distinct()
    # a number of tasks of its own: the planner would tell it from the vectors' bytes, which are few beside the pairs
    corpus = corpus.repartition(4 * b.sparkSession.sparkContext.defaultParallelism, group, "share")
    asked = _grouped(a, group, left, "ys").drop("slot", "copies").join(shares, group)
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1))).drop("copies")

    def run(batches):
        for batch in batches:
            for ys, xs in zip(batch.column("ys"), batch.column("xs"), strict=True):
                for i, y in _parted(ys.values):
                    for j, x in _parted(xs.values):
                        own, other = np.repeat(np.arange(len(i)), len(j)), np.tile(np.arange(len(j)), len(i))
                        yield pa.RecordBatch.from_arrays([i.take(pa.array(own)), j.take(pa.array(other)), _products(y, x, len(own))], [left, right, "cosine"])

    kinds = f"{left} {a.schema[left].dataType.simpleString()}, {right} {b.schema[right].dataType.simpleString()}, cosine double"
    return asked.join(corpus.drop("copies"), [group, "share"]).select("ys", "xs").mapInArrow(run, kinds)


def mean_embedding(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): element-wise mean; sums are taken before the shuffle."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def mean_pool(vectors, mask) -> Column:
    """Normalised mean of those of an array of vectors whose mask is not 0."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m != 0, v)), lambda v: v.isNotNull())
    zero = F.transform(doubles(F.element_at(vectors, 1)), lambda x: x * 0)
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return l2_normalize(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def hybrid_fuse(fts: DataFrame, vec: DataFrame, limit: int, min_score: float = 0.8) -> DataFrame:
    """(qid, id, score, rank) from full-text ranks (qid, id, rank from 1) and vector scores (qid, id, score)."""
    f = fts.select("qid", "id", ((F.lit(limit) - (F.col("rank") - 1)) / F.lit(float(limit))).alias("f"))
    v = vec.select("qid", "id", F.col("score").alias("v"))
    both = f.join(v, ["qid", "id"], "full_outer")
    score = F.when(F.col("f").isNotNull() & F.col("v").isNotNull(), F.greatest("f", "v") + 0.2).when(F.col("f").isNotNull(), F.col("f")).when(F.col("v") >= min_score, F.col("v") * 0.5)
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")  # sums of floats differ in their last digits
    return both.select("qid", "id", score.alias("score")).where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rollup_docs(results: DataFrame, limit: int) -> DataFrame:
    """(qid, doc, score, n_chunks, first_chunk, rank) from chunk results (qid, doc, chunk, score, rank)."""
    g = results.groupBy("qid", "doc").agg(F.max("score").alias("score"), F.count("*").alias("n_chunks"), F.min_by("chunk", "rank").alias("first_chunk"))
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "doc")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rerank(results: DataFrame, scorer: Column | None, k: int) -> DataFrame:
    """results with the scorer's score where it is a number, cut to k a query; unchanged without a scorer."""
    if scorer is None:
        return results
    ok = scorer.isNotNull() & ~F.isnan(scorer) & (F.abs(scorer) != float("inf"))
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return results.withColumn("score", F.when(ok, scorer).otherwise(F.col("score"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vec_to_blob(v) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return run(v)


def blob_to_vec(b) -> Column:
    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))

    return run(b)
