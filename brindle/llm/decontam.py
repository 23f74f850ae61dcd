"""Benchmark decontamination by greedy string tiling (operator 10)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shingles import runs, word_hashes

#: A-Z lower-cased, ASCII that is neither letter nor digit to blanks; other bytes stay.
NORMAL = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
KR = np.uint64(0x100000001B3)
KR_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))


@dataclass(frozen=True)
class Tiling:
    """words: of a seed, and of the shortest tile. coverage: share of a test item's words that tiles must cover. most_bytes: the benchmark is sent to all tasks up to this size, beyond it the seeds are joined by a shuffle."""

    words: int = 5
    coverage: float = 0.8
    most_bytes: int = 16 << 20


def tokens(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").translate(NORMAL))


class Rolling:
    """Running Karp-Rabin hashes of a row of tokens: prefix hashes give that of any window by one product, modulo 2 ** 64."""

    def __init__(self, x: np.ndarray):
        self.x, self.free = x, np.ones(len(x), bool)
        self.power = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(x), KR))))
        # the prefix hash of i tokens is sum of x[j] * KR ** (i - 1 - j); with powers of the inverse that is a running sum
        down = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(x), KR_INVERSE))))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * down[1:], dtype=np.uint64))) * self.power
        self.used()

    def used(self) -> None:
        self.taken = np.concatenate(([0], np.cumsum(~self.free)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the unmarked windows of n tokens, and where they start."""
        if len(self.x) < n:
            return self.x[:0], np.zeros(0, np.intp)
        at = np.flatnonzero(self.taken[n:] == self.taken[: len(self.taken) - n])
        return self.prefix[at + n] - self.prefix[at] * self.power[n], at

    def mark(self, at: int, n: int) -> None:
        self.free[at : at + n] = False


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length): the longest common run of unmarked tokens is marked in both, again and again until none has `least` tokens; of equal ones that first in item, then in doc."""
    a, b, found = Rolling(item), Rolling(doc), []
    longest = min(len(item), len(doc))
    while True:
        lo, hi = least - 1, longest
        while lo < hi:  # a longer common run holds the shorter ones
            n = (lo + hi + 1) // 2
            if np.isin(a.windows(n)[0], b.windows(n)[0]).any():
                lo = n
            else:
                hi = n - 1
        if lo < least:
            return found
        (ha, at_a), (hb, at_b) = a.windows(lo), b.windows(lo)
        met = np.isin(ha, hb)
        order = np.argsort(hb, kind="stable")
        sorted_b = hb[order]
        for h, i in zip(ha[met], at_a[met], strict=True):
            if not a.free[i : i + lo].all():
                continue
            for k in range(np.searchsorted(sorted_b, h, "left"), np.searchsorted(sorted_b, h, "right")):
                d = at_b[order[k]]
                if b.free[d : d + lo].all() and (item[i : i + lo] == doc[d : d + lo]).all():
                    a.mark(i, lo)
                    b.mark(d, lo)
                    found.append((int(i), int(d), lo))
                    break
        a.used()
        b.used()
        longest = lo - 1  # all runs of lo tokens are marked; equal hashes of unlike runs are left behind


class Benchmark:
    """Test items with an index from seed to items."""

    def __init__(self, items: list[tuple[int, bytes]], how: Tiling):
        self.how = how
        kept = [(k, tokens(t)) for k, t in items]
        self.items = [(k, t) for k, t in kept if len(t) >= how.words]
        seeds = [runs(t, how.words) for _, t in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        joined = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.seeds, self.owner = joined[order], owner[order]
        # by the low bits: most of a document's seeds are ruled out by one look-up
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(joined & np.uint64((1 << 20) - 1)).astype(np.intp)] = True

    def matches(self, text: bytes | None) -> list[tuple[int, float, int]]:
        """(item_id, coverage, number of tiles) of the items that text holds."""
        doc = tokens(text)
        if len(doc) < self.how.words or not len(self.seeds):
            return []
        own = runs(doc, self.how.words)
        own = np.unique(own[self.bits[(own & np.uint64((1 << 20) - 1)).astype(np.intp)]])
        lo, hi = np.searchsorted(self.seeds, own, "left"), np.searchsorted(self.seeds, own, "right")
        met = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True) if b > a] or [np.zeros(0, np.intp)]))
        return [m for i in met if (m := covered(self.items[i][0], self.items[i][1], doc, own, self.how))]


def covered(item_id: int, item: np.ndarray, doc: np.ndarray, own_seeds: np.ndarray, how: Tiling) -> tuple[int, float, int] | None:
    """The match if tiles cover enough of item. What no shared seed covers no tile can, so most pairs need no tiling."""
    shared = np.flatnonzero(np.isin(runs(item, how.words), own_seeds))
    can = np.zeros(len(item), bool)
    for j in range(how.words):
        can[shared + j] = True
    if can.sum() < how.coverage * len(item):
        return None
    found = tiles(item, doc, how.words)
    share = sum(n for _, _, n in found) / len(item)
    return (item_id, share, len(found)) if share >= how.coverage else None


def _bounded(benchmark: DataFrame, how: Tiling) -> Benchmark | None:
    """The whole benchmark, if its size allows."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > how.most_bytes:
        return None
    return Benchmark(sorted((r[0], r[1].encode()) for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").collect()), how)


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Tiling = Tiling()) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles): the documents that hold test items, and which.

    docs has (doc_id, text), benchmark (item_id, text). Words are compared
    without case (A-Z) and ASCII punctuation. A document and an item that share a run of
    `words` words are tiled: the longest common runs are marked until none of
    `words` is left, in whatever order they stand, of equal runs that first
    in the item and then in the document, and the tiles
    must cover `coverage` of the item. Texts are tiled whole, however long.
    Items and documents of fewer words, null texts and null item ids
    match nothing; repeated rows give repeated matches, a null doc_id a match without an id. An empty table gives no rows. Further columns, whatever their names, are left alone.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = _bounded(benchmark, how)
    if known is None:
        return _by_shuffle(own, benchmark, how)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            rows = [(k, *m) for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True) for m in sent.value.matches(t.as_py())]
            yield _matches(rows)

    return own.mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles int")


def _matches(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["doc_id", "item_id", "coverage", "n_tiles"])


def _by_shuffle(own: DataFrame, benchmark: DataFrame, how: Tiling) -> DataFrame:
    """For a benchmark of any size: seeds are joined, then the pairs that share enough of them are tiled."""

    def seeds(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                x = tokens(t.as_py())
                s = np.unique(runs(x, how.words)) if len(x) >= how.words else x[:0]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.repeat(k, len(s)).cast(pa.int64())], ["seed", "id"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    keyed = own.where("text is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    a = items.mapInArrow(seeds, "seed long, id long").withColumnRenamed("id", "item_id")
    d = keyed.select("row", "text").mapInArrow(seeds, "seed long, id long").withColumnRenamed("id", "row")
    pairs = d.join(a, "seed").select("row", "item_id").distinct()

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, item_id, item in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), b.column(3).cast(pa.binary()), strict=True):
                doc, other = tokens(text.as_py()), tokens(item.as_py())
                if m := covered(item_id, other, doc, np.unique(runs(doc, how.words)), how):
                    rows.append((doc_id, *m))
            yield _matches(rows)

    return pairs.join(keyed, "row").join(items, "item_id").select("doc_id", "text", "item_id", "item_text").mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles int")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, how: Tiling = Tiling()) -> DataFrame:
    """The documents that hold no test item; all columns of docs.

    Each row stays or goes by its own text, whatever its id, with a benchmark
    of either size: up to `most_bytes` rows are filtered in place, without a
    shuffle, beyond it by the hash of their text.
    """
    known = _bounded(benchmark, how)
    if known is None:
        texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
        gone = _by_shuffle(texts, benchmark, how).select(F.col("doc_id").alias("hash")).distinct()
        return docs.join(gone, F.xxhash64(docs["text"]) == gone["hash"], "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not sent.value.matches(None if t is None else t.encode()) for t in texts], dtype=bool)

    return docs.where(clean("text"))
