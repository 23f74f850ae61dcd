"""Runs of repeated words: stretches of consecutive words with a small period.

A document is covered by overlapping tiles, for each octave of periods (B to
2B - 1) its own. In a tile each multiple of B is a boundary; a period can only
be one by which a short gram recurs after it, and how far the words before
and after the boundary agree with those a period on are the values of its Z-functions.
The fragments found so are shuffled by document and period and stitched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from brindle.llm.common import new_path, sliced, stored

#: Words of a document that one task takes whole; longer ones are exploded into tiles.
MOST_WORDS = 1 << 15
#: Documents that a task has in Python at once.
SLICE = 1024
#: A run has at least so many words and periods; a fragment of one at least WHOLE periods, and reaches REACH * B words beyond its boundary.
LEAST, TIMES, WHOLE, REACH = 6, 4, 3, 6
#: Shifts of a boundary that are tried one by one; with more of them the Z-functions are made for all.
FEW = 32
DIGITS = "struct<period:bigint,start:bigint,stop:bigint>"


def words_of(text: Column) -> Column:
    r"""The words `[^\x20\x09-\x0D]+`; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def z_function(s: list[int], upto: int) -> list[int]:
    """How long s agrees with itself from i on, for i below upto."""
    z, left, right = [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of equally long arrays."""
    differ = a != b
    at = int(differ.argmax()) if len(differ) else 0
    return at if len(differ) and differ[at] else len(differ)


def boundary(x: np.ndarray, b: int, qs: np.ndarray, B: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) around boundary b for the shifts qs, from B words before it to REACH * B after it."""
    right, left = x[b : b + REACH * B], x[max(0, b - B) : b]
    if len(qs) > 2:
        # where the words from b on have a short period, its multiples are no least periods
        d = int(np.diff(qs).min())
        span = d + agreement(right[d:], right[:-d]) if d < len(right) else d
        qs = qs[(qs % d != 0) | (qs + d > span)]
    if len(qs) > FEW:
        after = z_function(right.tolist(), min(len(right), 2 * B))
        back = x[max(0, b - B) : b + 2 * B][::-1]
        before = z_function([*left[::-1].tolist(), -1 << 62, *back.tolist()], len(left) + 1 + len(back))
        top = len(back) - len(left)  # place of the word before b in back
        for q in qs.tolist():
            if q < len(after):
                yield q, b - min(len(left), before[len(left) + 1 + top - q]) if top >= q else b, b + q + after[q]
        return
    for q in qs.tolist():
        n = min(len(left), len(x) - b)
        shifted = x[b - len(left) + q : b + q]
        back = agreement(left[::-1][:n], shifted[::-1][:n]) if len(shifted) == len(left) else 0
        yield q, b - back, b + q + agreement(right[q:], right[: max(0, len(right) - q)])


def near_boundaries(x: np.ndarray, b: np.ndarray, q: np.ndarray, B: int) -> tuple[np.ndarray, np.ndarray]:
    """start and stop for many boundaries of a small octave at once; x ends and begins with 8 * B words that occur once."""
    ahead, behind = np.arange(REACH * B), np.arange(1, B + 1)
    start, stop = np.empty_like(b), np.empty_like(b)
    for i in range(0, len(b), 1 << 14):
        s = slice(i, i + (1 << 14))
        at, by = b[s, None], q[s, None]
        same = (x[at + ahead] == x[at + by + ahead]) & (ahead < REACH * B - by)
        stop[s] = b[s] + q[s] + np.where(same.all(1), REACH * B, same.argmin(1))
        same = x[at - behind] == x[at + by - behind]
        start[s] = b[s] - np.where(same.all(1), B, same.argmin(1))
    return start, stop


def grams(x: np.ndarray) -> dict[int, np.ndarray]:
    """Mixed codes of the 2, 4 and 8 words from each place on."""
    def mixed(a, n):
        with np.errstate(over="ignore"):
            a = a * np.uint64(0x9E3779B97F4A7C15)
            return (a ^ (a >> np.uint64(29))) + np.roll(a, -n) * np.uint64(0xBF58476D1CE4E5B9)

    two = mixed(x.astype(np.uint64), 1)
    four = mixed(two, 2)
    return {2: two, 4: four, 8: mixed(four, 4)}


def merged(q: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of equal periods joined where they share a period's words."""
    order = np.lexsort((s, q))
    out: list[list[int]] = []
    for p, a, z in zip(q[order].tolist(), s[order].tolist(), e[order].tolist(), strict=True):
        if out and out[-1][0] == p and a <= out[-1][2] - p:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([p, a, z])
    return tuple(np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (q, s, e)


def primes_of(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def is_least(x: np.ndarray, q: int, s: int) -> bool:
    """The q words from s on are no repetition of fewer words."""
    return not any(np.array_equal(x[s : s + q - q // p], x[s + q // p : s + q]) for p in primes_of(q))


def fragments(x: np.ndarray, octaves: range, upto) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """period, start and stop of fragments in x of the octaves given; octave k looks at the first upto(k) words."""
    pad = 8 * FEW
    far = np.arange(1, pad + 1)
    xp = np.concatenate([-(1 << 60) - far, x, -(1 << 61) - far])
    g = grams(xp)
    found = []
    for k in octaves:
        B, n = 1 << k, upto(k)
        if n < LEAST:
            continue
        own = g[min(2 * B, 8)][pad : pad + n]
        m = -(-n // B)
        own = np.concatenate([own, np.zeros(m * B - n, np.uint64)]).reshape(m, B)
        at, off = np.nonzero(own[1:] == own[:-1, :1])
        b, q = at * B, off + B
        inside = b + q < n
        b, q = b[inside], q[inside]
        if not len(b):
            continue
        if B <= FEW:
            s, e = near_boundaries(xp, b + pad, q, B)
            s, e = s - pad, e - pad
        else:
            cuts = np.flatnonzero(np.diff(b)) + 1
            got = [f for p, qs in zip(b[np.concatenate([[0], cuts])].tolist(), np.split(q, cuts), strict=True) for f in boundary(x, p, qs, B)]
            if not got:
                continue
            q, s, e = np.array(got, dtype=np.int64).T
        long = e - s >= WHOLE * q
        q, s, e = merged(q[long], s[long], e[long])
        least = [is_least(x, int(p), int(a)) for p, a in zip(q, s, strict=True)]
        found.append((q[least], s[least], e[least]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def octaves_of(n: int) -> int:
    """How many octaves have periods of at most n / TIMES."""
    return max(1, (n // TIMES).bit_length())


def coded(words: pa.Array) -> np.ndarray:
    """The words by numbers: equal words, equal numbers."""
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def batch_fragments(words: pa.ListArray, most: int) -> tuple[np.ndarray, ...]:
    """document, period, start and stop of the fragments of all documents of up to `most` words of a batch, which are laid end to end, long ones first, between words that occur once."""
    sizes = pa.compute.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    x, ends = coded(words.flatten()), np.cumsum(sizes)
    order = np.argsort(-sizes, kind="stable")
    order = order[(sizes[order] >= LEAST) & (sizes[order] <= most)]
    parts, starts, at = [], [], 0
    for i in order.tolist():
        parts += [x[ends[i] - sizes[i] : ends[i]], np.array([-1 - i])]
        starts.append(at)
        at += int(sizes[i]) + 1
    if not parts:
        return (np.empty(0, np.int64),) * 4
    starts, placed = np.array(starts), sizes[order]

    def upto(k: int) -> int:
        n = int(np.searchsorted(-placed, -TIMES * (1 << k), "right"))
        return int(starts[n - 1] + placed[n - 1]) if n else 0

    q, s, e = fragments(np.concatenate(parts), range(octaves_of(int(placed[0]))), upto)
    doc = np.searchsorted(starts, s, "right") - 1
    return order[doc], q, s - starts[doc], e - starts[doc]


def found_struct(q, s, e) -> list[dict[str, int]]:
    return [{"period": int(a), "start": int(b), "stop": int(c)} for a, b, c in zip(q, s, e, strict=True)]


def solved(docs: DataFrame, most: int) -> DataFrame:
    """docs (key, doc_id, words) with fragments, and with the text (words joined by blanks) of those that have any; the digest of the text for the others. Documents of more than `most` words are long: they have their text, and no fragments yet."""
    kind = docs.schema["doc_id"].dataType
    frag = ArrayType(StructType([StructField(c, LongType()) for c in ("period", "start", "stop")]))
    schema = StructType([StructField("key", LongType()), StructField("doc_id", kind), StructField("long", BooleanType()), StructField("fragments", frag), StructField("text", StringType()), StructField("collapsed_sha256", StringType())])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("period", "start", "stop")]))

    def run(batches):
        for b in sliced(batches, SLICE):
            words = b.column(2)
            long = pa.compute.list_value_length(words).to_numpy(zero_copy_only=False) > most
            doc, q, s, e = batch_fragments(words, most)
            order = np.argsort(doc, kind="stable")
            doc, q, s, e = doc[order], q[order], s[order], e[order]
            lo, hi = (np.searchsorted(doc, np.arange(len(words)), side) for side in ("left", "right"))
            found = [found_struct(q[i:j], s[i:j], e[i:j]) if j > i else None for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            some = (hi > lo) | long
            texts = pa.compute.binary_join(words, " ")
            digests = [None if has else hashlib.sha256(t.as_buffer()).hexdigest() for has, t in zip(some.tolist(), texts.cast(pa.binary()), strict=True)]
            kept = pa.compute.if_else(pa.array(some), texts, pa.nulls(len(texts), texts.type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(long), pa.array(found, arrow), kept, pa.array(digests, pa.string())], names=schema.names)

    return docs.select("key", "doc_id", "words").mapInArrow(run, schema)


def tiles(docs: DataFrame, most: int) -> DataFrame:
    """(key, at, low, high, words) of docs (key, words), each of more than `most` words: tiles for the octaves from low to high - 1.

    Octaves whose tiles fit share tiles of `most` words; the others have tiles of 16 times their
    period. Tiles overlap by 8 times the greatest, so every run has its fragments.
    """
    shared = max(0, (most // 16).bit_length() - 1)  # octaves with 16 * B <= most, less one
    top = F.length(F.bin(F.floor(F.size("words") / TIMES)))
    rows = docs.select("key", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(shared), F.greatest(F.lit(shared), top - 1))).alias("k"))
    rows = rows.withColumn("own", F.when(F.col("k") == shared, F.lit(most)).otherwise(F.expr("cast(shiftleft(16L, k) as int)")))
    rows = rows.withColumn("at", F.explode(F.expr("sequence(0, n - 1, own)")))
    span = F.col("own") + F.expr("cast(shiftleft(8L, k) as int)")
    return rows.select("key", F.col("at").cast("long").alias("at"), F.when(F.col("k") == shared, 0).otherwise(F.col("k")).alias("low"), (F.col("k") + 1).alias("high"), F.slice("words", F.col("at") + 1, span).alias("words"))


def solved_tiles(rows: DataFrame) -> DataFrame:
    """(key, period, start, stop) of the fragments of each tile."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = coded(b.column(4)[i].values)
                at = b.column(1)[i].as_py()
                q, s, e = fragments(x, range(b.column(2)[i].as_py(), b.column(3)[i].as_py()), lambda k, n=len(x): n)
                key = np.full(len(q), b.column(0)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, q, s + at, e + at)], names=["key", "period", "start", "stop"])

    return rows.mapInArrow(run, "key long, period long, start long, stop long")


def stitched(found: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs: fragments of a document and period that share a period's words are one."""
    own = W.partitionBy("key", "period").orderBy("start", "stop")
    before = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") > before - F.col("period"))).cast("int")
    parts = found.withColumn("new", new).withColumn("part", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    runs = parts.groupBy("key", "period", "part").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select("key", "start", "length", "period")


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """The result's columns for a document of words with runs (start, length, period)."""
    runs = sorted((s, p, n) for s, n, p in runs)
    best = None
    for s, p, n in runs:
        if best is None or n * best[1] > best[2] * p:
            best = (s, p, n)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, p, n in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    kept = " ".join(w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g)
    text = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
    top = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (len(runs), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, RESULT) of docs (doc_id, text, runs)."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), *StructType.fromDDL(RESULT).fields])
    arrow = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for b in sliced(batches, SLICE):
            runs = [[(r["start"], r["length"], r["period"]) for r in rs or ()] for rs in b.column(2).to_pylist()]
            made = list(zip(*(digest(t.as_py().split(" "), r) for t, r in zip(b.column(1), runs, strict=True)), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(made, arrow, strict=True))], names=schema.names)

    return docs.select("doc_id", "text", "runs").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): a row for each row of docs (doc_id, words), whose words hold no blank.

    A run is a stretch with least period q, of LEAST words and TIMES periods or
    more, that no neighbouring word extends. start to exponent_milli are of the run with
    the greatest length / period, the first and then the shortest-period one of equal
    ones; null without runs. Runs are listed by start, then period; in the collapsed words
    nothing follows a run's first period, unless it lies outside of all runs.

    Documents of up to `most` words are solved where they are read, a batch at a
    time; longer ones are exploded into tiles, which any task may solve. Only
    fragments are shuffled, and the words of documents that have some. Null words
    count as none; null and repeated doc_ids are rows of their own; no rows give no rows; extra columns are left alone.
    """
    own = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    path = new_path(docs.sparkSession, "solved")
    solved(own, most).write.option("compression", "zstd").parquet(path)
    short = docs.sparkSession.read.parquet(path)
    found = short.select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    long = short.where("long").select("key", F.split("text", " ").alias("words"))
    n = long.agg(F.sum(F.size("words"))).head()[0] or 0
    if n:
        wide = tiles(long, most).repartition(1 + n // (4 * most))
        found = found.unionByName(stored(solved_tiles(wide), "fragments"))
    whole = short.where("text is not null").select("key", "doc_id", "text")
    runs = stitched(found).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    with_some = collapsed(whole.join(runs, "key", "left"))
    none = F.lit(None).cast("long")
    empty = hashlib.sha256(b"").hexdigest()
    without = short.where("text is null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(c) for c in ("start", "length", "period", "exponent_milli")), F.lit(empty).alias("runs_sha256"), "collapsed_sha256")
    return without.unionByName(with_some)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, words) of docs (doc_id, text): a tenth of the documents, told by the crc32 h of their doc_id, repeat a stretch of their words from the (h div 10) mod n-th on to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = docs.select("doc_id", words_of(F.col("text")).alias("w"), h.alias("h"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w").cast("long"))
    w = w.withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("transform(sequence(a, n - 1), i -> w[cast(a + (i - a) % p as int)])")
    return w.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail)).otherwise(F.col("w")).alias("words"))
