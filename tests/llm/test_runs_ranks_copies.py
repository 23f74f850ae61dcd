"""Periodic runs, ranked search and exact duplicates: brute force and edge cases."""

import hashlib
import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import exactdup, periodic, ranked

DOCS = "doc_id long, text string, key string, id long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "w ord"), (5, "w ord"), (5, "word"), (None, "wo  r d"), (7, "lorem ipsum " * 20_000), (8, "!!! Über 123 über"), (9, "a a a a a a b"), (10, "x y " * 9 + "z")]
    return spark.createDataFrame([(i, t, "k", 0) for i, t in rows], DOCS)


def runs_of(words):
    """All maximal stretches of 6 words and 4 least periods, by trying each period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts_with_runs(seed, n, most):
    draw = random.Random(seed)
    for _ in range(n):
        words = []
        while len(words) < draw.randint(0, most):
            unit = [draw.choice("abc") * draw.randint(1, 2) for _ in range(draw.choice([1, 1, 2, 3, 4, 5, 7, 9, 16, 33, 70]))]
            words += (unit * draw.randint(1, 9))[: draw.randint(1, 400)]
        yield words


@pytest.mark.parametrize("most", [64, 1 << 15])
def test_runs_brute_force(spark, most):
    texts = list(texts_with_runs(11, 60, 700))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("words", periodic.words_of(F.col("text")))
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.periodic_runs(df, most).collect()}
    assert got == {i: periodic.digest(t, runs_of(t)) for i, t in enumerate(texts)}
    assert sum(x[0] for x in got.values()) > 100


def test_dense_boundaries():
    """Many candidates at a boundary take the Z-functions and give what single shifts give."""
    draw = random.Random(3)
    for _ in range(40):
        unit = [1] * draw.randint(20, 90) + [2]
        x = np.array((unit * 40)[: draw.randint(300, 1500)] + [draw.randint(1, 3) for _ in range(200)])
        q, s, e = periodic.fragments(x, range(periodic.octaves_of(len(x))), lambda k, n=len(x): n)
        found = [(int(a), int(c - a), int(p)) for p, a, c in zip(*periodic.merged(q, s, e), strict=True) if c - a >= max(6, 4 * p)]
        assert sorted(found) == runs_of(x.tolist())


def test_runs_one_word_long(spark):
    df = spark.createDataFrame([(1, ["a"] * 300_000), (2, ["a", "b"] * 70_000 + ["c"])], "doc_id long, words array<string>")
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in periodic.periodic_runs(df, 4096).collect()}
    assert got == {1: (1, 0, 300_000, 1), 2: (1, 0, 140_000, 2)}


def test_runs_edges(odd):
    df = odd.withColumn("words", periodic.words_of(F.col("text")))
    got = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in periodic.periodic_runs(df).collect()}
    assert {(9, 1, 0, 6, 1, 6000), (10, 1, 0, 18, 2, 9000), (7, 1, 0, 40_000, 2, 20_000_000), (1, 0, None, None, None, None), (None, 0, None, None, None, None)} <= got
    assert periodic.periodic_runs(df).count() == 12 and periodic.periodic_runs(df.limit(0)).count() == 0
    nothing = odd.limit(1).select("doc_id", F.lit(None).cast("array<string>").alias("words"))
    assert [r["n_runs"] for r in periodic.periodic_runs(nothing).collect()] == [0]


def test_planted(spark):
    import zlib

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b"), (12, None)], "doc_id long, text string")
    for r in periodic.planted(docs).collect():
        if r["doc_id"] is None or not r["words"]:
            continue
        n = r["doc_id"] % 40
        h, w = zlib.crc32(str(r["doc_id"]).encode()), [f"w{j}" for j in range(n)]
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r["words"] == w


def best_of(docs, items, k):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    terms = [(d, Counter(cut(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, n_terms, df = sum(n > 0 for n in sizes), sum(sizes), Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (d, c), n in zip(terms, sizes, strict=True):
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms))) for t in set(cut(text)) if c[t])
            if s > 0:
                scores.append((-s, (d is not None, d or 0)))
        out += [(item, i + 1, d if some else None, -s) for i, (s, (some, d)) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "first"), [(50, 64), (3, 1), (1, 2)])
def test_ranks_brute_force(spark, k, first):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ünd", "I", "ÄB"]
    text = lambda n: " ".join(words[min(int(draw.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i % 390, text(draw.choice([1, 3, 8, 30, 200]))) for i in range(400)] + [(900 + i, "same text w1 w2 w59") for i in range(90)] + [(None, "w1 w59"), (7, None), (8, ""), (9, "-- !")]
    items = [(i, text(draw.randint(1, 30))) for i in range(12)] + [(3, "W1, w59!"), (None, "w2"), (50, None), (51, "unknown"), (52, "same"), (53, " ".join(words))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"id": F.lit(1), "tid": F.lit(2)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    got = sorted(map(tuple, ranked.ranked_search(d, q, k, first).collect()), key=str)
    assert got == best_of(docs, items, k)


def test_ranks_edges(spark, odd):
    q = odd.select(F.col("doc_id").alias("item_id"), "text")
    assert ranked.ranked_search(odd, q.limit(0)).count() == 0
    assert ranked.ranked_search(odd.limit(0), q).count() == 0
    hit = {(r["item_id"], r["doc_id"]) for r in ranked.ranked_search(odd, q).collect()}
    assert (8, 8) in hit and (7, 7) in hit


@pytest.mark.parametrize(("most", "bits"), [(64 << 20, 63), (300, 63), (200, 3), (10, 0)])
def test_copies_brute_force(spark, odd, most, bits):
    """Small buckets split, and short keys make chains of different texts; the rows stay the same."""
    draw = random.Random(2)
    more = [(100 + i, " " * draw.randint(0, 3) + draw.choice("abcdefgh") * draw.choice([1, 2, 50]) + "\n" * draw.randint(0, 2)) for i in range(400)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    df = df.repartition(5).withColumns({"entry": F.lit(1), "key": F.lit("x"), "n": F.lit(0)})
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    groups = {}
    for i, t in texts:
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i is None, i or 0))
    want = []
    for t, rows in groups.items():
        keep = min(rows)
        rows.remove(keep)
        one = lambda r, kept: (None if r[1] else r[2], None if keep[1] else keep[2], len(rows) + 1, kept, hashlib.sha256(t.encode()).hexdigest())  # noqa: E731, B023
        want += [one(keep, True), *(one(r, False) for r in rows)]
    got = [tuple(r) for r in exactdup.exact_duplicates(df, most, bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_directory(spark):
    e = spark.range(4000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("key"), F.lit(10).cast("long").alias("bytes"))
    hot = e.union(spark.range(500).select(F.lit(5).cast("long").alias("key"), F.lit(100).cast("long").alias("bytes")))
    for df in (e, hot):
        ends = exactdup.directory(df, 2000)
        assert ends[0] == 0 and (np.diff(ends) > 0).all()
        at = np.searchsorted(ends, [r[0] for r in df.collect()], "right") - 1
        sizes = Counter(at.tolist())
        assert all(n <= 200 or (df is hot and i == 0) for i, n in sizes.items())
    assert exactdup.directory(e.limit(0)).tolist() == [0]


def test_copies_edges(odd):
    assert exactdup.exact_duplicates(odd.limit(0)).count() == 0
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdup.exact_duplicates(odd).collect()}
    assert {(3, 3, 3, True), (1, 3, 3, False), (None, None, 5, True), (4, None, 5, False), (7, 7, 1, True)} <= got


def test_sql_twins(spark):
    import duckdb

    from brindle.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op12_ranked_search", "op13_exact_dedup"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_query_brute_force(spark):
    from brindle.llm.queries import QUERIES

    words = {r["doc_id"]: r["words"] for r in periodic.planted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: periodic.digest(w, runs_of(w)) for i, w in words.items() if len(w) < 3000} | {i: got[i] for i, w in words.items() if len(w) >= 3000}
