"""Operators against plain Python on small tables."""

import re

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.functions.queries import parse
from brindle.operators import chunking, hygiene, provenance, vectors
from brindle.sources.loaders import page_markdown
from brindle.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    cases = {"hello,world": ["hello", "world"], "a 测试 b": ["a", "测试", "b"], "你好世界": ["你好", "好世", "世界"], "test123": ["test123"], "": []}
    for text, want in cases.items():
        assert one(spark, S.tokenize("t"), t=text) == want


def test_contains_word(spark):
    for text, term, want in [("a cat.", "CAT", True), ("concat", "cat", False), ("用猫cat猫", "cat", True), ("x", " ", False), ("a + b", "+", True), ("a+b", "+", False)]:
        assert one(spark, S.contains_word("t", F.col("q")), t=text, q=term) is want


def test_parse_query():
    assert parse('go-lang "a b" cat world') == [("phrase", "go-lang"), ("prefix", "a b"), ("prefix", "cat"), ("term", "world")]
    assert parse("") == []


def test_embedding(spark):
    def slow(g, dim):
        h = vectors.FNV_START
        for b in g.encode():
            h = ((h ^ b) * vectors.FNV_PRIME) % 2**64
        out, state = [], h ^ 42
        for _ in range(dim):
            state = (state + vectors.GAMMA) % 2**64
            z = state
            z = ((z ^ (z >> 30)) * vectors.MIX1) % 2**64
            z = ((z ^ (z >> 27)) * vectors.MIX2) % 2**64
            z ^= z >> 31
            z = z - 2**64 if z >= 2**63 else z
            out.append((abs(z) % 3) * (1 if z >= 0 else -1) - 1)
        return out

    assert vectors.gram_vectors(["thing", "你"], 16).tolist() == [slow("thing", 16), slow("你", 16)]
    for text in ("The quick-brown fox's tail", "你好，世界", "", "a b"):
        assert one(spark, S.embedding_ngrams("t"), t=text) == vectors.text_grams(text)


def test_dedup_keeps_what_a_dropped_row_would_block(spark):
    rows = [(1, "u1", ["a/x.png"], "t1", "one"), (2, "u1", ["a/y.png"], "t2", "two"), (3, "u3", ["b/y.png"], "t3", "three"), (4, "", [], "t4", "One!")]
    df = spark.createDataFrame(rows, "pos int, source_url string, image_urls array<string>, title string, prompt string")
    assert [r[0] for r in hygiene.dedup_keep_first(df, hygiene.entry_keys()).select("pos").orderBy("pos").collect()] == [1, 3]


def test_chunks():
    text = "intro\n# A\n```\n# no\n```\n" + "word " * 900 + "\n\n## B\n" + "x。" * 1500
    parts = chunking.chunks_of(text)
    assert [i for i, _, _ in parts] == list(range(len(parts)))
    assert {h for _, h, _ in parts} == {"", "# A", "## B"}
    assert all(len(c.encode()) <= 2048 + 16 for _, _, c in parts)
    assert chunking.chunks_of(None) == [] and chunking.chunks_of("a\nb") == [(0, "", "a\nb\n")]


def test_sections_twice(spark):
    text = "x\n# A\nb\n```\n# c\n```\n## D\n"
    got = chunking.split_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r["heading"], r["content"]) for r in got] == chunking.sections_of(text)


def test_fusion(spark):
    df = spark.createDataFrame([(True, None, 0.5, -1.0), (None, "AI Generated", 0.5, None)], "camera boolean, src string, model double, llm double")
    f = provenance.fused_signals({"camera": F.col("camera"), "c2pa_source": F.col("src"), "model": F.col("model"), "llm": F.col("llm")})
    a, b = (r["f"] for r in df.select(f.alias("f")).collect())
    assert abs(a["rate"] - (0.1 * 40 + 0.5 * 20) / 60) < 1e-12 and a["level"] == 1
    assert b["rate"] == 0.99 and b["level"] == 4 and len(b["signals"]) == 1


def test_jpeg_scores():
    seg = lambda values, head=0: b"\xff\xdb\0\x43" + bytes([head, *values])
    usual, colour, flat = seg(provenance.LUMINANCE), seg(provenance.CHROMINANCE, 1), seg([200] * 64)
    for body, want in ((b"", 0.4), (usual, 0.45), (colour, 0.45), (flat, 0.65), (usual + flat, 0.65), (usual + colour + flat, 0.25), (usual * 3, 0.25), (seg(provenance.LUMINANCE, 16), 0.65), (usual[:40], 0.4), (b"\xff\xd9" + flat, 0.4), (b"\xff\xd3" + flat, 0.65), (b"\xff\xe0\0\x02" + flat, 0.65)):
        assert provenance.jpeg_quant_score(b"\xff\xd8" + body) == want
    near = bytes(v + max(2, v // 8) * (i < 48) + 99 * (i >= 48) for i, v in enumerate(provenance.LUMINANCE))
    assert provenance.jpeg_quant_score(b"\xff\xd8" + seg(near)) == 0.45
    assert provenance.jpeg_quant_score(b"\x89PNG") == -1.0 and provenance.jpeg_quant_score(b"") == -1.0


def plain_spectrum(x):
    """Rows of grey values to (score, slope, high), by sums."""
    import cmath
    import math

    h, w = len(x), len(x[0])
    wave = lambda n, k: 0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1))
    g = [[(x[i][j] / 255 - 0.5) * wave(h, i) * wave(w, j) for j in range(w)] for i in range(h)]
    turn = lambda n: [cmath.exp(-2j * math.pi * k / n) for k in range(n)]
    tw, th = turn(w), turn(h)
    rows = [[sum(g[i][j] * tw[j * k % w] for j in range(w)) for k in range(w)] for i in range(h)]
    full = [[sum(rows[i][k] * th[i * m % h] for i in range(h)) for k in range(w)] for m in range(h)]
    n = min(h // 2, w // 2)
    total, count = [0.0] * n, [0] * n
    for i in range(h):
        for j in range(w):
            r = int(math.hypot(j - w // 2, i - h // 2))
            if r < n:
                total[r] += math.log(1e-10 + abs(full[(i + h // 2) % h][(j + w // 2) % w]) ** 2)
                count[r] += 1
    p = [t / c for t, c in zip(total, count, strict=True)]
    hf, lf = sum(p[n * 7 // 10 :]), sum(p[: n * 7 // 10])
    high = hf / (hf + lf + 1e-10)
    fit = [(math.log(r), math.log(p[r])) for r in range(3, n) if p[r] > 0]
    slope = -2.0
    if len(fit) > 2:
        sx, sy, sxy, sxx = (sum(f(a, b) for a, b in fit) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a * b, lambda a, b: a * a))
        slope = (len(fit) * sxy - sx * sy) / (len(fit) * sxx - sx * sx + 1e-10)
    s, f = min(1, max(0, 0.5 - (slope + 2) * 0.3)), min(1, max(0, (high - 0.15) / 0.35))
    return 0.6 * s + 0.4 * f, slope, high


def test_spectrum_and_noise_against_sums():
    draw = np.random.default_rng(1)
    loud = draw.integers(0, 256, (64, 66)).astype(float)
    smooth = np.add.outer(np.arange(64.0), np.arange(65.0))
    for x in (loud, smooth, np.full((64, 64), 7.0)):
        assert np.allclose(provenance.fft_features(x), plain_spectrum(x.tolist()), atol=1e-6)
    assert provenance.fft_features([[0.0] * 63] * 99) == (-1.0, 0.0, 0.0)
    # nearest pixels on the way down
    big = draw.integers(0, 256, (600, 1100)).astype(float)
    small = [[big[y * 600 // 279][x * 1100 // 512] for x in range(512)] for y in range(279)]
    assert np.allclose(provenance.fft_features(big), provenance.fft_features(small))
    k = (provenance.KERNEL * 12).round().astype(int).tolist()
    for x in (loud, smooth):
        g = (x / 255).tolist()
        r = [sum(g[y + i - 2][z + j - 2] * k[i][j] for i in range(5) for j in range(5)) / 12 for y in range(2, 62) for z in range(2, len(g[0]) - 2)]
        mean = sum(r) / len(r)
        var = sum((v - mean) ** 2 for v in r) / len(r)
        want = var**0.5, sum((v - mean) ** 4 for v in r) / len(r) / (var * var + 1e-10) - 3
        assert np.allclose(provenance.noise_moments(x), want, atol=1e-9)
    assert provenance.noise_moments([[0.0] * 15] * 99)[0] == -1.0


def test_page():
    assert page_markdown("<title> T </title><nav>no</nav><main><h2>Hi</h2><p>a  b</p><li>c</li></main>z") == ("T", "## Hi\na b\n- c")


def test_chat_stream(spark):
    rows = [("r", i, line) for i, line in enumerate(['data: {"id":"7","choices":[{"delta":{"content":"a"}}]}', "data: {bad", 'data: {"choices":[{"delta":{"content":"b","tool_calls":[{"index":0,"id":"t","function":{"name":"f","arguments":"{"}}]}}]}', 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"}"}}]},"finish_reason":"stop"}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}'])]
    r = jobs.assemble_chat(spark.createDataFrame(rows, "response_id string, seq int, line string")).first()
    assert (r["id"], r["content"], r["finish_reason"]) == ("7", "ab", "stop")
    assert [(t["id"], t["name"], t["arguments"]) for t in r["tools"]] == [("t", "f", "{}")]


def test_quota_windows(spark):
    import random

    draw, rows = random.Random(2), []
    for p in "abc":
        at = 0
        for _ in range(300):
            at += draw.choice((0, 1, 50, 3599, 3600, 3601, 9000))
            rows.append((p, at))
    draw.shuffle(rows)
    uses = spark.createDataFrame(rows, "provider string, at long").select("provider", F.timestamp_seconds("at").alias("ts"))
    limits = spark.createDataFrame([("a", 5, "hourly"), ("b", 0, "daily")], "provider string, total long, period string")
    got = {r["provider"]: (r["used"], r["window_start"], r["windows"], r["can_use"]) for r in jobs.quota_ledger(uses, limits).collect()}
    for p, span, total in (("a", 3600, 5), ("b", 86400, 0), ("c", float("inf"), 0)):
        start, used, windows = None, 0, 0
        for t in sorted(t for q, t in rows if q == p):
            if start is None or t - start > span:
                start, used, windows = t, 0, windows + 1
            used += 1
        assert got[p] == (used, start, windows, total <= 0 or used < total)


def test_keep_first_against_plain_loop(spark):
    import random

    draw = random.Random(5)
    rows = [(i, [f"k{draw.randint(0, 40)}" for _ in range(draw.randint(0, 3))]) for i in range(80)]
    seen, want = set(), []
    for i, keys in rows:
        if not seen & set(keys):
            want.append(i)
            seen |= set(keys)
    df = spark.createDataFrame(rows, "pos int, keys array<string>")
    assert sorted(r["pos"] for r in hygiene.dedup_keep_first(df, F.col("keys")).collect()) == want


def test_uneven_chunks_fail(spark):
    import pytest

    c = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, n int")
    t = {"chunks": c, "embeddings": c, "postings": c}
    with pytest.raises(ValueError, match="differ in number"):
        hygiene.replace_chunks(t, c, c.limit(1), c)
    assert all(x.count() == 2 for x in hygiene.replace_chunks(t, c, c, c).values())


def test_index_for_many_queries(spark, tmp_path):
    """A written index gives what the documents give, without the vault's."""
    from brindle.operators import retrieval as R

    docs = spark.createDataFrame([(1, "a cat and a dog", False), (2, "dog eat dog", None), (3, "secret cat", True)], "doc_id long, text string, vault boolean")
    R.write_index(docs, str(tmp_path / "ix"), vault="vault", buckets=8)
    q = R.query_terms(spark.createDataFrame([(7, "dog cat")], "qid int, query string"))
    found = R.read_index(spark, str(tmp_path / "ix"), q, 8)
    assert {(r["term"], r["id"], r["tf"], r["df"], r["n_docs"]) for r in found.collect()} == {("cat", 1, 1, 1, 2), ("dog", 1, 1, 2, 2), ("dog", 2, 2, 2, 2)}
    own = R.bm25(docs.where("doc_id < 3"), spark.createDataFrame([(7, "dog cat")], "qid int, query string")).collect()
    stats = found.select("n_docs", "avg_len").limit(1)
    again = R.bm25_of(found.select("term", "id", "tf", "doc_len"), stats, q).collect()
    assert {(r["id"], round(r["score"], 9)) for r in own} == {(r["id"], round(r["score"], 9)) for r in again}


def test_parsed_search(spark):
    from brindle.operators import retrieval as R

    docs = spark.createDataFrame([(1, "go-lang tools for the catalogue", "p"), (2, "go and lang apart, cat", "p"), (3, "catalogue of tools", "")], "doc_id long, text string, project string")
    q = lambda s: spark.createDataFrame([(1, s)], "qid int, query string")
    ids = lambda s, project="": {(r["id"], r["stage"]) for r in R.full_text_search(docs, q(s), 9, project).collect()}
    assert ids("go-lang") == {(1, 1)} and ids("cat tools") == {(1, 1), (3, 1)} and ids("cat tools", "p") == {(1, 1)} and ids("cat tools", "global") == {(3, 1)}
    assert ids("zz catalogue") == {(1, 2), (3, 2)} and ids("apart nowhere tools") == {(1, 3), (2, 3), (3, 3)} and ids("nothing") == set()


def test_ingest_after_others(spark, tmp_path):
    """What the store held before the first start is known."""
    from brindle.sources import versioned

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    versioned.ingest(spark, out, spark.createDataFrame([("old",)], "text string"))
    spark.createDataFrame([("old",), ("new",)], "text string").write.parquet(src)
    for _ in range(2):
        jobs.ingest_stream(spark.readStream.schema("text string").parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["content"] for r in versioned.read(spark, out, "chunks").collect()) == ["new\n", "old\n"]


def test_ingest_stream(spark, tmp_path):
    from brindle.sources import versioned

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for texts in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(src)
        jobs.ingest_stream(spark.readStream.schema("text string").parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["content"] for r in versioned.read(spark, out, "chunks").collect()) == ["a\n", "b\n", "c\n"]
    assert versioned.read(spark, out, "documents").count() == 3


def test_nearest_vectors_with_ties(spark):
    v = np.random.default_rng(0).normal(size=(600, 8))
    v[5:200] = v[5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, vector array<double>")
    asked = df.where("id % 50 = 0").selectExpr("id as qid", "vector").union(spark.createDataFrame([(-1, None)], "qid long, vector array<double>"))
    got = {}
    for r in vectors.vector_topk(asked, df, 7, 64).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == np.lexsort((np.arange(600), -np.round(u[q] @ u.T, 12)))[:7].tolist()
    assert vectors.vector_topk(asked, df.limit(0), 7).count() == vectors.vector_topk(asked.limit(0), df, 7).count() == 0


def test_prefixes_of_many_lengths(spark):
    """No length of a prefix is left out."""
    from brindle.operators import relational, retrieval

    key = "".join(chr(97 + i % 26) for i in range(300))
    p = spark.createDataFrame([(i, key[:i]) for i in range(1, 301)], "qid long, prefix string")
    assert retrieval.match_prefix(spark.createDataFrame([(key, 1)], "term string, id long"), p).count() == 300
    found = relational.find_by_prefix(spark.createDataFrame([(key,)], "k string"), p.select("prefix"), "k")
    assert found.where("status = 'one'").count() == 300


def test_pooling_gathers_no_vectors(spark):
    """vec_10 sums before the shuffle; no label's vectors come together in one row."""
    from brindle.plans.retrieval import vec_10

    plan = vec_10(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(embedding" not in plan and "collect_list(" in plan


def test_postings_against_plain_loop(spark):
    from brindle.operators import retrieval as R

    texts = [(1, "b a B c a b"), (2, None), (3, ""), (4, " .,!"), (5, "one"), (6, "你好世界 x"), (7, "w " * 3000 + "v")]
    want = {}
    for i, t in texts:
        words = ["你好", "好世", "世界", "x"] if i == 6 else [w for w in re.findall("[a-z]+", (t or "").lower())]
        for at, w in enumerate(words):
            want.setdefault((w, i, len(words)), []).append(at)
    got = {(r["term"], r["id"], r["doc_len"]): (r["tf"], r["positions"]) for r in R.postings(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {k: (len(p), p) for k, p in want.items()}


def test_keep_first_with_long_keys(spark):
    long = "k" * 500
    df = spark.createDataFrame([(1, [long]), (2, [long, "a"]), (3, ["a"]), (4, [long + "x"]), (5, [])], "pos int, keys array<string>")
    assert sorted(r["pos"] for r in hygiene.dedup_keep_first(df, F.col("keys")).collect()) == [1, 3, 4, 5]
    assert hygiene.dedup_keep_first(df.limit(0), F.col("keys")).count() == 0
