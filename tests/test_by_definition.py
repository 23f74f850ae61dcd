"""Functions and operators against what they are defined to do, on hand-made inputs for every branch."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import chunking, hygiene, relational, retrieval, series
from brindle.operators.blockindex import BlockIndex, write_segment
from brindle.session import scratch
from brindle.sources import loaders, versioned
from brindle.streaming import jobs, stateful


def table(spark, column, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def pairs(spark, column, cases, kind="string"):
    assert table(spark, column, [a for a, _ in cases], kind) == [b for _, b in cases]


def test_chunks():
    one = lambda text, **k: [(h, c) for _, h, c in chunking.chunks_of(text, **k)]
    assert one("") == one(None) == []
    assert one("hello") == [("", "hello\n")]
    assert one("# A\nbody") == [("# A", "# A\nbody\n")]
    assert one("x\n## B \ny", most=10) == [("", "x\n"), ("## B", "## B\ny\n")]
    assert one("x\n## B\ny") == [("", "x\n\n\n## B\ny\n")]  # both together are shorter than half the most
    assert one("x\n## B\ny", overlap=0) == [("", "x\n"), ("## B", "## B\ny\n")]
    fenced = "```\n# no\n```\n# yes\nz"
    assert one(fenced, overlap=0) == [("# no", "```\n# no\n```\n"), ("# yes", "# yes\nz\n")]
    assert one("####### seven\n#no\n# \nx", overlap=0) == [("", "####### seven\n#no\n# \nx\n")]
    large = one("# H\n" + "a" * 40, most=20, overlap=4)
    assert large[0] == ("# H", "# H\n\n# H\naaaaaaaaaaaa") and all(h == "# H" and c.startswith("# H\n\n") for h, c in large)
    paragraph = one("a" * 60 + "\n\n" + "b" * 60, most=100, overlap=10)
    assert paragraph == [("", "\n\n" + "a" * 60), ("", "\n\n" + "a" * 10 + "\n\n" + "b" * 60 + "\n")]
    stop = one("a" * 60 + "。" + "b" * 60, most=100, overlap=10)
    assert stop[0] == ("", "\n\n" + "a" * 60 + "。")
    line = one("a" * 40 + "\n" + "b" * 90, most=100, overlap=10)
    assert line[0] == ("", "\n\n" + "a" * 40)


def test_small_functions(spark):
    v = F.col("v")
    pairs(spark, S.text_key(v), [(" A, b!", "a b"), ("a !", "a "), ("\xa0x² ½_y\x85", "x² ½_y"), ("!  a", " a"), ("...", ""), ("x" * 300, "x" * 200)])
    pairs(spark, S.slugify(v), [(" Hello World ", "-hello-world-"), ("a - _b", "a-b"), ("é Ü", "-"), ("", ""), ("\u212aA", "a"), ("x" * 80, "x" * 80)])
    pairs(spark, S.file_slug(v), [("", "untitled"), (None, "untitled"), ("A" * 80, "a" * 60), ("é", "untitled")])
    pairs(spark, S.host(v), [("http://A.org:81/x", "A.org:81"), ("https://u:p@b.c?x", "b.c"), ("//d.e/f", "d.e"), ("a/b", ""), ("mailto:x@y", ""), ("http://[::1]:8/", "[::1]:8"), ("", "")])
    pairs(spark, S.hostname(v), [("http://A.org:81/x", "a.org"), ("http://[::1]:8/", "[::1]")])
    pairs(spark, S.url_basename(v), [("http://a.org", ""), ("http://a.org/b/c.png?x=/y", "c.png"), ("c.png#/z", "c.png"), ("http://a.org/b/", ""), ("a/b;v=1?q", "b"), ("//h/x", "x"), ("", "")])
    pairs(spark, S.camel_to_words(v), [("", ""), ("trainedAlgorithmicMedia", "trained Algorithmic Media"), ("XMLParser", "X M L Parser"), ("AIGenerated", "A I Generated"), ("a B", "a  B")])
    long = "é" * 100
    pairs(spark, S.truncate_meta(v), [("  a\t\nb\xa0", "a b"), ("x" * 160, "x" * 160), ("x" * 161, "x" * 160 + "…"), (long, "é" * 80 + "…"), ("x" + long, "x" + "é" * 79 + "…")])
    pairs(spark, S.has_control_chars(v), [("a", False), ("a\tb", True), ("a\nb", True), ("\x1f", True), ("\x7f", False)])
    pairs(spark, S.seconds(v), [("", 0.0), ("5", 5.0), ("1:30", 90.0), ("1:00:00.5", 3600.5), ("1:2:3:4", None), ("-5", None), ("1:-5", None), (" 5", None), ("1::2", None), ("x", None), (None, None)])
    pairs(spark, S.format_price(F.col("v"), F.lit("")), [(1.5, "$1.5000/次"), (None, "—")], "double")
    pairs(spark, S.format_discount(F.col("v")), [(0.8, "20%"), (1.0, "0%")], "double")
    magic = [(b"\xff\xd8\xff", "jpg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\x89PNG", ""), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"GIF8", ""), (b"BM", "bmp"), (b"RIFF0000WEBP", "webp"), (b"RIFF0000WEB", ""), (b"0000ftypavis", "avif"), (b"0000ftyphevc", "heic"), (b"0000ftypmsf1", "heic"), (b"0000ftypwxyz", "heif"), (b"0000ftyp", ""), (b"\xff\x0a", "jxl"), (b"\0\0\0\x0cJXL ", ""), (b"", "")]
    pairs(spark, S.sniff_media(v), [(bytearray(a), b) for a, b in magic], "binary")
    row = spark.createDataFrame([("é\"x", None, 3)], "b string, a string, c long").select(S.content_hash("b", "a", "c").alias("h")).first()["h"]
    assert row == hashlib.md5(json.dumps({"b": "é\"x", "a": None, "c": 3}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_percentiles(spark):
    def slow(values, lo, hi):
        skip, over = int(len(values) * lo / 100), int(len(values) * (100 - hi) / 100)
        v = sorted(values)
        return v[skip], v[::-1][over]

    draw = random.Random(4)
    groups = {"hundred": list(range(100)), "fifty": list(range(50)), "one": [7], "few": [1, 1, 2], "many": [draw.randint(0, 20) for _ in range(777)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)], "k string, v int")
    for lo, hi in ((2, 98), (10, 90), (0, 100)):
        got = {r["k"]: (r["lo"], r["hi"]) for r in relational.percentile_range(df, "k", "v", lo, hi).collect()}
        assert got == {k: slow(v, lo, hi if hi < 100 else 100) for k, v in groups.items()}


PAGE = """<a href="//other.com/z">1</a><a href='p2.html'>2</a><A class=x HREF="../up">3</A><a href=?q=1>4</a><a href="#f">5</a><a href=" ">6</a>
<a href="javascript:x()">7</a><a href="mailto:a@b.c">8</a><a href="http://a.org:81/port">9</a><a href="/abs?x&amp;y">10</a><a href="p2.html">11</a><a href="http://A.org/case">12</a><a data-href="no" id=1>13</a>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://a.org/d/e/page.html", PAGE), (2, "http://b.org", None), (3, None, '<a href="x">')], "page_id long, url string, html string")
    found = loaders.extract_links(pages)
    one = [r["link"] for r in found.where("page_id = 1").orderBy("pos").collect()]
    assert one == ["http://other.com/z", "http://a.org/d/e/p2.html", "http://a.org/d/up", "http://a.org/d/e/page.html?q=1", "mailto:a@b.c", "http://a.org:81/port", "http://a.org/abs?x&y", "http://A.org/case"]
    own = lambda *k: [r["link"] for r in loaders.link_filter(found.where("page_id = 1"), *k).orderBy("pos").collect()]
    assert own(0) == [one[1], one[2], one[3], one[6]] and own(2) == [one[1], one[2]]
    assert own(0, False) == [x for x in one if "mailto:" not in x]
    assert [r["link"] for r in found.where("page_id <> 1").collect()] == ["x"]
    assert table(spark, loaders.page_title("v"), ["<TITLE a=b>x &amp;\ny &#39;</title>", "<p>", None]) == ["x &\ny '", "", None]


def test_tree_and_sources(spark, tmp_path):
    root = tmp_path / ".hidden" / "root"
    for name in ("a.txt", "sub/b.md", ".git/c.txt", "sub/.x/d.py", "e.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    assert sorted(bytes(r["content"]).decode() for r in loaders.load_tree(spark, str(root)).collect()) == ["a.txt", "sub/b.md"]
    folder = tmp_path / "sources"
    folder.mkdir()
    texts = {"a.json": '[{"prompt": "p1"}]', "b.json": '[{"prompt": "p2"}] trailing', "c.json": '{"prompt": "p3"}', "d.json": "title,content\nt,p4\n", "e.csv": 'content\n"p5\nx"\n', "f.json": "", "g.txt": "[]"}
    for n, t in texts.items():
        (folder / n).write_text(t)
    got = sorted((r["n"], r["name"], r["prompt"]) for r in loaders.scan_sources(spark, str(folder)).collect())
    assert got == [(0, "a.json", "p1"), (3, "d.json", "p4"), (4, "e.csv", "p5\nx")]


def test_find_files(spark):
    files = spark.createDataFrame([("r/a-b/x.txt", 1024), ("r/a/y.TXT", 1025), ("r/a/x.md", 1), ("r/z.txt", (1 << 20) + 1)], "path string, length long")
    got = [tuple(r) for r in loaders.find_files(files, "*.txt").collect()]
    assert got == [("r/a-b/x.txt", 1024, "1024 B"), ("r/z.txt", (1 << 20) + 1, "1.0 MB")]
    assert [r["size"] for r in loaders.find_files(files, ".txt").collect()] == ["1.0 KB", "1024 B", "1.0 MB"]
    many = spark.range(200).select(F.concat(F.lit("f/x"), "id").alias("path"), F.col("id").alias("length"))
    assert [loaders.find_files(many, "x", n).count() for n in (0, -1, 7, 500)] == [30, 30, 7, 100]


def test_scoped_ladder(spark):
    docs = spark.createDataFrame([(1, "alpha betas", "A"), (2, "alpha gamma", "B"), (3, "other", "B")], "doc_id long, text string, project string")
    q = spark.createDataFrame([(1, "alpha betas")], "qid long, query string")
    found = lambda p: [(r["id"], r["stage"]) for r in retrieval.full_text_search(docs, q, 5, p).collect()]
    assert found("") == [(1, 1)] and found("A") == [(1, 1)] and found("B") == [(2, 3)] and found("global") == []


def test_merge_entries(spark):
    kind = "pos long, source_url string, image_urls array<string>, lang string, title string, prompt string"
    old = [(1, "u", ["x/a.png"], "en", "T", "Hi!")]
    new = [(1, "u", ["y/a.png?z"], "zh", "T", "Hi!"), (2, "v", [], "en", "b", "p"), (3, "u", ["x/b.png"], "en", "T", "Hi!"), (4, None, None, None, None, None), (5, "v", [], "en", "b", "p"), (6, "v", [], "en", "a", "q"), (7, "v", [], "en", "b", "p2")]
    made = hygiene.merge_entries(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()
    order = sorted(made, key=lambda r: (r["origin"], r["place"]))
    tie = sorted(("p", "p2"), key=lambda p: hashlib.md5(json.dumps({"image_urls": [], "lang": "en", "prompt": p, "source_url": "v", "title": "b"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest())
    assert [(r["origin"], r["pos"], r["prompt"]) for r in order] == [(0, 1, "Hi!"), (1, 4, None), (1, 3, "Hi!"), (1, 6, "q"), *((1, 2 if p == "p" else 7, p) for p in tie)]


def kept_plainly(rows):
    seen, kept = set(), []
    for at, keys in sorted(rows.items()):
        if not seen & keys:
            kept.append(at)
            seen |= keys
    return kept


@pytest.mark.parametrize("most", [10**6, 50])
def test_keep_first(spark, most):
    """A chain of 1,000 rows, and random ones; components that are too large for one task give the same."""
    draw = random.Random(8)
    n = 1000 if most > 50 else 60
    rows = {i: {f"k{i}", f"k{i + 1}"} for i in range(n)}
    rows |= {10_000 + i: {f"r{draw.randint(0, 120)}" for _ in range(draw.randint(0, 3))} for i in range(200)}
    df = spark.createDataFrame([(a, sorted(k)) for a, k in rows.items()], "pos long, ks array<string>")
    got = sorted(r["pos"] for r in hygiene.dedup_keep_first(df, F.col("ks"), most=most).collect())
    assert got == kept_plainly(rows)


def test_recurrence(spark):
    draw = random.Random(1)
    rows = [("one", i, draw.random()) for i in range(3000)] + [(None, 1, 5.0), (None, 2, 6.0), ("z", 1, 2.0), ("n", 1, None)]
    df = spark.createDataFrame(rows, "k string, at int, v double").repartition(7)
    got = {(r["k"], r["n"]): r["blended"] for r in series.temporal_blend(df, "k", ["at"], "v", 0.999).collect()}
    want, last = {}, {}
    for k, i, v in rows:
        if v is not None:
            n, y = last.get(k, (0, None))
            last[k] = (n + 1, v if y is None else 0.999 * y + 0.001 * v)
            want[k, n + 1] = last[k][1]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert series.temporal_blend(df.limit(0), "k", ["at"], "v").count() == 0


def test_quota(spark):
    uses = [("daily", 86400 * i * 2) for i in range(10)] + [("none", 86400 * i) for i in range(10)] + [("odd", 86400 * i) for i in range(10)]
    draw = random.Random(2)
    uses += [("hour", draw.randint(0, 10**6)) for _ in range(3000)] + [("edge", t) for t in (0, 3600, 3601, 7202, 10803)] + [("free", 1)]
    df = spark.createDataFrame(uses, "provider string, t long").select("provider", F.timestamp_seconds("t").alias("ts"))
    limits = [("daily", 1, "daily"), ("none", 5, None), ("odd", 5, "weekly"), ("hour", 9, "hourly"), ("edge", 0, "hourly")]
    got = {r["provider"]: tuple(r)[1:] for r in jobs.quota_ledger(df, spark.createDataFrame(limits, "provider string, total long, period string")).collect()}
    spans = {"daily": 86400, "monthly": 30 * 86400, "hourly": 3600}
    for p in {p for p, _ in uses}:
        total, period = next(((t, k) for q, t, k in limits if q == p), (0, None))
        own, start, windows, used = sorted(t for q, t in uses if q == p), None, 0, 0
        for t in own:
            if start is None or (period in spans and t - start > spans[period]):
                start, windows, used = t, windows + 1, 0
            used += 1
        assert got[p] == (used, start, windows, total, total <= 0 or used < total)


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    t = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    versioned.create(spark, path, {"documents": (t, "id")}, 32)
    before = versioned.manifest(spark, path)
    few = spark.createDataFrame([("5", "new", 9), ("x", "new", 9)], "id string, v string, created_at int")
    versioned.upsert(spark, path, "documents", few, F.lit(9))
    after = versioned.manifest(spark, path)
    changed = [b for b in range(32) if before["tables"]["documents"]["at"][b] != after["tables"]["documents"]["at"][b]]
    assert 1 <= len(changed) <= 2
    now = {r["id"]: tuple(r)[1:] for r in versioned.read(spark, path, "documents").collect()}
    assert len(now) == 1001 and now["5"] == ("new", 1, 9) and now["x"] == ("new", 9, 9) and now["6"] == ("old", 1, 1)
    assert versioned.read(spark, path, "documents", version=before["version"]).where("v = 'new'").count() == 0

    # a job that is stopped before its manifest is in place leaves the old version
    real, versioned._commit = versioned._commit, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    try:
        with pytest.raises(KeyboardInterrupt):
            versioned.delete(spark, path, few.select("id"))
    finally:
        versioned._commit = real
    assert versioned.read(spark, path, "documents").count() == 1001
    # of two jobs that start from one version the later one fails
    stale = versioned.manifest(spark, path)
    versioned.delete(spark, path, few.select("id"))
    with pytest.raises(versioned.ChangedMeanwhile):
        versioned._write(spark, path, stale, {"documents": versioned.Append(t)})
    assert versioned.read(spark, path, "documents").count() == 999
    assert versioned.vacuum(spark, path, 1) and versioned.read(spark, path, "documents").count() == 999
    for _ in range(versioned.MOST_PARTS + 2):
        versioned.change(spark, path, {"documents": versioned.Append(t.limit(1))})
    parts = versioned.manifest(spark, path)["tables"]["documents"]["at"]
    assert max(map(len, parts)) <= versioned.MOST_PARTS and versioned.read(spark, path, "documents").count() == 999 + versioned.MOST_PARTS + 2
    with pytest.raises(ValueError):
        hygiene.check_even(t.select(F.col("id").alias("doc_id")), t.limit(3).select(F.col("id").alias("doc_id")))


def test_ingest(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([("# A\nalpha beta", "p"), ("", "p"), (None, "q"), ("alpha", "q"), ("alpha", "r")], "text string, project string")
    assert versioned.ingest(spark, path, docs, "s", 0, 8) == 1
    assert versioned.ingest(spark, path, docs, "s", 0, 8) is None  # a batch that is tried again
    read = lambda n: versioned.read(spark, path, n)
    sizes = {n: read(n).count() for n in ("documents", "chunks", "embeddings", "postings")}
    assert sizes == {"documents": 3, "chunks": 2, "embeddings": 2, "postings": 4}
    versioned.ingest(spark, path, docs.union(spark.createDataFrame([("gamma", "p")], "text string, project string")), "s", 1, 8)
    assert {n: read(n).count() for n in sizes} == {"documents": 4, "chunks": 3, "embeddings": 3, "postings": 5}
    versioned.ingest(spark, path, spark.createDataFrame([("secret", "v")], "text string, project string"), dim=8, vault=True)
    assert read("postings").count() == 5 and read("chunks").where("content = ''").count() == 1 and read("embeddings").count() == 4


def batches(spark, folder, frames):
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def test_abandoned_responses(spark, tmp_path):
    """A response that falls silent is given out after its time, one that ends at once."""
    import time

    kind = "response_id string, seq long, line string"
    said = lambda r, s, t: (r, s, 'data: {"choices":[{"delta":{"content":"' + t + '"}}]}')
    source = str(tmp_path / "in")
    spark.createDataFrame([said("a", 2, "lo"), said("b", 1, "par")], kind).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(kind).parquet(source)
    q = stateful.complete_responses(stream, 3).writeStream.format("memory").queryName("abandoned").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    spark.createDataFrame([said("a", 1, "hel"), ("a", 3, "data: [DONE]"), said("b", 2, "tial")], kind).coalesce(1).write.mode("append").parquet(source)
    until = time.time() + 90
    while time.time() < until and spark.table("abandoned").select("response_id").distinct().count() < 2:
        time.sleep(1)
    q.stop()
    rows = spark.createDataFrame(spark.table("abandoned").collect(), stateful.LINES)
    got = {r["response_id"]: r["content"] for r in jobs.assemble_chat(rows).collect()}
    assert got == {"a": "hello", "b": "partial"}
    assert {(r["response_id"], r["timed_out"]) for r in rows.collect()} == {("a", False), ("b", True)}


def test_abandoned_tasks(spark, tmp_path):
    """By event time: three batches, one task silent, one that ends in time, one that ends too late."""
    kind = "task string, ts timestamp, event_id long, status string"
    polls = [[("silent", 0, 1, "running"), ("done", 0, 2, "queued"), ("late", 0, 3, "running")], [("done", 50, 4, "Succeeded"), ("late", 100, 5, "running"), ("other", 400, 6, "x")], [("late", 500, 7, "completed"), ("other", 900, 8, "failed")]]
    source = str(tmp_path / "in")
    for i, rows in enumerate(polls):
        df = spark.createDataFrame([(t, s, e, x) for t, s, e, x in rows], "task string, s long, event_id long, status string")
        df.select("task", F.timestamp_seconds(F.col("s") + 10**6).alias("ts"), "event_id", "status").coalesce(1).write.parquet(f"{source}/n={i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source).withWatermark("ts", "0 seconds")
    out = str(tmp_path / "out")
    q = stateful.ended_tasks(stream, 180, True).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["task"], r["status"], r["state"], r["polls"]) for r in spark.read.parquet(out).collect()}
    assert {("silent", "running", "timed_out", 1), ("done", "Succeeded", "completed", 2), ("late", "running", "timed_out", 2)} <= got
    assert len([g for g in got if g[0] != "other"]) == 3


def test_block_index(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(words[min(int(draw.expovariate(0.02)), 399)] for _ in range(n))
    rows = [(i, text(draw.choice([3, 20, 60, 300]))) for i in range(3000)] + [(9001, None), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(i, text(3)) for i in range(20)] + [(90, ""), (91, "nowhere"), (92, "w399 w398 w0")], "qid long, query string")
    path = scratch(spark, "index")
    write_segment(docs.where("doc_id % 3 > 0"), path)
    write_segment(docs.where("doc_id % 3 = 0"), path)
    index, seen = BlockIndex(spark, path), {}
    for every in (False, True):
        want = [(r["qid"], r["id"], round(r["score"], 8), r["rank"]) for r in retrieval.top_k(retrieval.bm25(docs, q, every), 10).collect()]
        for few in (0, 10**9):
            got = [(r["qid"], r["id"], round(r["score"], 8), r["rank"]) for r in index.search(q, 10, every, few=few).collect()]
            assert sorted(got) == sorted(want)
    index.search(q.where("qid < 20"), 3, few=0, seen=seen).collect()
    left = lambda qid: seen["all"].where(F.col("qid") == qid).count() - seen["rest"].where(F.col("qid") == qid).count()
    assert sum(left(i) > 4 for i in range(20)) >= 10  # blocks beyond the first ones are skipped for most queries
    p = spark.createDataFrame([("w1",), ("w39",), ("zz",), ("",)], "prefix string")
    terms = {t for _, x in rows for t in (x or "").split()}
    assert {tuple(r) for r in index.prefixed(p).collect()} == {(p, t) for p in ("w1", "w39", "zz") for t in terms if t.startswith(p)}


def test_splits_both_ways(spark):
    """The automaton and the join with the dictionary give the same splits."""
    from brindle.operators import spelling

    draw = random.Random(9)
    terms = ["alpha", "beta", "gam", "gamma", "in", "the", "house", "walk", "a", "box", "x" * 31]
    words = ["".join(draw.choice([*terms, "walking", "boxes", "qz", "House"]) for _ in range(draw.randint(1, 5))) for _ in range(300)] + ["", "short", "ALPHABETAGAMMA", "alpha-beta-gamma", "1234567890ab", "zzzzzzzzzzzz"]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    d = spark.createDataFrame([(t,) for t in terms], "term string")
    got = [sorted(map(tuple, spelling.word_splits(w, d, n).collect())) for n in (10**6, 0)]
    assert got[0] == got[1] and len(got[0]) > 100
    assert spelling.word_splits(w, d.limit(0)).count() == spelling.word_splits(w, d.limit(0), 0).count() == 0


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_pivots(spark, spread):
    """Clustered vectors leave most blocks out, scattered ones may not; the rows are those of the products of all blocks."""
    from brindle.operators import pivots, vectors

    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 16))
    v = centres[draw.integers(0, 20, 3000)] + spread * draw.normal(size=(3000, 16))
    v[5:40] = v[5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(None, [1.0] * 16), (9999, None)], "id long, vector array<double>")
    q = df.where("id % 7 = 0").select(F.col("id").alias("qid"), "vector")
    seen = {}
    got = sorted((r["qid"], r["rank"], r["id"]) for r in pivots.nearest(q, df, 9, 64, 32, seen=seen).collect())
    assert got == sorted((r["qid"], r["rank"], r["id"]) for r in vectors.vector_topk(q, df, 9).collect())
    assert seen["multiplied"] <= seen["pairs"] and (spread > 1 or seen["multiplied"] < 0.5 * seen["pairs"])
    assert pivots.nearest(q, df.limit(0), 9).count() == pivots.nearest(q.limit(0), df, 9).count() == 0
    few = pivots.nearest(q.limit(3), df.where("id < 4"), 9, 64, 32)
    assert few.count() == 12
