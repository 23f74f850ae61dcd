"""Spelling, routing, plug-ins and media items on small tables."""

import random

from pyspark.sql import functions as F

from brindle.functions import extensions
from brindle.functions import scalars as S
from brindle.operators import provenance, spelling
from brindle.sources import loaders, sinks
from brindle.streaming import jobs

TERMS = "a i the modern house company walk like dog cloud word small world stop hello knowledge base search engine".split()


def terms(spark):
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_known_words(spark):
    words = ["Companies", "walked", "liked", "walking", "liking", "smaller", "smallest", "dog's", "dogs", "b", "a", "xyz", "est", "sing", ""]
    got = spelling.known_words(spark.createDataFrame([(w,) for w in words], "word string"), terms(spark))
    assert {r["word"] for r in got.collect()} == {"Companies", "walked", "liked", "walking", "liking", "smaller", "smallest", "dog's", "dogs", "a"}


def test_known_words_against_plain_rules(spark):
    """Words are known by the endings that leave a term, whatever their case."""
    draw = random.Random(12)
    letters = lambda most: "".join(draw.choice("aeiysédgr") for _ in range(draw.randint(0, most)))
    terms = sorted({letters(5) for _ in range(300)} | {"b", "A", "ey", "y", "e"})
    ends = ("", "'s", "s", "ies", "ed", "d", "ing", "er", "est", "b")
    words = sorted({draw.choice(terms)[: draw.choice((9, -1))] + draw.choice(ends) for _ in range(4000)} | {"B", "A", "i", "'s", ""})

    def known(word):
        w = word.lower()
        n = len(w.encode())
        if n == 1 and w not in "ai":
            return False
        cut = [w[: len(w) - c] + add for end, least, c, add in spelling.ENDINGS if w.endswith(end) and n > least]
        return any(t in terms for t in (w, *cut))

    words += [w.upper() for w in words[::7]]
    got = spelling.known_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(r["word"] for r in got.collect()) == sorted({w for w in words if known(w)})


def test_spell_fix(spark):
    rows = ["the srnall house,", "he11o  wor1d\nclog.", "smal wolrd", "A1 Modrn 123 --", "the dog", "", None, "wxyz"]
    got = [r["text"] for r in spelling.spell_fix(texts(spark, *rows), terms(spark)).orderBy("doc_id").collect()]
    assert got == ["the small house,", "hello world\ndog.", "small word", "A1 Modrn 123 --", "the dog", "", None, "wxyz"]


def test_split_words(spark):
    rows = ["knowledgebasesearch engine", "Helloworldthe", "xhelloworldx", "helloworldknowledgezzzz", "short", None, "house,modern-dog"]
    got = [r["text"] for r in spelling.split_words(texts(spark, *rows), terms(spark)).orderBy("doc_id").collect()]
    assert got == ["knowledge base search engine", "Hello world the", "xhelloworldx", "hello world knowledge zzzz", "short", None, "house modern dog"]


def test_best_split_is_best():
    def score(parts, known):
        return sum(len(p) ** 2 - 15 if p in known else -6 * len(p) - 15 for p in parts)

    def every(word):
        yield [word]
        for i in range(1, len(word)):
            yield from ([word[:i], *rest] for rest in every(word[i:]))

    known = {"search", "sea", "archers", "chers", "engine", "gin"}
    word = "searchersengine"
    spans = {(a, b) for a in range(len(word)) for b in range(a + 1, len(word) + 1) if word[a:b] in known}
    assert score(spelling.best_split(word, spans).split(), known) == max(score(p, known) for p in every(word))


def test_routing(spark):
    providers = spark.createDataFrame([("a", 1, 0, 10, ["free"]), ("b", 5, 10, 10, ["free"]), ("c", 2, 3, 0, ["quality"]), ("d", None, 0, 1, None)], "provider string, weight int, used int, total int, tags array<string>")
    lists = {r["strategy"]: r["listed"] for r in jobs.provider_lists(providers).collect()}
    assert lists["auto"] == ["b", "a", "c"] and lists["quality"] == ["c"] and sorted(lists["all"]) == ["a", "b", "c", "d"]
    rows = [(1, "cheap", None), (2, "QUALITY", None), (3, None, None), (4, "manual", ["d", "b"]), (5, "manual", ["zz"])]
    got = {r["req"]: r["ordered"] for r in jobs.route_provider(spark.createDataFrame(rows, "req long, strategy string, preferred array<string>"), providers).collect()}
    assert got[1] == ["a"] and got[2] == ["c"] and sorted(got[3]) == ["a", "c"] and got[4] == ["d"] and got[5] == []
    untagged = jobs.provider_lists(providers.withColumn("tags", F.lit(None).cast("array<string>"))).collect()
    assert all(len(r["listed"]) == 4 for r in untagged)
    many = spark.range(6000).select(F.col("id").alias("req"), F.lit("auto").alias("strategy"), F.lit(None).cast("array<string>").alias("preferred"))
    first = jobs.route_provider(many, providers).where("ordered[0] = 'c'").count() / 6000
    assert abs(first - 2 / 3) < 0.03


def test_plug_ins(spark):
    files = spark.createDataFrame([("1", "x", b"ok"), ("2", "x", b"\xff"), ("3", "y", b""), ("4", "x", None)], "path string, ext string, content binary")
    got = {r["path"]: (r["text"], (r["error"] or "").split(":")[0]) for r in extensions.load_with(files, {"x": lambda b: bytes(b).decode()}).collect()}
    assert got["1"] == ("ok", "") and got["2"] == (None, "UnicodeDecodeError") and got["3"] == (None, "no loader") and got["4"] == (None, "TypeError")
    df = texts(spark, "你好世界 a", "C++ is", "a.b")
    extensions.register_sql(spark, 8)
    rows = spark.sql("select tokenize(text) as t, contains_word(text, 'c++') as c, contains_word(text, ' ') as blank, hash_embed(text) as v from {df} order by doc_id", df=df).collect()
    want = df.select(S.tokenize("text").alias("t"), S.contains_word("text", F.lit("c++")).alias("c")).collect()
    assert [(r["t"], r["c"]) for r in rows] == [(r["t"], r["c"]) for r in want]
    assert not any(r["blank"] for r in rows) and all(len(r["v"]) == 8 for r in rows)
    null = extensions.scorer(lambda q, t: 1 / len(q))
    assert [r["s"] for r in texts(spark, "ab", "").select(null("text", "text").alias("s")).collect()] == [0.5, None]


def test_items_fail_alone(spark):
    items = spark.createDataFrame([(1, b"\xff\xd8\xff\xda\0\0"), (2, None), (3, b"\xff\xd8\xff\xdb\0"), (4, b"jumb\0http://x/digitalsourcetype/trainedAlgorithmicMedia\0")], "id long, content binary")
    got = {r["id"]: (r["rate"], r["error"]) for r in provenance.score_items(items).collect()}
    assert got[1][1] is None and got[2] == (None, "no content") and got[4] == (0.99, None) and len(got) == 4


def test_reindex(spark):
    saved = spark.createDataFrame([("global", "2024-x.md", "# A\nb"), ("p", "n-t-u.md", "")], "project_dir string, name string, text string")
    t = sinks.reindex(saved, 8)
    assert {(r["project"], r["title"], r["size"]) for r in t["documents"].collect()} == {("", "x", 5), ("p", "t-u", 0)}
    assert t["chunks"].count() == t["embeddings"].count() == 1  # an empty file has no chunks


def test_find_files(spark):
    files = spark.createDataFrame([("d/a.txt", 1), ("d/B.md", 2048), ("d/ab.txt", 3)], "path string, length long")
    assert [r["path"] for r in loaders.find_files(files, "a*.txt").collect()] == ["d/a.txt", "d/ab.txt"]
    assert [(r["path"], r["size"]) for r in loaders.find_files(files, "b.MD").collect()] == [("d/B.md", "2.0 KB")]
    assert loaders.find_files(files, "a", 1).count() == 1
