"""What the findings of round 4 were about."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from brindle.plans import files, registry, retrieval, tables  # noqa: F401


def both(spark, path, name, **made):
    """The rows of a query and of its SQL over the tables `made`, in columns by name."""
    con = duckdb.connect()
    for table, df in made.items():
        df.write.parquet(f"{path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    r = con.execute(registry.ORACLE[name])
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in sorted(names)]
    got = [tuple(r[c] for c in sorted(names)) for r in registry.QUERIES[name](spark, str(path)).collect()]
    return sorted(got, key=str), sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_snk_05_an_empty_document_is_whole(spark, tmp_path):
    got, want = both(spark, tmp_path, "snk_05", documents=documents(spark, "a b", "", "", "# A\n" + "word " * 900, " ", "\n"))
    assert got == want and len(got) == 6


def test_split_words_by_a_filter_gives_what_joins_give(spark, monkeypatch):
    from brindle.operators import segments, spelling

    r = random.Random(4)
    part = ["th", "he", "in", "ing", "ed", "s", "ble", "tion", "e", "y", "ies", "est", "er", "a", "i", "qu"]
    word = lambda n: "".join(r.choice(part) for _ in range(r.randint(1, n)))
    terms = {word(3) for _ in range(300)} | {"".join(r.choices("bcdfgklmnp", k=8)) for _ in range(6000)} | {"o'hara", "A", "é" * 3}
    words = [word(9).title() if i % 9 else "".join(r.choices("bcdfgklmnptheingsed", k=12)) for i in range(1500)] + ["z" * n for n in (10, 14, 31, 70)] + [word(90) for _ in range(9)]
    texts = [None, "", " \n", "no  change", *(f" {' '.join(words[i : i + 9])},\n\n é-{words[i]}! " for i in range(0, len(words), 9))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d = spark.createDataFrame([(t,) for t in terms], "term string")
    own = spelling.distinct_words(df, "doc_id", "text").select("word").distinct()
    want = sorted(map(tuple, spelling.replace_words(df, "doc_id", "text", spelling.word_splits(own, d, 0)).collect()), key=str)
    monkeypatch.setattr(spelling, "replace_words", None)  # no word leaves its row
    for bits in (segments.MOST_BITS, 1 << 16):  # a small filter lets many spans pass wrongly
        monkeypatch.setattr(segments, "MOST_BITS", bits)
        made = spelling.split_words(df, d, most=0)
        assert made.columns == df.columns and sorted(map(tuple, made.collect()), key=str) == want
    filtered = spelling.stored(d.where(F.col("term").rlike("^[a-z]+$")), "own")
    passed = segments.Segmenter(segments.filter_of(filtered)).cut([w for w in words if len(w) > 9 and w.isalpha()])[1]
    assert passed - {x["form"] for x in spelling.inflected(filtered).collect()}
    assert sorted(map(tuple, spelling.split_words(df, d.limit(0), most=0).collect()), key=str) == sorted(enumerate(texts), key=str)


def test_cosines_of_byte_triples_are_counted_within_rows(spark, monkeypatch):
    from brindle.operators import retrieval as R

    texts = [(1, "the house The  house"), (2, "xy"), (3, ""), (4, None), (5, "éa é house"), (6, "abc abc"), (6, "abd"), (7, "zzz" * 400)]
    docs = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([(1, "house the"), (2, "ab"), (3, "abc abc"), (4, ""), (5, "é É")], "qid int, query string")
    pairs = asked.crossJoin(docs.select("id").distinct())
    bags = R.ngram_bag(asked, "qid", "query").withColumnRenamed("qid", "x")
    want = R.sparse_cosine(bags, R.ngram_bag(docs, "id", "text").withColumnRenamed("id", "y"), pairs.selectExpr("qid as x", "id as y"))
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(R, "ngram_bag", None)  # no triple is a row
    got = R.gram_cosines(pairs, docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 35 and got.columns == ["qid", "id", "cosine"]
    made = R.idea_search(docs.withColumnRenamed("id", "doc_id"), asked, 3).collect()
    assert {(x["qid"], x["id"]) for x in made} >= {(1, 1), (3, 6)}


def test_sc_23_scores_are_those_of_the_definition(spark):
    from brindle.functions import scalars as S

    ai, human = ("ai-generated", "likely ai", "artificial", "synthetic", "deepfake", "generated"), ("human-made", "real photo", "natural", "authentic", "realistic")
    blank = r"[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

    def score(t):
        parts = [p for p in re.split(blank, t) if p]
        for p, following in zip(parts, [*parts[1:], ""], strict=False):
            n = p.rstrip(".,!?%")
            if re.fullmatch("[+-]?[0-9]+", n) and 0 <= int(n) <= 100 and (following == "/100" or "%" in p):
                return int(n) / 100
        return max(0, min(1, 0.5 + 0.3 * sum(w in t.lower() for w in ai) - 0.3 * sum(w in t.lower() for w in human)))

    r = random.Random(5)
    bits = ["40%", "150%", "+5%", "-5%", "-0%", "0050%!", "7", "/100", "100%!", "0%", " ", "\n", "\x0b", "\x85", "\u2028", "\xa0", "\u3000", "\x1c", "x", "50%x", "50/100", "natural", "artificial", "Generated", "1000%", "50.%", "\u0665%"]
    texts = ["50%\x85", "\xa050%", "7 /100", "-0%", "0007%", "Generated", *("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(1, 8))) for _ in range(2000))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.parse_llm_score("t").alias("x")).orderBy("i").collect()
    assert [(t, round(x["x"], 9)) for t, x in zip(texts, got, strict=True)] == [(t, round(score(t), 9)) for t in texts]


def test_src_07_undoes_all_entities(spark):
    from brindle.sources.loaders import page_title

    pages = spark.createDataFrame([("<TITLE x>a&amp b&quot; &lt;&#169;&eacute;&amp;lt;</title>",), ("<p>",)], "html string")
    assert [x["t"] for x in pages.select(page_title(F.col("html")).alias("t")).collect()] == ['a& b" <©é&lt;', ""]
