"""What the findings of round 3 were about."""

from pyspark.sql import functions as F

from brindle.plans import files, registry, retrieval, tables  # noqa: F401

DIR = "/root/testdata/sf0.001"


def test_sc_06_gives_file_slugs_too(spark):
    rows = registry.QUERIES["sc_06"](spark, DIR).collect()
    assert all(0 < len(r["file"]) <= 60 for r in rows)
    assert {r["file"] for r in rows if r["doc_id"] % 10 == 9} == {"untitled"}
    assert any(len(r["x"]) > 60 for r in rows)


def test_src_03_reads_as_one_text_only_what_may_be_json(spark, tmp_path, monkeypatch):
    from brindle.sources import loaders

    (tmp_path / "a.json").write_text('\n\n [{"prompt": "p"},\n{"prompt": "q"}]\n')
    (tmp_path / "b.json").write_text("title,content\nt,c\n" * 50)
    (tmp_path / "c.json").write_text('"title","content"\n"t","c"\n')
    (tmp_path / "d.json").write_text('[{"prompt": "p"}] 1\n')
    (tmp_path / "e.json").write_text(' "title"\n')
    (tmp_path / "f.json").write_text("")
    whole, kinds = [], loaders.json_kinds
    monkeypatch.setattr(loaders, "json_kinds", lambda s, files: whole.extend(files) or kinds(s, files))
    rows = loaders.scan_sources(spark, f"file://{tmp_path}").groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in rows} == {"a.json": 2, "b.json": 99, "c.json": 1}
    assert sorted(f.rsplit("/", 1)[1] for f in whole) == ["a.json", "d.json", "e.json"]


def test_vector_search_keeps_k_rows_a_query_over_all_blocks():
    import numpy as np

    from brindle.operators.vectors import Best

    r = np.random.default_rng(3)
    x = r.normal(size=(600, 8)).round(1) + 0.01
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[300:] = x[:300]  # every vector twice
    y, ids, k = x[:40], r.permutation(600).astype(np.int64), 5
    top = Best(np.arange(40), y, k)
    for at in range(0, 600, 64):
        top.add(ids[at : at + 64], x[at : at + 64])
    got = top.rows()
    assert got.num_rows == 40 * k
    s = np.round(y @ x.T, 12)
    for q in range(40):
        best = np.lexsort((ids, -s[q]))[:k]
        mine = [i for j, i in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if j == q]
        assert sorted(mine) == sorted(ids[best].tolist())


def test_split_words_in_place_gives_what_joins_give(spark, monkeypatch):
    from brindle.operators import spelling

    d = spark.createDataFrame([(w,) for w in ("alpha", "house", "river", "stone", "water", "a")], "term string")
    texts = ["housestonewater  x\n\n riverAlpha,stone", "no  change here", "", None, "zzzzzzzzzzzzzzz housewater é", "house--water-riverstone!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined = spelling.split_words(df, d, most=0).collect()
    monkeypatch.setattr(spelling, "replace_words", None)  # no word leaves its row
    assert sorted(map(tuple, spelling.split_words(df, d).collect())) == sorted(map(tuple, joined))


def test_scores_in_texts_and_phrases_over_repeated_ids(spark):
    from brindle.functions import scalars as S
    from brindle.operators import retrieval as R

    texts = ["is 40%.", "x 101% 7 /100", "+5!% z", "a1% 3", "80\n/100", "80 /1000", "9.5%"]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", S.parse_llm_score("v").alias("x")).orderBy("i").collect()]
    assert got == [0.4, 0.07, 0.05, 0.5, 0.8, 0.5, 0.5]
    docs = spark.createDataFrame([(1, "a b a b c"), (1, "x y"), (2, "a c b")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["b", "a", "b"]), (9, ["c"])], "qid long, phrase array<string>")
    assert sorted(map(tuple, R.match_phrase(R.postings(docs), phrases).collect())) == [(7, 1), (8, 1), (9, 1), (9, 2)]


def test_arrow_batches_become_objects_a_few_at_a_time():
    import pyarrow as pa

    from brindle.operators import chunking

    made = chunking.in_parts(pa.array(["a", None] * 300), pa.list_(pa.string()), lambda t: [t or "n"] * 2)
    assert len(made) == 600 and made[599].as_py() == ["n", "n"] and len(chunking.in_parts(pa.array([], pa.string()), chunking.CHUNK, list)) == 0


def test_an_index_is_made_of_texts_in_whole_blocks(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from brindle.operators import blockindex as B

    monkeypatch.setattr(B, "TOKENS", 7)
    texts = ["a b a", None, "", "b b c", "a", "c a b c", "d d d d d d d d", "e", "a e"]
    rows = [(i // 3, i, (t or "").split() if t is not None else None) for i, t in enumerate(texts)]
    kind = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("t", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows[a : a + 2]], kind) for a in range(0, 9, 2)]
    parts = list(B.whole_blocks(iter(batches)))
    assert len(parts) > 1 and [x for p in parts for x in p.column("id").to_pylist()] == list(range(9))
    assert not any(set(a.column("block").to_pylist()) & set(b.column("block").to_pylist()) for a in parts for b in parts if a is not b)
    made = [r for p in parts for r in B.inverted(p.column("block"), p.column("id"), p.column("t"), 2.5).to_pylist()]
    got = {(r["term"], r["block"], d["id"]): (d["tf"], d["doc_len"], d["positions"]) for r in made for d in r["docs"]}
    want = {(w, b, i): (t.count(w), len(t), [k for k, x in enumerate(t) if x == w]) for b, i, t in rows for w in t or []}
    assert got == want and len(made) == len({(t, b) for t, b, _ in want}) and all(r["n"] == len(r["docs"]) for r in made)
    assert all(abs(r["top"] - max(B.share_of(d["tf"], d["doc_len"], 2.5) for d in r["docs"])) < 1e-12 for r in made)
    assert B.inverted(pa.array([1]), pa.array([1]), pa.array([None], pa.list_(pa.string())), 0.0).num_rows == 0


def test_asked_postings_are_those_of_the_whole_index(spark):
    from brindle.operators import retrieval as R

    docs = spark.createDataFrame([(1, "a b a ab abc"), (1, "a b a ab abc"), (2, None), (3, ""), (4, "b abd x 日本語だ a"), (None, "a a")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("x",), ("abc",), ("nowhere",), ("a",)], "term string")
    prefixes = spark.createDataFrame([("ab",), ("",), ("日",), ("zz",)], "prefix string")
    row = lambda r: (r["term"], r["id"], r["tf"], r["positions"], r["doc_len"])
    got = R.asked_postings(docs, terms, prefixes).collect()
    want = [row(r) for r in R.postings(docs).collect() if r["term"] in ("a", "x", "abc") or r["term"].startswith(("ab", "日"))]
    assert sorted(map(row, got), key=str) == sorted(want, key=str) and len(got) > 10
    none = R.asked_postings(docs, terms, prefixes.limit(0)).collect()
    assert {r["term"] for r in none} == {"a", "x", "abc"}


def test_cosines_within_groups_by_blocks(spark, monkeypatch):
    from brindle.operators import vectors as V

    monkeypatch.setattr(V, "GROUPED", 3)
    rows = [(i, i % 3 if i % 10 else None, [float(i % 7), 1.0 - i, 2.0]) for i in range(40)] + [(50, 1, [0.0, 0.0, 0.0]), (51, 1, None), (52, 1, [1.0, 2.0]), (53, 1, [1.0, None, 2.0]), (None, 1, [1.0, 2.0, 3.0]), (55, 1, []), (4, 1, [9.0, 9.0, 1.0])]
    e = spark.createDataFrame(rows, "a long, label int, v array<float>")
    a = e.where("a % 4 = 0 or a > 49").select("a", "label", F.col("v").alias("vector"))
    b = e.select(F.col("a").alias("b"), "label", F.col("v").alias("vector"))
    plain = a.withColumnRenamed("vector", "u").join(b, "label").select("a", "b", F.round(V.cosine("u", "vector"), 9).alias("cosine"))
    got = V.cosine_within(a, b, "label", "a", "b").select("a", "b", F.round("cosine", 9).alias("cosine"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 200


def test_saved_files_are_dealt_by_number(spark, tmp_path):
    from brindle.sources import sinks

    docs = spark.range(300).select(F.format_string("%012d", "id").alias("id"), F.lit("2024-05-06").cast("timestamp").alias("created_at"), F.when(F.col("id") % 3 == 0, "_p").when(F.col("id") % 3 == 1, "").otherwise("q r").alias("project"), F.lit("T").alias("title"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("é\n"), "id")).otherwise("").alias("text"))
    sinks.save_doc_files(docs, f"file://{tmp_path}/docs")
    (tmp_path / "docs/_p/.part").write_text("x")
    (tmp_path / "docs/_p/other.txt").write_text("x")
    saved = sinks.load_doc_files(spark, f"file://{tmp_path}/docs")
    got = {tuple(r) for r in saved.collect()}
    assert got == {(["_p", "global", "q_r"][i % 3], f"2024-05-06_{i:012d}-t.md", f"é\n{i}" if i % 7 else "") for i in range(300)}


def test_saved_files_are_read_once_for_all_tables(spark):
    from brindle.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = ["# A\nb " + "word " * 900, "", "plain text", "plain text"]
    saved = spark.createDataFrame([("global" if i else "p", f"2024-x_{i}-t-{i}.md", t) for i, t in enumerate(texts)], "project_dir string, name string, text string")
    t = sinks.reindex(saved.mapInArrow(counted, saved.schema), 8)
    docs, chunks, vectors = (t[k].collect() for k in ("documents", "chunks", "embeddings"))
    assert seen.value == len(texts)
    assert sorted((r["project"], r["title"], r["size"]) for r in docs) == [("", "x_1-t-1", 0), ("", "x_2-t-2", 10), ("", "x_3-t-3", 10), ("p", "x_0-t-0", len(texts[0]))]
    assert len({r["chunk_id"] for r in chunks}) == len(chunks) and {r["chunk_id"] for r in chunks} == {r["chunk_id"] for r in vectors}
    of = {n: sorted(r["chunk_index"] for r in chunks if r["name"] == n) for n in {r["name"] for r in chunks}}
    assert len(of) == 3 and len(of["2024-x_0-t-0.md"]) > 1 and all(k == list(range(len(k))) for k in of.values())
    assert all(len(r["vector"]) == 8 for r in vectors)


def test_vectors_of_many_texts_at_once_are_those_of_each(monkeypatch):
    import numpy as np
    import pandas as pd

    from brindle.operators import vectors as V

    texts = [None, "", " ", "ab", "abc abc abc abc", "x_y_zed foo_bar's __", "Don't stop-me 'now' -- a", "你好世界 a，世界。", "ab 你", "ÉCOLE é İstanbul", "w" * 300 + " tail ab", "\0abc\0def 😀abc", *(f"word{i % 7} word{i % 3} of word{i % 5}" for i in range(40))]
    for dim in (1, 16):
        want = []
        for t in texts:
            total = sum((V.gram_vectors([g], dim)[0] for g in V.text_grams(t)), np.zeros(dim, np.int64))
            norm = float(np.sqrt((total * total).sum()))
            want.append((total / norm if norm else total.astype(float)).astype(np.float32).tolist())
        for rows, letters in ((256, 1 << 20), (3, 1 << 20), (256, 50)):
            monkeypatch.setattr(V, "ROWS", rows)
            monkeypatch.setattr(V, "LETTERS", letters)
            assert [v.tolist() for v in V.embedded(pd.Series(texts, dtype=object), dim)] == want
