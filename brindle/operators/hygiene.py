"""Keep-first deduplication, merging and pruning of corpora."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from brindle.functions.scalars import content_hash, text_key, url_basename
from brindle.operators.graph import components
from brindle.operators.relational import rank_in_group
from brindle.session import stored
from brindle.sources.loaders import spread

#: Pairs of row and key of a component that one task may fold.
MOST_FOLDED = 500_000


def entry_keys() -> Column:
    """The keys of an entry (source_url, image_urls, title, prompt): equal ones make duplicates."""
    some = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(kind), c))).otherwise(F.array().cast("array<string>"))
    images = F.transform(F.coalesce("image_urls", F.array().cast("array<string>")), lambda u: F.concat(F.lit("i:"), url_basename(u)))
    both = F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("prompt", F.lit("")))
    return F.array_distinct(F.concat(some("u:", F.col("source_url")), images, some("c:", both), some("t:", text_key("prompt"))))


def folded(pairs: DataFrame, order: str) -> DataFrame:
    """The rows (order) of pairs (order, key, label) that share a key with an earlier kept row of their label: the plain rule, row by row, inside each label."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        seen, gone = set(), []
        for at, keys in f.groupby(order, sort=True)["key"]:
            own = set(keys)
            if seen & own:
                gone.append(at)
            else:
                seen |= own
        return pd.DataFrame({order: pd.Series(gone, dtype=f[order].dtype)})

    return pairs.groupBy("label").applyInPandas(run, StructType([pairs.schema[order]]))


def dedup_keep_first(rows: DataFrame, keys: Column, order: str = "pos", rounds: int = 3, most: int = MOST_FOLDED) -> DataFrame:
    """rows that share no key with an earlier kept row; dropped rows mark nothing.

    Only keys of several rows can decide anything, so the others are left out
    at once. A round decides what is certain: a row goes if a kept row has one of
    its keys, and stays if it is the first open one on all of its keys. What is
    open after `rounds` rounds lies in long chains: their components are found in a
    number of steps that grows with the logarithm of a chain, and the rule is applied row
    by row inside each. Components of over `most` pairs of row and key are left to further
    rounds, of which each decides the least open row of every one at least. Keys longer
    than their SHA-256 go as that, so no texts are shuffled.
    """
    brief = F.when(F.octet_length("key") > 64, F.sha2("key", 256)).otherwise(F.col("key"))
    pairs = stored(spread(rows).select(order, F.explode(keys).alias("key")).select(order, brief.alias("key")).distinct(), "keys")
    several = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    pairs = stored(pairs.join(several.select("key", "first"), "key").select(order, "key", "first"), "open")
    gone, n = [], 0
    while not pairs.isEmpty():
        if n == rounds:
            labels = components(pairs.select(F.col(order).alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", order)
            labelled = stored(pairs.join(labels, order), "labelled")
            small = labelled.groupBy("label").agg(F.count("*").alias("m")).where(F.col("m") <= most).select("label")
            gone.append(stored(folded(labelled.join(small, "label", "left_semi").select(order, "key", "label"), order), "folded"))
            pairs = stored(labelled.join(small, "label", "left_anti").select(order, "key", "first"), "open")
            n += 1
            continue
        n += 1
        now = pairs.groupBy(order).agg(F.bool_and(F.col(order) == F.col("first")).alias("stays")).where("stays").select(order)
        taken = pairs.join(now, order, "left_semi").select("key").distinct()
        done = stored(pairs.join(taken, "key", "left_semi").groupBy(order).agg(F.bool_and(F.col(order) == F.col("first")).alias("first")), "decided")
        gone.append(done.where("not first").select(order))
        pairs = pairs.drop("first").join(done, order, "left_anti")
        pairs = stored(pairs.join(pairs.groupBy("key").agg(F.min(order).alias("first")), "key").select(order, "key", "first"), "open")
    return rows.join(reduce(DataFrame.union, gone), order, "left_anti") if gone else rows


def merge_sources(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing and then, by order, the first of each unseen key tuple of new; origin says which."""
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return existing.withColumn("origin", F.lit(0)).unionByName(fresh.withColumn("origin", F.lit(1)))


def merge_entries(existing: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """existing and then those of new entries (order, source_url, image_urls, lang, title, prompt) whose URL, image names, title with prompt and text key together are unknown, each once; origin says which, and place is the row's in its part.

    What there is keeps its order; what comes is in order of URL, language, title and a hash of its contents. Missing
    values count as empty. A place is told from range-sorted rows, not in one task.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    names = F.transform(F.coalesce("image_urls", none), lambda u: url_basename(u))
    brief = lambda c: F.when(F.octet_length(c) > 64, F.sha2(c, 256)).otherwise(c)
    key = F.struct(some("source_url").alias("u"), names.alias("i"), brief(F.concat(some("title"), F.lit("|"), some("prompt"))).alias("c"), brief(text_key(some("prompt"))).alias("t"))
    rows = new.withColumn("_k", key)
    known = existing.select(key.alias("_k")).distinct()
    # equal keys meet without their texts; the first one of each is told by its place in new
    first = rows.select("_k", order).join(known, "_k", "left_anti").groupBy("_k").agg(F.min(order).alias(order))
    fresh = rows.drop("_k").join(first.select(order), order, "left_semi")
    columns = [c for c in ("image_urls", "lang", "prompt", "source_url", "title") if c in new.columns]
    sort = [some(c) for c in ("source_url", "lang", "title")]
    fresh = rank_in_group(fresh.withColumns({"origin": F.lit(1), "_h": content_hash(*columns)}), "origin", *(c.asc() for c in sort), F.asc("_h"), F.asc(order))
    old = rank_in_group(existing.withColumn("origin", F.lit(0)), "origin", F.asc(order))
    return old.unionByName(fresh.drop("_h")).withColumnRenamed("rank", "place")


def prune_duplicates(df: DataFrame, key: str, checksum: Column) -> DataFrame:
    """df without all but the least key of equal checksums."""
    sums = df.select(F.col(key).alias("_k"), checksum.alias("_c")).where("_c <> ''")
    keep = sums.groupBy("_c").agg(F.min("_k").alias("_m"))
    gone = sums.join(keep, "_c").where("_k > _m").select(F.col("_k").alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def upsert_documents(target: DataFrame, updates: DataFrame, now=None, key: str = "id") -> DataFrame:
    """target with updates put in or over by key: created_at stays the first, updated_at of what updates touch is now (a column or value; the current time if none is given)."""
    now = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    both = target.withColumn("_p", F.lit(1)).unionByName(updates.withColumns({"updated_at": now, "_p": F.lit(0)}), allowMissingColumns=True)
    own = W.partitionBy(key)
    both = both.withColumn("created_at", F.min("created_at").over(own)).withColumn("_n", F.row_number().over(own.orderBy("_p")))
    return both.where("_n = 1").drop("_n", "_p")


def check_even(chunks: DataFrame, embeddings: DataFrame, doc: str = "doc_id") -> None:
    """Fail if a document's chunks and embeddings differ in number."""
    counted = lambda df, n: df.groupBy(doc).agg(F.count("*").alias(n))
    uneven = counted(chunks, "c").join(counted(embeddings, "e"), doc, "full_outer").where("coalesce(c, 0) <> coalesce(e, 0)").limit(5).collect()
    if uneven:
        raise ValueError(f"chunks and embeddings differ in number: {[(r[doc], r['c'], r['e']) for r in uneven]}")


def replace_chunks(tables: dict[str, DataFrame], chunks: DataFrame, embeddings: DataFrame, postings: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """tables (chunks, embeddings, postings), each with all rows of the documents of chunks replaced by the new ones.

    A document whose new chunks and embeddings differ in number fails the job
    before anything is replaced; documents kept out of the index have no new postings.
    """
    check_even(chunks, embeddings, doc)
    touched = chunks.select(doc).distinct()
    new = {"chunks": chunks, "embeddings": embeddings, "postings": postings}
    return {k: tables[k].join(touched, doc, "left_anti").unionByName(new[k]) for k in new}


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ids."""
    return {name: t.join(ids.select(doc).distinct(), doc, "left_anti") for name, t in tables.items()}


def save_vault(chunks: DataFrame) -> DataFrame:
    """Chunks whose text is blanked; vectors stay."""
    return chunks.withColumn("content", F.lit(""))
