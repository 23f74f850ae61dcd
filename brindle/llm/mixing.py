"""Mixing sources to target weights (operator 2): built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.llm.common import cut, words_in

#: Words in a block; blocks are what sources and shards are given.
BLOCK = 16


def _digest(seed: str, *columns) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), *columns))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sources (key, source, source_size) with target.

    Targets are the weights' parts of share * all sizes, none above
    most * source_size, what is over shared anew by weight. That ends at
    min(cap, level * weight) for one level: with the sources in the order
    of cap / weight, the greatest of the levels that follow from holding
    all sources before a row at their caps.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    out = sources.withColumn("weight", weight.cast("double")).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.lit(share) * F.sum("source_size").over(W.partitionBy(F.lit(1)))
    out = out.withColumn("level", (total - before) / rest)
    return out.select("key", "source", "source_size", F.least("cap", F.max("level").over(W.partitionBy(F.lit(1))) * F.col("weight")).alias("target"))


def apportioned(df: DataFrame, group: list[str], key: list[str], votes: str, seats: str, quota: str) -> DataFrame:
    """df with quota: Sainte-Lague seats within each group, ties by key.

    Seat j of a party has the quotient votes / (2j + 1) and the highest
    quotients win. Any divisor method's seat counts lie between those of the
    divisors V / (seats - n/2) and V / (seats + n/2), so only the few seats
    between are ranked: about 3n rows in all, whatever the number of seats.
    """
    own = W.partitionBy(*map(F.col, group)) if group else W.partitionBy(F.lit(1))
    n, total, v, s = F.count("*").over(own), F.sum(votes).over(own), F.col(votes).cast("double"), F.col(seats)
    base = F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.floor(v * (s - F.col("_n") / 2) / F.col("_v") + 0.5 - 1e-6))).otherwise(0).cast("long")
    top = F.when(v > 0, F.ceil(v * (s + F.col("_n") / 2) / F.col("_v") + 0.5) + 1).otherwise(F.col("_base")).cast("long")
    parties = df.withColumns({"_n": n, "_v": total.cast("double")}).withColumn("_base", base).withColumn("_top", top).withColumn("_left", s - F.sum("_base").over(own))
    seat = parties.withColumn("_j", F.explode(F.sequence("_base", F.greatest("_top", "_base"))))
    order = own.orderBy((F.col(votes) / (2 * F.col("_j") + 1)).desc(), *key, "_j")
    won = (F.row_number().over(order) <= F.col("_left")) & (F.col(votes) > 0)
    ranked = seat.withColumn("_won", won.cast("long"))
    return ranked.groupBy(*df.columns, "_base").agg(F.sum("_won").alias("_more")).withColumn(quota, F.col("_base") + F.col("_more")).drop("_base", "_more")


def mixed_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), block: int = BLOCK, seed: str = "mix") -> DataFrame:
    r"""(doc_id, size, source_size, target, taken) for each row of docs.

    Size: words `[^\x20\x09-\x0D]+` of the text, 0 for null. Each source is
    cut into shards of documents by a seeded hash, as many as the root of all
    words / 16, so neither a hot source nor the shards of a source meet in
    one task. The shares of the sources in blocks follow from `apportioned`,
    and those of its shards from the source's. A shard's documents stand in
    seeded order on a circle of twice its words, and its quota is a run of
    successive blocks from a seeded start: a document is taken again only
    when all others of its shard have been taken. taken: its words in the run,
    at most twice its size. Rows without a source are the last source; equal
    rows may swap their taken words. Texts count whole, other columns are left
    out. An empty table gives no rows.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sizes = cut(sizes.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    shard = _number(_digest(seed, id_text)) % F.lit(max(1, int(total**0.5 / 16)))
    sizes = sizes.withColumn("shard", shard)
    shards = cut(sizes.groupBy("key", "source", "shard").agg(F.sum("size").alias("words")))
    sources = targets(shards.groupBy("key", "source").agg(F.sum("words").alias("source_size")), share, most, weights)
    sources = apportioned(sources.withColumn("blocks", F.lit(round(share * total / block))), [], ["key"], "target", "blocks", "quota")
    quotas = shards.join(sources.select("key", "source_size", "target", "quota"), "key")
    quotas = apportioned(quotas.drop("source"), ["key"], ["shard"], "words", "quota", "blocks").drop("quota")
    line = W.partitionBy("key", "shard").orderBy(_digest(seed + "/order", id_text), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = sizes.withColumn("e", F.sum("size").over(line)).join(quotas, ["key", "shard"])
    around = F.greatest(2 * F.col("words"), F.lit(1))
    start = (_number(_digest(seed + "/start", F.col("key"), F.col("shard").cast("string"))) * block) % around
    placed = placed.withColumns({"s": F.col("e") - F.col("size"), "r": start, "run": F.least(F.col("blocks") * block, 2 * F.col("words"))})
    taken = F.lit(0)
    for turn in (0, 1):
        for wrap in (0, 2):
            a, b = F.col("s") + turn * F.col("words"), F.col("e") + turn * F.col("words")
            c = F.col("r") - wrap * F.col("words")
            taken = taken + F.greatest(F.lit(0), F.least(b, c + F.col("run")) - F.greatest(a, c))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
