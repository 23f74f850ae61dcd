"""The best documents of each item by presence masks.

Documents are numbered and lie in blocks of 64, so a term's documents in a block
are the bits of one long. An item's terms split the documents of a block by
bit operations into groups of equal masks (which terms they hold); a mask's
maximum is the sum of its terms' greatest shares in that block. Blocks are looked at in
rounds, each of eight times as many as before, and only masks whose maximum reaches the
item's last place so far are scored: those below it can't be among the best any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.llm.common import ascii_lower, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of queries of up to so many rows are sent to all tasks; beyond that they are joined by a shuffle.
MOST_SENT = 2_000_000
#: Documents among which blocks are made.
CHUNK = 4096
BIT = "bit_or(shiftleft(1L, pos))"


def terms_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def sent(df: DataFrame) -> DataFrame:
    """df, hinted for a broadcast if its count is within MOST_SENT."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def place(group: str, *order) -> Column:
    return F.row_number().over(W.partitionBy(group).orderBy(*order))


def posting_blocks(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, tid, bits, tfs, ns, ids): the documents of a block that hold each of the asked terms (tid, term), with the term's frequencies in order of the bits and these documents' lengths in terms; under tid 0 all documents of the block, and their doc_ids.

    Tokens meet the asked terms and are counted before they are shuffled. A block has 64
    documents of about equal length, out of CHUNK that are read one after another.
    """
    empty = vocabulary.sparkSession.range(1).select(F.lit(0).cast("long").alias("tid"), F.lit("").alias("term"))
    tokens = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", terms_of(F.col("text")).alias("t"))
    each = tokens.select("id", "doc_id", F.size("t").alias("n"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    each = each.withColumn("doc_id", F.when(F.col("term") == "", F.col("doc_id")))
    counts = each.join(sent(vocabulary.select("tid", "term").union(empty)), "term").groupBy("id", "n", "doc_id", "tid").agg(F.count("*").cast("int").alias("tf"))
    place_in = F.dense_rank().over(W.partitionBy("chunk").orderBy("n", "id")) - 1
    c = counts.withColumn("chunk", F.floor(F.col("id") / CHUNK)).withColumn("at", place_in)
    c = c.select("chunk", F.expr(f"chunk * {CHUNK // 64} + at div 64").alias("block"), F.expr("cast(at % 64 as int)").alias("pos"), "tid", "doc_id", "tf", "n")
    g = c.groupBy("chunk", "block", "tid").agg(F.expr(BIT).alias("bits"), F.array_sort(F.collect_list(F.struct("pos", "tf", "n", "doc_id"))).alias("s"))
    part = lambda f: F.transform("s", lambda x: x[f])
    return g.select("block", "tid", "bits", part("tf").alias("tfs"), part("n").alias("ns"), F.when(F.col("tid") == 0, part("doc_id")).alias("ids"))


def with_shares(raw: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(block, tid, bits, shares, top) of the terms' rows of raw: what each document gets from a term before its weight, and the most that one gets."""
    fifty = "50L * n" if 50 * n_terms * n_docs < 1 << 63 else "cast(50L * n as decimal(38, 0))"
    share = f"cast((1000000000L * tf) div (1000L * tf + 20L * (50 + ({fifty} * {n_docs}L) div {max(n_terms, 1)}L)) as int)"
    made = raw.where("tid <> 0").select("block", "tid", "bits", F.expr(f"zip_with(tfs, ns, (tf, n) -> {share})").alias("shares"))
    return made.withColumn("top", F.array_max("shares").cast("long"))


def presence_masks(pairs: DataFrame) -> DataFrame:
    """(item, block, ts, bits, most) from pairs (item, block, total, some, ts, least), ts being (-u, u, bit set, ...) of the item's terms, the greatest u first: the documents (bits) of each mask whose maximum is `least` or more.

    Term by term each group of documents falls into those that have the term
    and those that lack it; a group that has lost more than the slack goes.
    """
    slack = F.col("total") - F.col("least")
    start = F.array(F.struct(F.col("some").alias("bits"), F.lit(0).cast("long").alias("lost")))

    def step(groups, t):
        def parts(g):
            have = F.struct(g["bits"].bitwiseAND(t["bits"]).alias("bits"), g["lost"].alias("lost"))
            lack = F.struct(g["bits"].bitwiseAND(F.bitwise_not(t["bits"])).alias("bits"), (g["lost"] + t["u"]).alias("lost"))
            return F.array(have, lack)

        return F.filter(F.flatten(F.transform(groups, parts)), lambda g: (g["bits"] != 0) & (g["lost"] <= slack))

    made = pairs.select("item", "block", "total", "ts", F.explode(F.aggregate("ts", start, step)).alias("g"))
    return made.select("item", "block", "ts", "g.bits", (F.col("total") - F.col("g.lost")).alias("most"))


def scored(masks: DataFrame) -> DataFrame:
    """(item, id, score) of the documents of masks: all of a mask have the same terms, whose shares are looked up by the place of their bit."""
    own = masks.select("item", "block", "bits", F.filter("ts", lambda t: t["bits"].bitwiseAND(F.col("bits")) != 0).alias("mask"))
    each = own.select("item", "block", "mask", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1)")).alias("pos"))
    score = F.expr("aggregate(mask, 0L, (s, t) -> s + t.w * t.shares[bit_count(t.bits & ~shiftleft(-1L, pos))])")
    return each.select("item", F.expr("block * 64 + pos").alias("id"), score.alias("score"))


def least_score(scores: DataFrame, k: int) -> DataFrame:
    """(item, least): the k-th best score, where there are so many."""
    return scores.withColumn("r", place("item", F.desc("score"), "id")).where(F.col("r") == k).select("item", F.col("score").alias("least"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, first: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs (doc_id, text) with a score above 0 for each row of items (item_id, text), ties by doc_id.

    Asked terms are counted and each term's documents put in blocks. The first round takes about `first` blocks, told by a
    hash, the next ones eight times as many each. In a round an item's masks of a block are scored if
    their maximum reaches the k-th best score of the rounds before (any score above 0 in the first); all other
    masks can't hold one of the k best. So every block is looked at once, and the result is exact.

    Null texts have no terms; rows that repeat a doc_id are documents of their
    own, and so are repeated or null item_ids; null doc_ids come first among
    equal scores. A document's length doesn't matter to the plan, as its terms are counted where it is read.
    Empty tables give no rows; extra columns are left alone.
    """
    own = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.array_distinct(terms_of(F.col("text"))).alias("ts")), "items")
    wanted = own.select("item", F.explode("ts").alias("term"))
    vocabulary = stored(wanted.select("term").distinct().select((F.monotonically_increasing_id() + 1).alias("tid"), "term"), "vocabulary")
    raw = stored(posting_blocks(docs.select("doc_id", "text"), vocabulary), "blocks")
    ids = raw.where("tid = 0").select("block", "ids", "ns")
    n = ids.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.size(F.filter("ns", lambda x: x > 0))), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("terms")).head()
    blocks = with_shares(raw, n["docs"], n["terms"])
    df = raw.where("tid <> 0").groupBy("tid").agg(F.sum(F.bit_count("bits")).alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * n["docs"] + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = stored(wanted.join(vocabulary, "term").join(df.select("tid", w.alias("w")), "tid").where("w > 0").select("item", "tid", "w"), "asked")
    small = sent(asked)
    u = F.col("w") * F.col("top")
    one = F.struct((-u).alias("v"), u.alias("u"), "bits", "w", "shares")

    last = 0
    while n["blocks"] > first * 8**last:
        last += 1
    best = least = None
    for r in range(last, -1, -1):
        h = F.xxhash64("block")
        mine = blocks if last == 0 else blocks.where((F.pmod(h, F.lit(8**r)) == 0) & ((F.lit(r) == last) | (F.pmod(h, F.lit(8 ** (r + 1))) != 0)))
        pairs = mine.repartition("block").join(small, "tid").groupBy("block", "item").agg(F.sum(u).alias("total"), F.bit_or("bits").alias("some"), F.array_sort(F.collect_list(one)).alias("ts"))
        one_up = F.lit(1).cast("long")
        pairs = pairs.withColumn("least", one_up) if least is None else pairs.join(sent(least), "item", "left").withColumn("least", F.coalesce("least", one_up)).where("total >= least")
        found = scored(presence_masks(pairs))
        if least is not None:
            found = found.join(sent(least), "item", "left").where("least is null or score >= least").drop("least")
        best = stored(found.where("score > 0") if best is None else best.union(found.where("score > 0")), "best")
        least = stored(least_score(best, k), "least")
    near = best.join(sent(least), "item", "left").where("least is null or score >= least").withColumn("block", F.floor(F.col("id") / 64))
    near = near.join(ids, "block").withColumn("doc_id", F.expr("ids[cast(id % 64 as int)]"))
    named = near.withColumn("rank", place("item", F.desc("score"), "doc_id", "id")).where(F.col("rank") <= k)
    return named.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
