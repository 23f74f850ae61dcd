"""Filters, joins, aggregates, windows and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions.scalars import glob_pattern, host, meaningful_chars
from brindle.session import cut

#: Terminal states of tasks (fixed values).
DONE = ("completed", "success", "succeeded")
FAILED = ("failed", "failure", "cancelled", "expired")


def scope(df: DataFrame, project: str, column: str = "project") -> DataFrame:
    """'' for all, 'global' for rows without a project, else that project."""
    if project == "":
        return df
    return df.where(F.coalesce(F.col(column), F.lit("")) == ("" if project == "global" else project))


def find_by_prefix(df: DataFrame, prefixes: DataFrame, key: str) -> DataFrame:
    """(prefix, status, found): none, one or ambiguous; found is the only match.

    Keys are cut to each length that a prefix has, so the join is an equi-join.
    """
    sized = prefixes.select("prefix", F.length("prefix").alias("n"))
    lengths = sized.where("n is not null").select("n").distinct()
    heads = df.select(key).join(F.broadcast(lengths), F.length(key) >= F.col("n")).select(key, F.substr(key, F.lit(1), F.col("n")).alias("prefix")).distinct()
    hits = sized.join(heads, "prefix", "left").groupBy("prefix").agg(F.count(key).alias("n"), F.min(key).alias("k"))
    return hits.select("prefix", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("k")).alias("found"))


def grep(df: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", ignore_case: bool = False, context: int = 0, limit: int = 20) -> DataFrame:
    """(key, line_no, line, is_match): matching lines with up to 10 lines around, of the first `limit` (1 to 100) matches by (key, line)."""
    context, limit = max(0, min(context, 10)), max(1, min(limit, 100))
    rx = ("(?i)" if ignore_case else "") + pattern
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    hits = lines.where(F.col("line").rlike(rx)).orderBy(key, "at").limit(limit).select(key, "at")
    near = hits.select(key, F.explode(F.sequence(F.col("at") - context, F.col("at") + context)).alias("at"), F.col("at").alias("hit"))
    near = near.groupBy(key, "at").agg(F.max(F.col("at") == F.col("hit")).alias("is_match"))
    return lines.join(F.broadcast(near), [key, "at"]).select(key, (F.col("at") + 1).alias("line_no"), "line", "is_match")


def glob_any(name: Column, globs: list[str]) -> Column:
    return reduce(lambda a, g: a | F.regexp_like(name, glob_pattern(F.lit(g))), globs, F.lit(False))


def glob_allow_deny(df: DataFrame, name: str, allow: list[str], deny: list[str]) -> DataFrame:
    """Rows whose name an allow glob matches (any, if there is none) and no deny glob."""
    c = F.col(name)
    return df.where((glob_any(c, allow) if allow else F.lit(True)) & ~glob_any(c, deny))


def search_by_image(entries: DataFrame, part: str, urls: str = "image_urls", order: str = "pos") -> DataFrame:
    """entries with hit: the first URL that holds part in any case; of equal hits the first row stays."""
    first = F.get(F.filter(urls, lambda u: F.contains(F.lower(u), F.lit(part.lower()))), F.lit(0))
    hit = entries.withColumn("hit", first).where("hit is not null")
    return hit.withColumn("_n", F.row_number().over(W.partitionBy("hit").orderBy(order))).where("_n = 1").drop("_n")


def skip_known(new: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows of new whose keys, each on its own, are all unknown."""
    return reduce(lambda d, k: d.join(known.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti"), keys, new)


def provider_of_host(df: DataFrame, rules: DataFrame, url: str = "url", default: str | None = None) -> DataFrame:
    """df with provider: the first rule (rule_no, domain, provider) whose domain the host, its port included, is or ends with after a dot in any case; default for other URLs, none for empty ones.

    Rules may have suffix and suffix_provider: URLs that end in suffix, or in it and a slash, are of the latter.
    A host has few suffixes, so these are joined with the domains instead of trying every rule.
    """
    h = F.lower(host(url))
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = df.select(url).distinct().select(url, F.explode(suffixes).alias("domain")).join(rules, "domain")
    best = pairs.groupBy(url).agg(F.min_by(F.struct(*(c for c in rules.columns if c != "domain")), "rule_no").alias("_rule"))
    found = F.col("_rule.provider")
    if "suffix" in rules.columns:
        ends = F.endswith(F.col(url), F.col("_rule.suffix")) | F.endswith(F.col(url), F.concat("_rule.suffix", F.lit("/")))
        found = F.when(ends, F.col("_rule.suffix_provider")).otherwise(found)
    return df.join(best, url, "left").withColumn("provider", F.when(F.coalesce(F.col(url), F.lit("")) != "", F.coalesce(found, F.lit(default)))).drop("_rule")


def without_dead_urls(docs: DataFrame, statuses: DataFrame, url: str = "url") -> DataFrame:
    """docs without those whose URL has a status of 400 or more, or none (unreachable), in statuses (url, status); documents without a URL, or with one that was not looked at, stay."""
    dead = statuses.where((F.col("status") >= 400) | F.col("status").isNull()).select(F.col(url)).where(F.col(url) != "").distinct()
    return docs.join(dead, url, "left_anti")


def entity_provider(df: DataFrame, table: DataFrame, code: str = "code") -> DataFrame:
    """df with provider by the 20 characters from the third of a code of 22 or more, else by the whole code."""
    t = table.select(F.col("entity").alias("_e"), "provider")
    inner = F.when(F.length(code) >= 22, F.substring(code, 3, 20))
    a = df.withColumn("_inner", inner).join(t.withColumnRenamed("provider", "_p1"), F.col("_inner") == F.col("_e"), "left").drop("_e")
    b = a.join(t.withColumnRenamed("provider", "_p2"), F.col(code) == F.col("_e"), "left").drop("_e")
    return b.withColumn("provider", F.coalesce("_p1", "_p2")).drop("_p1", "_p2", "_inner")


def dealt(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column of df, over all shuffle partitions: adaptive plans would leave what is small, but grows a hundredfold in the next step, to one task."""
    return df.select(column).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column).distinct()


def within_one_edit(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, suggestion): for words (word) of 4 letters or more, the least dictionary word (term) at distance 1 at most, closest first.

    Words at distance 1 share themselves or a string with one letter less, so that is joined instead of all pairs.
    """
    keys = lambda c: F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))))
    a = dealt(words.where(F.length("word") >= 4).select("word").distinct(), "word").select("word", F.explode(F.array_distinct(keys(F.col("word")))).alias("k"))
    b = dealt(dictionary.where("term <> ''").select("term").distinct(), "term").select("term", F.explode(F.array_distinct(keys(F.col("term")))).alias("k"))
    near = a.join(b, "k").select("word", "term", F.levenshtein("word", "term").alias("d")).where("d <= 1").distinct()
    return near.groupBy("word").agg(F.min(F.struct("d", "term")).alias("m")).select("word", F.col("m.term").alias("suggestion"))


def duplicate_groups(df: DataFrame, key: str, checksum: Column) -> DataFrame:
    """(checksum, n, keeper) of the texts that occur more than once."""
    return df.select(checksum.alias("checksum"), F.col(key).alias("k")).where("checksum <> ''").groupBy("checksum").agg(F.count("*").alias("n"), F.min("k").alias("keeper")).where("n > 1")


def cheapest_variant(df: DataFrame, size: str, quality: str, price: str) -> DataFrame:
    """(size, quality, price) of the cheapest quality of each size."""
    return df.groupBy(F.col(size).alias("size")).agg(F.min(F.struct(F.col(price).alias("price"), F.col(quality).alias("quality"))).alias("m")).select("size", "m.quality", "m.price")


def usage_totals(df: DataFrame) -> DataFrame:
    """(model, prompt_tokens, completion_tokens, total_tokens, cost) of uses (model, prompt_tokens, completion_tokens, cost); missing numbers count as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    t = df.groupBy("model").agg(total("prompt_tokens"), total("completion_tokens"), total("cost"))
    return t.select("model", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "cost")


def task_summary(df: DataFrame) -> DataFrame:
    """(state, n, cost, credits, actual_time) of tasks (status, cost, credits, actual_time): by completed, failed and open; numbers of tasks without them count as 0."""
    low = F.lower("status")
    state = F.when(low.isin(*DONE), "completed").when(low.isin(*FAILED), "failed").otherwise("open")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"), total("cost"), total("credits"), total("actual_time"))


def radial_profile(spectrum: DataFrame, key: str, h: int, w: int) -> DataFrame:
    """(key, high, slope) from power spectra of h x w (key, y, x, power), the middle at (h / 2, w / 2): mean log power by whole distance from it, the part of the last 30 % of the distances, and the slope of the log profile over log distance from 3 on; -2 from fewer than three positive means."""
    n = min(h // 2, w // 2)
    r = F.floor(F.sqrt(F.pow(F.col("x") - w // 2, F.lit(2)) + F.pow(F.col("y") - h // 2, F.lit(2)))).cast("int")
    p = spectrum.select(key, r.alias("r"), F.log(F.col("power") + 1e-10).alias("p")).where(F.col("r") < n).groupBy(key, "r").agg(F.avg("p").alias("p"))
    fit = (F.col("r") >= 3) & (F.col("p") > 0)
    a, b = F.when(fit, F.log(F.col("r").cast("double"))), F.when(fit, F.log("p"))
    s = p.groupBy(key).agg(F.sum("p").alias("all"), F.sum(F.when(F.col("r") >= n * 7 // 10, F.col("p")).otherwise(0.0)).alias("hf"), F.count(a).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * b).alias("sab"), F.sum(a * a).alias("saa"))
    slope = F.when(F.col("n") > 2, (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / (F.col("n") * F.col("saa") - F.col("sa") * F.col("sa") + 1e-10)).otherwise(-2.0)
    return s.select(key, (F.col("hf") / (F.col("all") + 1e-10)).alias("high"), slope.alias("slope"))


def catalog_by_vendor(df: DataFrame, vendor: str, model: str) -> DataFrame:
    """(vendor, n, model): each model with its vendor, 'Other' for none, and how many that vendor has; counts are joined, so no vendor's models meet in one row."""
    own = df.select(F.coalesce(F.nullif(vendor, F.lit("")), F.lit("Other")).alias("vendor"), F.col(model).alias("model"))
    return own.join(own.groupBy("vendor").agg(F.count("*").alias("n")), "vendor").select("vendor", "n", "model")


def rank_in_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """df with rank: the place of each row in its group by order, from 1, with groups of any size.

    Rows are range-partitioned and sorted; a row's place in the whole is its
    place in the partition and the sizes of the partitions before, and the
    rank is the distance from the first place of its group.
    """
    ranged = df.repartitionByRange(F.col(group).asc_nulls_last(), *order).sortWithinPartitions(F.col(group).asc_nulls_last(), *order)
    placed = cut(ranged.withColumn("_i", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_i", 33), "_at": F.col("_i").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = placed.join(F.broadcast(before), "_part").withColumn("_at", F.col("_at") + F.col("_before"))
    first = placed.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    out = placed.join(first, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("rank", F.col("_at") - F.col("_first") + 1).drop("_i", "_part", "_at", "_before", "_g", "_first")


def weighted_mean(score: Column, weight: Column) -> Column:
    """0.5 without weight."""
    return F.coalesce(F.sum(score * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.5))


def is_scanned(df: DataFrame, doc: str, text: str, least: int = 50) -> DataFrame:
    """(doc, is_scanned): no page has `least` characters besides space, punctuation and digits."""
    return df.groupBy(doc).agg(F.bool_and(meaningful_chars(F.coalesce(F.col(text), F.lit(""))) < least).alias("is_scanned"))


def percentile_range(df: DataFrame, key: str | list[str], value: str, lo: float = 2, hi: float = 98) -> DataFrame:
    """(key, lo, hi): the least value after lo per cent of the rows, in whole rows, are left out at the low end, and the greatest after all above hi per cent are at the high end; from counts of equal values, which are few."""
    keys = [key] if isinstance(key, str) else key
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    cum = counts.withColumn("c", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    low = F.min(F.when(F.col("c") > F.floor(F.col("total") * lo / 100), F.col(value)))
    high = F.max(F.when(F.col("total") - F.col("c") + F.col("n") > F.floor(F.col("total") * (100 - hi) / 100), F.col(value)))
    return cum.groupBy(*keys).agg(low.alias("lo"), high.alias("hi"))


def kth_largest(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, kth): 0 where there are fewer values."""
    top = df.select(key, value).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(value)))).where(F.col("r") <= k)
    return top.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("r") == k, F.col(value))), F.lit(0.0)).alias("kth"))


def list_documents(df: DataFrame, order: str, key: str, limit: int, offset: int, most: int = 100) -> DataFrame:
    """A page by order descending; a limit of none or over `most` counts as 50."""
    return df.orderBy(F.desc(order), key).offset(offset).limit(limit if 0 < limit <= most else 50)


def page_text(text: Column, offset: int, most: int = 5000) -> Column:
    """(page, remaining) in bytes from offset."""
    b = F.encode(text, "UTF-8")
    return F.struct(F.substring(b, offset + 1, min(most, 50_000)).alias("page"), F.greatest(F.octet_length(b) - offset - min(most, 50_000), F.lit(0)).alias("remaining"))
