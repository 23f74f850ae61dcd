"""Stream-shaped folds with batch twins: the same functions take static and streaming frames where Spark allows."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.operators.relational import DONE, FAILED
from brindle.session import stored
from brindle.sources.versioned import ingest
from brindle.streaming.stateful import complete_responses

CHUNK = "id string, model string, choices array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,type:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>"
#: Seconds of a quota period (fixed values).
PERIODS = {"hourly": 3600, "daily": 86400, "monthly": 30 * 86400}


def chat_chunks(lines: DataFrame) -> DataFrame:
    """(response_id, seq, done, c): parsed `data: ` lines; bad JSON goes."""
    data = lines.where(F.col("line").startswith("data: ")).withColumn("data", F.trim(F.substr("line", F.lit(7))))
    done = F.col("data") == "[DONE]"
    return data.select("response_id", "seq", done.alias("done"), F.from_json("data", CHUNK).alias("c")).where(F.col("done") | (F.size("c.choices") >= 0))


def assemble_chat(lines: DataFrame) -> DataFrame:
    """(response_id, id, model, content, finish_reason, tools) from lines (response_id, seq, line): what comes after [DONE] is left out; tools are by index: last id, names and arguments joined."""
    c = chat_chunks(lines)
    end = c.groupBy("response_id").agg(F.min(F.when(F.col("done"), F.col("seq"))).alias("end"))
    c = c.join(end, "response_id").where(~F.col("done") & (F.col("end").isNull() | (F.col("seq") < F.col("end"))))
    c = c.select("response_id", "seq", "c.id", "c.model", F.get("c.choices", F.lit(0)).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("x.delta.content").alias("t")))), lambda s: F.coalesce(s["t"], F.lit(""))), "")
    main = c.groupBy("response_id").agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.col("seq"))).alias("id"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"), text.alias("content"), F.max_by("x.finish_reason", F.when(F.col("x.finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))
    calls = c.select("response_id", "seq", F.explode("x.delta.tool_calls").alias("t"))
    part = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", f.alias("v")))), lambda s: F.coalesce(s["v"], F.lit(""))), "")
    tools = calls.groupBy("response_id", F.col("t.index").alias("i")).agg(F.max_by("t.id", F.when(F.coalesce("t.id", F.lit("")) != "", F.col("seq"))).alias("id"), part(F.col("t.function.name")).alias("name"), part(F.col("t.function.arguments")).alias("arguments"))
    tools = tools.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("i", "id", "name", "arguments"))).alias("tools"))
    tools = tools.select("response_id", F.transform(F.filter(F.transform("tools", lambda t, k: F.struct(t.alias("t"), k.alias("k"))), lambda z: z["t"]["i"] == z["k"]), lambda z: z["t"]).alias("tools"))
    return main.join(tools, "response_id", "left")


def stream_chat(lines: DataFrame, target: str, checkpoint: str):
    """Start a query that writes the assembled responses of a streaming frame of lines (response_id, seq, line) to target, a folder a micro-batch, so a batch that is tried again replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.persist()  # what the state store gives is taken several times
        assemble_chat(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")
        batch.unpersist()

    return complete_responses(lines).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(polls: DataFrame) -> DataFrame:
    """(task, status, polls) from polls (task, ts, event_id, status)."""
    return polls.groupBy("task").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("polls"))


def task_state(status: Column, first: Column, last: Column, timeout: int) -> Column:
    """completed, failed, timed_out after more than `timeout` seconds between the polls, or open."""
    low = F.lower(status)
    return F.when(low.isin(*DONE), "completed").when(low.isin(*FAILED), "failed").when(F.unix_timestamp(last) - F.unix_timestamp(first) > timeout, "timed_out").otherwise("open")


def tracked_tasks(polls: DataFrame, timeout: int = 180) -> DataFrame:
    """(task, status, state, polls) from polls (task, ts, event_id, status), static or streaming (update or complete mode): the latest status, and what it and the time since the first poll say."""
    g = polls.groupBy("task").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("polls"))
    return g.select("task", "status", task_state(F.col("status"), F.col("first"), F.col("last"), timeout).alias("state"), "polls")


def next_starts(seconds: DataFrame) -> DataFrame:
    """seconds (provider, t, span) with far: the first second of the provider more than span later; itself if there is none.

    Seconds lie in buckets of span + 1. The first one that is late enough is in the
    next bucket or, if that has none, the least of the next bucket that holds any, so windows
    run over a bucket's seconds and over a provider's buckets, never over a provider's uses.
    """
    width = F.col("span") + 1
    own = seconds.where("span is not null").withColumn("b", F.floor(F.col("t") / width))
    # each second stands in its own bucket, and again a bucket later to look for its successor
    looks = own.select("provider", "t", "span", (F.col("b") + 1).alias("b"), (F.col("t") + width).alias("at"), F.lit(1).alias("look"))
    both = own.select("provider", "t", "span", "b", F.col("t").alias("at"), F.lit(0).alias("look")).unionByName(looks)
    # from the end, so that each window is a running minimum
    w = W.partitionBy("provider", "b").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("near", F.min(F.when(F.col("look") == 0, F.col("t"))).over(w)).where("look = 1").select("provider", "t", "span", "b", "near")
    least = own.groupBy("provider", "b").agg(F.min("t").alias("least")).withColumn("e", F.lit(0))
    asked = found.where("near is null").select("provider", "b").distinct().select("provider", "b", F.lit(None).cast("long").alias("least"), F.lit(1).alias("e"))
    after = F.last("least", ignorenulls=True).over(W.partitionBy("provider").orderBy(F.desc("b"), F.desc("e")).rowsBetween(W.unboundedPreceding, -1))
    later = least.unionByName(asked).withColumn("later", after).where("e = 1").select("provider", "b", "later")
    out = found.join(later, ["provider", "b"], "left").select("provider", "t", F.coalesce("near", "later", "t").alias("far"))
    return out.unionByName(seconds.where("span is null").select("provider", "t", F.col("t").alias("far")))


def quota_ledger(uses: DataFrame, limits: DataFrame) -> DataFrame:
    """(provider, used, window_start, windows, total, can_use) from uses (provider, ts) and limits (provider, total, period).

    A window opens at the first use and again at the first use more than a
    period later; without a known period it never ends, and a provider without limits has none.
    Times count in whole seconds, window_start is in seconds since 1970. Uses are counted by
    second before they are shuffled. Each second's next start is known from
    `next_starts`; the path from the first second to the last start is followed by pointer
    doubling, four times as far each round, so 1,000 windows take five rounds.
    """
    period = F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))
    per_second = uses.groupBy("provider", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).agg(F.count("*").alias("n")).where("t is not null and provider is not null")
    limits = limits.select("provider", F.coalesce("total", F.lit(0)).cast("long").alias("total"), period[F.col("period")].cast("long").alias("span"))
    seconds = stored(per_second.join(limits, "provider", "left"), "seconds")
    jumps = stored(next_starts(seconds.select("provider", "t", "span")).withColumn("hops", (F.col("far") > F.col("t")).cast("long")), "starts")

    def further(a: DataFrame, b: DataFrame) -> DataFrame:
        onward = b.select("provider", F.col("t").alias("far"), F.col("far").alias("end"), F.col("hops").alias("more"))
        return a.join(onward, ["provider", "far"]).select("provider", "t", F.col("end").alias("far"), (F.col("hops") + F.col("more")).alias("hops"))

    first = seconds.groupBy("provider").agg(F.min("t").alias("t"))
    while True:
        here = stored(jumps.join(first, ["provider", "t"]), "here")
        ends = jumps.where("far = t").select("provider", F.col("t").alias("far"))
        if here.join(ends, ["provider", "far"], "left_anti").isEmpty():
            break
        twice = further(jumps, jumps)
        jumps = stored(further(twice, further(jumps, jumps)), "jumps")
    last = here.select("provider", F.col("far").alias("window_start"), (F.col("hops") + 1).alias("windows"))
    used = seconds.join(last, "provider").where("t >= window_start").groupBy("provider", "window_start", "windows").agg(F.sum("n").alias("used"), F.coalesce(F.max("total"), F.lit(0).cast("long")).alias("total"))
    return used.select("provider", "used", "window_start", "windows", "total", ((F.col("total") <= 0) | (F.col("used") < F.col("total"))).alias("can_use"))


def provider_lists(providers: DataFrame) -> DataFrame:
    """(strategy, listed, usable): the candidates of each strategy among providers (provider, weight, used, total, tags), a configuration table.

    quality and cheap take the tags quality and free, all providers where none has the tag; auto takes both,
    free ones with the least quota left first (no limit counts as 999), or all. Usable are those with quota left.
    """
    tagged = lambda t: F.array_contains("tags", t)
    free, good = tagged("free"), tagged("quality")
    kinds = {"quality": (good, F.lit(0)), "cheap": (free, F.lit(0)), "auto": (free | good, F.when(free, F.when(F.col("total") <= 0, 999).otherwise(F.col("total") - F.col("used"))).otherwise(2**31)), "all": (F.lit(True), F.lit(0))}
    rows = reduce(DataFrame.unionByName, (providers.withColumns({"strategy": F.lit(k), "on": F.coalesce(on, F.lit(False)), "place": place.cast("long")}) for k, (on, place) in kinds.items()))
    one = F.struct("on", "place", "provider", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).alias("weight"), ((F.col("total") <= 0) | (F.col("used") < F.col("total"))).alias("usable"))
    g = rows.groupBy("strategy").agg(F.array_sort(F.collect_list(one)).alias("every"))
    mine = F.filter("every", lambda x: x["on"])
    g = g.withColumn("listed", F.when(F.size(mine) > 0, mine).otherwise(F.col("every")))
    return g.select("strategy", F.transform("listed", lambda x: x["provider"]).alias("listed"), F.filter("listed", lambda x: x["usable"]).alias("usable"))


def route_provider(requests: DataFrame, providers: DataFrame, seed: int = 1) -> DataFrame:
    """(req, ordered): the usable providers of each request (req, strategy, preferred) in weighted random order, seeded.

    Manual requests take those of their preferred list; unknown strategies count as auto. The order is that of
    -log(u) / weight with u from a hash of seed, request and provider, made within each row.
    """
    low = F.lower(F.coalesce("strategy", F.lit("auto")))
    kind = F.when(low == "manual", "all").when(low.isin("quality", "cheap"), low).otherwise("auto")
    r = requests.withColumn("_manual", low == "manual").withColumn("strategy", kind).join(provider_lists(providers).drop("listed"), "strategy", "left")
    mine = F.when(F.col("_manual"), F.filter("usable", lambda p: F.array_contains("preferred", p["provider"]))).otherwise(F.col("usable"))
    u = lambda p: (F.pmod(F.xxhash64(F.lit(seed), F.col("req"), p["provider"]), F.lit(2**31 - 1)) + 1) / float(2**31)
    keyed = F.transform(mine, lambda p: F.struct((-F.log(u(p)) / p["weight"]).alias("x"), p["provider"].alias("provider")))
    return r.select("req", F.transform(F.array_sort(keyed), lambda p: p["provider"]).alias("ordered"))


def ingest_stream(files: DataFrame, target: str, checkpoint: str, dim: int = 384):
    """Start a query that ingests the documents (text) of a streaming frame into the store target: documents, chunks, vectors and postings, a version a micro-batch.

    What the store holds is told from its own buckets, so no state grows with the stream. A
    batch that is tried again after its version was made changes nothing.
    """
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    put = lambda batch, n: ingest(batch.sparkSession, target, batch, stream, n, dim) and None
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
