"""Chat formatting in budgeted windows (operator 1): built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatFormat:
    """budget: tokens of a window, all its turns counted. history: most tokens of earlier turns that a window repeats. extra: tokens that the marks of a turn count."""

    budget: int = 512
    history: int = 128
    extra: int = 4
    learn_role: str = "assistant"
    block: int = 64


def escaped(c: Column) -> Column:
    r"""Backslashes doubled, then `<|` as `<\|`: no control string is left, and `unescaped` gives back c."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("<\\_|"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("<\\_|"), F.lit("\n")))


def placed_turns(conversations: DataFrame, how: ChatFormat) -> DataFrame:
    """Turns with their index and prefix sums of tokens (start, end), and the window each is new in.

    Sums are taken within blocks of turns, then over the blocks, so a
    conversation that holds a third of all rows spreads over many tasks.
    A window has room for the budget less history and the leading system turn
    (a quarter of the budget at least). The line of tokens is cut into
    stretches of that room; what ends in a stretch is one window if it fits,
    else the turn that reaches into the stretch from before is a window of its own.
    """
    c = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumns({"tokens": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + how.extra, "block": F.expr(f"turn div {how.block}")})
    inside = W.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    lead = F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).over(inside)
    c = c.withColumns({"end": F.sum("tokens").over(inside), "at": F.count("*").over(inside) - 1, "lead": lead})
    line = W.partitionBy("conv").orderBy("block")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    sums = c.groupBy("conv", "block").agg(F.max("end").alias("t"), F.count("*").alias("n"), F.max("lead").alias("lead"))
    room = F.greatest(F.lit(how.budget - how.history) - F.first("lead").over(line.rowsBetween(W.unboundedPreceding, 0)), F.lit(how.budget // 4))
    sums = sums.select("conv", "block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), room.alias("room"))
    c = c.drop("lead").join(sums, ["conv", "block"])
    c = c.select("conv", "conv_id", "role", "text", "tokens", "room", (F.col("t") + F.col("end") - F.col("tokens")).alias("start"), (F.col("t") + F.col("end")).alias("end"), (F.col("n") + F.col("at")).alias("at"))
    c = c.withColumn("stretch", F.expr("(end - 1) div room"))
    own = W.partitionBy("conv", "stretch")
    fits = (F.max("end").over(own) - F.min("start").over(own) <= F.col("room")) | (F.expr("start div room") == F.col("stretch"))
    return c.withColumn("window", 2 * F.col("stretch") + fits.cast("int")).drop("stretch", "room")


def format_chat(conversations: DataFrame, how: ChatFormat = ChatFormat()) -> DataFrame:
    """(conv_id, window, n_repeated, tokens, formatted, loss) from conversations (conv_id, turn, role, text).

    A conversation's turns, by (turn, role, text) with null turns first, lie on a line of tokens
    (words of the text, and `extra`). Each turn is new in one window (see `placed_turns`).
    Later windows first repeat the conversation's leading system turn,
    then the turns that start within the last `history` tokens before the
    window's first new turn. All of that is at most `budget` tokens, but for
    two cases that are never cut: a single new turn that alone exceeds the
    room, and a system turn of over 3/4 of the budget less history. n_repeated: how many turns are
    repeated; tokens: of all turns; formatted: all
    turns with their marks; loss: (start, chars) of the escaped text of each new turn of
    `learn_role`, code points from 0 into formatted, so repeated targets are masked. Null roles and texts are
    empty; conversations without an id are one conversation; equal rows are
    turns of their own; further columns are left out; an empty table gives no rows.
    A text of any length stays whole, in one window.
    """
    turns = stored(placed_turns(conversations, how), "turns")
    system = F.col("at") == 0
    system = system & (F.col("role") == "system")
    windows = turns.groupBy("conv", "window").agg(F.min("start").alias("first")).where("first > 0")
    part = lambda k, df: df.select("conv", "conv_id", "window", F.struct(F.lit(k).alias("part"), "at", "role", "text", "tokens").alias("x"))
    buckets = F.sequence(F.expr(f"greatest(first - {how.history}, 0) div {how.history}"), F.expr(f"(first - 1) div {how.history}"))
    asked = windows.withColumn("bucket", F.explode(buckets))
    past = turns.where(~system).drop("window").withColumn("bucket", F.expr(f"start div {how.history}"))
    past = past.join(asked, ["conv", "bucket"]).where(f"start >= first - {how.history} and start < first")
    lead = turns.where(system).drop("window").join(windows, "conv")
    rows = part(2, turns).unionByName(part(1, past)).unionByName(part(0, lead))
    grouped = rows.groupBy("conv", "conv_id", "window").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    marked = lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END + "\n"))
    span = lambda acc, t: F.struct(acc["at"] + F.length(head(t)), F.length(escaped(t["text"])))

    def walk(acc, t):
        new = (t["part"] == 2) & (t["role"] == how.learn_role)
        return F.struct((acc["at"] + F.length(marked(t))).alias("at"), F.when(new, F.concat(acc["loss"], F.array(span(acc, t).cast("struct<start:int,chars:int>")))).otherwise(acc["loss"]).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,chars:int>>)").alias("loss"))
    return grouped.select(
        "conv_id",
        "window",
        F.size(F.filter("turns", lambda t: t["part"] < 2)).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("tokens"),
        F.array_join(F.transform("turns", marked), "").alias("formatted"),
        F.aggregate("turns", zero, walk, lambda acc: acc["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_texts): the new turns (role, text) of each window and the unescaped texts under its loss mask, from `format_chat`'s columns alone."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    new = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts), F.lit(1)))
    role = lambda x: F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)
    text = lambda x: F.substr(x, F.lit(len(START) + 2) + F.length(role(x)))
    turns = F.transform(new, lambda x: F.struct(unescaped_role(role(x)).alias("role"), unescaped(text(x)).alias("text")))
    loss = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["chars"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_texts"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, the digests that prove a lossless round trip."""
    back = read_back(formatted.withColumn("conv_id", F.struct("conv_id", F.length("formatted").alias("chars"))))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    rows = back.select(F.col("conv_id.conv_id").alias("conv_id"), F.col("conv_id.chars").alias("chars"), "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", turn), "").alias("a"), F.array_join("loss_texts", "").alias("b"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "a", "b"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text("a"), 256).alias("turns_sha256"), F.length(text("b")).cast("long").alias("loss_chars"), F.sha2(text("b"), 256).alias("loss_sha256"), "formatted_chars")
