"""Toxicity scores by class-conditional Kneser-Ney models (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import stored
from brindle.llm.langid import fold

#: Symbols of a gram, and bits of a symbol: texts are read as blanks (0; runs of white space and ASCII punctuation), letters in any case, digits (27) and four kinds of other bytes.
ORDER, BITS = 5, 5
GRAMS, CONTEXTS, SYMBOLS = 1 << BITS * ORDER, 1 << BITS * (ORDER - 1), 1 << BITS
DISCOUNT = 0.9
COUNTS = ("ordinary", "toxic", "ordinary_rest", "toxic_rest")


def _symbol(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 92 if b in (0xC2, 0xC3) else 95 if b >= 0xC0 else 93 + (b >> 5 & 1)
    return 64 + ord(c.lower()) - 96 if c.isalpha() else 91 if c.isdigit() else 32


TABLE = bytes(map(_symbol, range(256)))


@dataclass(frozen=True)
class Training:
    """The calibration: of one labelled document in `parts`, at most per_label of each label by hash order. clear: nats above which a word's log-likelihood ratio counts. chunk: bytes of text that a task works on at a time."""

    per_label: int = 2000
    parts: int = 3
    clear: float = 2.0
    chunk: int = 4 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram at each symbol of texts, where words start, and which text each word is of: a word is its symbols and the blank after it, its contexts run over the words before it in the text."""
    pad = b" " * (ORDER - 1)
    parts = [b" ".join(t.translate(TABLE).split()) for t in texts]
    parts = [p + b" " if p else p for p in parts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    s = (np.frombuffer(pad + pad.join(parts) + pad, np.uint8) & 31).astype(np.int32)
    at = np.arange(n.sum()) + np.repeat(np.arange(len(parts)) * (ORDER - 1), n)
    code = np.zeros(len(at), np.int32)
    for j in range(ORDER):
        code = (code << BITS) | s[at + j]
    ends = np.flatnonzero((code & 31) == 0)
    starts = np.concatenate((np.zeros(1, np.intp), ends[:-1] + 1)) if len(ends) else ends
    return code, starts, np.searchsorted(np.cumsum(n), starts, "right")


def chunks(batches, how: Training):
    """(batch rows, texts) of at most about how.chunk bytes, from Arrow batches whose last column is text."""
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column(b.num_columns - 1).cast(pa.binary())]
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= how.chunk or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    if len(parts) < 2:
        return parts
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return [(keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]


def gram_counts(docs: DataFrame, labelled: DataFrame, how: Training) -> DataFrame:
    """(gram, ordinary, toxic, ordinary_rest, toxic_rest) of all grams of docs (text), at most GRAMS rows: how often in the documents of labelled (text, y, fits) with label y, and in those of them that don't fit the calibration."""

    def run(batches):
        seen, found = np.zeros(GRAMS, bool), [[] for _ in range(4)]
        for b, texts in chunks(batches, how):
            code, starts, of = grams(texts)
            seen[code] = True
            y, fits = b.column(0).to_pylist(), b.column(1).to_pylist()
            kind = np.array([4 if k is None else 2 * k + bool(f) for k, f in zip(y, fits, strict=True)])
            each = np.repeat(kind[of], np.diff(np.append(starts, len(code))))
            for k in range(4):
                if (each == k).any():
                    found[k] = _merged([*found[k], np.unique(code[each == k], return_counts=True)])
        keys = np.flatnonzero(seen).astype(np.int32)
        n = np.zeros((4, len(keys)), np.int64)
        for k in range(4):
            for g, c in found[k]:
                n[k, np.searchsorted(keys, g)] = c
        made = n[0] + n[1], n[2] + n[3], n[0], n[2]
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (keys, *made)], ["gram", *COUNTS])

    kind = "gram int, " + ", ".join(f"{c} long" for c in COUNTS)
    every = docs.select(F.lit(None).cast("int").alias("y"), F.lit(False).alias("fits"), "text").mapInArrow(run, kind)
    rows = every.union(labelled.select("y", "fits", "text").mapInArrow(run, kind))
    return rows.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _low(c: str, symbols: int) -> Column:
    return F.col(c).bitwiseAND((1 << BITS * symbols) - 1)


def continuations(counts: DataFrame) -> DataFrame:
    """(low, p): the shared back-off, P(last symbol | the ones before it in low), from how many symbols come before each shorter gram in all documents; shorter contexts are interpolated with the same discount."""
    p, level = None, counts.select("gram")
    levels = []
    for symbols in range(ORDER - 1, 0, -1):
        level = level.groupBy(_low("gram", symbols).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(level)
    for level in reversed(levels):
        own = W.partitionBy(F.shiftright("gram", BITS))
        level = level.select("gram", "n", F.sum("n").over(own).alias("total"), F.count("*").over(own).alias("kinds"))
        if p is None:
            level = level.withColumn("lower", F.lit(1.0 / SYMBOLS))
            symbols = 1
        else:
            level = level.withColumn("low", _low("gram", symbols)).join(p, "low").withColumnRenamed("p", "lower")
            symbols += 1
        p = level.select(F.col("gram").alias("low"), ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")).alias("p"))
    return p


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio, rest, unseen, unseen_rest) of all grams in labelled documents: log P(symbol | context, toxic) - log P(symbol | context, ordinary) by all labelled documents and by those that don't fit the calibration, and both for symbols that the labelled documents don't have after the gram's context.

    Each class interpolates its own counts with the back-off that both share,
    so a context that neither class has gives 0.
    """
    own = W.partitionBy(F.shiftright("gram", BITS * 1))
    stats = counts.select("*", *(F.sum(c).over(own).alias(f"{c}_total") for c in COUNTS), *(F.sum((F.col(c) > 0).cast("int")).over(own).alias(f"{c}_kinds") for c in COUNTS))
    stats = stats.where("ordinary + toxic > 0").withColumn("low", _low("gram", ORDER - 1)).join(continuations(counts), "low")

    def left(c):
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)

    def chance(c):
        return F.coalesce(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.nullif(F.col(f"{c}_total"), F.lit(0)), F.lit(0.0)) + left(c) * F.col("p")

    of = lambda f, end: F.log(f("toxic" + end) / f("ordinary" + end)).cast("float")
    return stats.select("gram", of(chance, "").alias("ratio"), of(chance, "_rest").alias("rest"), of(left, "").alias("unseen"), of(left, "_rest").alias("unseen_rest"))


class Ratios:
    """The log ratio of every gram: sent to the tasks as what labelled documents have, at most GRAMS rows of 8 bytes, and made into a table of GRAMS 2-byte numbers there."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray, unseen: np.ndarray):
        self.gram, self.ratio = gram, ratio.astype(np.float16)
        self.context, first = np.unique(gram >> BITS, return_index=True)
        self.unseen = unseen[first].astype(np.float16)

    def table(self) -> np.ndarray:
        out = np.zeros((CONTEXTS, SYMBOLS), np.float16)
        out[self.context] = self.unseen[:, None]
        out = out.reshape(-1)
        out[self.gram] = self.ratio
        return out


def document_ratios(texts: list[bytes], table: np.ndarray, clear: float) -> tuple[np.ndarray, np.ndarray]:
    """(clear, mean) of each text: the mean over its words of what their log-likelihood ratio has above `clear`, and the mean ratio a symbol; 0 without words."""
    code, starts, of = grams(texts)
    ratio = table[code].astype(np.float64)
    word = np.add.reduceat(ratio, starts) if len(starts) else np.zeros(0)
    n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
    size = np.diff(np.append(starts, len(code)))
    above = np.bincount(of, np.maximum(word - clear, 0), len(texts)) / n
    return above, np.bincount(of, word, len(texts)) / np.maximum(np.bincount(of, size, len(texts)), 1)


def scored_texts(docs: DataFrame, ratios: Ratios, how: Training) -> DataFrame:
    """(doc_id, mark, x, mean) for each row of docs (doc_id, mark, text); x is the length-normalised difference that the score is made of."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        table = sent.value.table()
        for b, texts in chunks(batches, how):
            above, mean = document_ratios(texts, table, how.clear)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.log(above + 0.01)), pa.array(mean)], ["doc_id", "mark", "x", "mean"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark int, x double, mean double")


class Calibration:
    """The logistic of x, fitted on documents that the counts of their ratios didn't see."""

    def __init__(self, x: np.ndarray, label: np.ndarray, true_share: float):
        share = label.mean()
        weight = np.where(label == 1, true_share / share, (1 - true_share) / (1 - share))
        self.mean, self.scale = x.mean(), x.std() + 1e-3
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(2)
        for _ in range(40):  # Newton's method with a little ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(2)
            w += np.clip(np.linalg.solve(h, z.T @ (weight * (label - p)) - 1e-1 * w), -2, 2)
        self.slope, self.shift = max(w[0], 0.0), w[1]

    def score(self, x: Column) -> Column:
        z = (x - float(self.mean)) * float(self.slope / self.scale) + float(self.shift)
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def trained(docs: DataFrame, labels: DataFrame, how: Training) -> tuple[Ratios, Calibration] | float:
    """The ratios and the calibration, or the share of toxic labels if only one label (or none: 0) is there to learn from."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n = sum(count.values())
    if len(count) < 2:
        return count.get(1, 0) / max(n, 1)
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    part = known.where(F.pmod(order, F.lit(how.parts)) == 0)
    # at most 2 * per_label rows of two numbers
    fit = stored(part.where("y = 0").orderBy(order).limit(how.per_label).union(part.where("y = 1").orderBy(order).limit(how.per_label)), "toxicity-fit")
    known = known.join(F.broadcast(fit.select("doc_id", F.lit(True).alias("fits"))), "doc_id", "left")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    sides = own.select("doc_id").join(known, "doc_id").groupBy("y", F.coalesce("fits", F.lit(False)).alias("fits")).count().count()
    if sides < 4:
        return count[1] / n
    # only texts outside the held-out fold are shuffled to their labels, at every size
    labelled = own.where(fold(F.col("doc_id"), 4) != 2).hint("merge").join(known, "doc_id")
    counts = stored(gram_counts(own, labelled, how), "toxicity-grams")
    t = log_ratios(counts).toArrow()
    gram, ratio, rest, unseen, unseen_rest = (t[c].to_numpy() for c in t.column_names)
    some = own.join(F.broadcast(fit), "doc_id").select("doc_id", F.col("y").alias("mark"), "text")
    found = scored_texts(some, Ratios(gram, rest, unseen_rest), how).groupBy("doc_id", "mark").agg(F.max("x").alias("x")).orderBy("doc_id").collect()
    calibration = Calibration(np.array([r["x"] for r in found]), np.array([r["mark"] for r in found]), count[1] / n)
    return Ratios(gram, ratio, unseen), calibration


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) for each row of docs (doc_id, text); labels has (doc_id, toxic).

    Learns from all labels outside the held-out fold, crc32(doc_id as text)
    mod 4 = 2; of repeated labels the largest counts. Texts are sequences of
    `ORDER`-grams of symbols whose contexts run over word ends; the class
    counts are those of the whole texts of all these documents, the
    continuation counts those of all documents. The score is a logistic of one
    number, the log-likelihood difference of the words that are clearly more
    toxic (`Training.clear`), normalised by the number of words, and is fitted
    on a bounded sample (`Training`) by ratios that leave its documents out.
    log_ratio is the plain difference, normalised by length. Null and empty
    texts, and those without a letter, digit or non-ASCII byte, get the score of no
    words; long texts are scored whole; repeated rows get the same score. A
    null doc_id counts as the empty text for the fold. With labels of one kind
    only, the score is their share; an empty table gives no rows.
    """
    model = trained(docs, labels, how)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    if isinstance(model, float):
        scored = own.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(0.0).alias("log_ratio"))
    else:
        ratios, calibration = model
        found = scored_texts(own.select("doc_id", F.col("held_out").cast("int").alias("mark"), "text"), ratios, how)
        scored = found.select("doc_id", (F.col("mark") == 1).alias("held_out"), calibration.score(F.col("x")).alias("score"), F.col("mean").alias("log_ratio"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "log_ratio")
