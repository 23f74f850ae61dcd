"""Language identification by a byte convolutional network (operator 6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bytes share 155 embeddings: a-z in either case, each byte from 0x80 on, and all else.
CLASSES = 155
TABLE = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b >= 128 else 0 for b in range(256))


@dataclass(frozen=True)
class Training:
    """At least `steps` steps of training, and `epochs` rounds over the sample: about per_lang labelled documents of each of the most_langs commonest languages, and `chars` characters of each from a seeded place."""

    per_lang: int = 800
    most_langs: int = 256
    chars: int = 400
    epochs: int = 6
    steps: int = 600
    rate: float = 0.01
    seed: int = 3


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All of each text in windows of WINDOW byte classes, the last one padded; which text each window is from."""
    parts = [t.translate(TABLE) for t in texts]
    n = [-(-max(len(t), 1) // WINDOW) for t in parts]
    joined = b"".join(p + bytes(k * WINDOW - len(p)) for p, k in zip(parts, n, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), n)


class ByteNetwork:
    """Filters of several widths over byte embeddings, max pooling over the window, then softmax."""

    def __init__(self, langs: list[str], seed: int):
        draw = np.random.default_rng(seed)
        self.langs = langs
        self.filters = [draw.normal(0, 0.1, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.shift = np.zeros(len(langs), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, how: Training) -> None:
        """Adam on the cross entropy; only the position that wins the pooling passes a gradient back."""
        draw = np.random.default_rng(how.seed)
        params = [*self.filters, self.bias, self.out, self.shift]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(how.epochs, -(-how.steps * 64 // len(x)))):
            order = draw.permutation(len(x))
            for at in range(0, len(x), 64):
                pick = order[at : at + 64]
                ids, n = x[pick], len(pick)
                pooled, where = [], []
                for f in self.filters:
                    w = len(f)
                    r = sum(f[j][ids[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    where.append(r.argmax(axis=1))
                    pooled.append(r.max(axis=1))
                h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
                z = h @ self.out + self.shift
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y[pick]] -= 1
                p /= n
                dh = (p @ self.out.T) * (h > 0)
                grads = []
                for k, f in enumerate(self.filters):
                    g, own = np.zeros_like(f), dh[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(f)):
                        np.add.at(g[j], (np.take_along_axis(ids, where[k] + j, axis=1), np.arange(FILTERS)), own)
                    grads.append(g)
                t += 1
                for q, g, m, v in zip(params, [*grads, dh.sum(axis=0), h.T @ p, p.sum(axis=0)], first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= how.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> dict:
        """For each pair of byte classes, what each filter gets from it: a filter's response is then one or two look-ups."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        two, three, four = self.filters
        return {"two": pair(*two), "three": pair(*three[:2]), "third": three[2], "front": pair(*four[:2]), "back": pair(*four[2:])}

    def log_probabilities(self, x: np.ndarray, t: dict) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 32):
            ids = x[at : at + 32].astype(np.int32)
            pair = ids[:, :-1] * CLASSES + ids[:, 1:]
            two = t["two"][pair].max(axis=1)
            three = (t["three"][pair[:, :-1]] + t["third"][ids[:, 2:]]).max(axis=1)
            four = (t["front"][pair[:, :-2]] + t["back"][pair[:, 2:]]).max(axis=1)
            z = np.maximum(np.concatenate((two, three, four), axis=1) + self.bias, 0) @ self.out + self.shift
            z -= z.max(axis=1, keepdims=True)
            out[at : at + 32] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def trained(docs: DataFrame, how: Training) -> ByteNetwork | None:
    """A network from the labelled documents whose fold isn't 1; None if there are none."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.most_langs).collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    chance = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], how.per_lang / r["count"])))
    order = F.xxhash64(F.lit("langid"), "doc_id", "text")
    picked = rows.where(F.pmod(order, F.lit(1_000_003)) / 1_000_003.0 < chance[F.col("lang")])
    picked = picked.dropDuplicates(["doc_id", "lang", "text"])  # a repeated row is learnt once
    start = F.pmod(order, F.greatest(F.length("text") - how.chars, F.lit(1))) + 1
    found = picked.select("lang", F.substr("text", start.cast("int"), F.lit(how.chars)).alias("t")).collect()
    draw, x, y = np.random.default_rng(how.seed), [], []
    for lang, t in sorted(found):
        t = t.encode()
        x += [t[:WINDOW], t[: int(draw.integers(24, WINDOW))]]
        y += [langs.index(lang)] * 2
    net = ByteNetwork(langs, how.seed)
    if x:
        net.train(windows(x)[0].astype(np.intp), np.array(y), how)
    return net


def language(docs: DataFrame, how: Training = Training()) -> Callable[[Column], Column]:
    """A function of a text column that gives (lang_pred, score), by a network trained on docs (doc_id, text, lang)."""
    net = trained(docs, how)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tables = net.tables()
        for texts, letters in batches:
            parts = [predicted(net, tables, texts[at : at + 512], letters[at : at + 512].to_numpy(dtype=bool)) for at in range(0, len(texts), 512)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    def of(text: Column) -> Column:
        if net is None:
            return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        return run(text, F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)))

    return of


def predicted(net: ByteNetwork, tables: dict, texts: pd.Series, letters: np.ndarray) -> pd.DataFrame:
    """The language of each text and its score: the mean of its windows' log probabilities, weighted by letters, and its softmax; of equal ones the first language by code point."""
    x, doc = windows([(t or "").encode() for t in texts])
    logs = net.log_probabilities(x, tables)
    weight = np.count_nonzero(x, axis=1) + 1e-3
    total = np.zeros((len(texts), len(net.langs)))
    np.add.at(total, doc, logs * weight[:, None])
    total /= np.bincount(doc, weight, len(texts))[:, None]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return pd.DataFrame({"lang_pred": [net.langs[k] if ok else "und" for k, ok in zip(p.argmax(axis=1), letters, strict=True)], "score": np.where(letters, p.max(axis=1), 0.0)})


def identify_language(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """docs (doc_id, text, lang, ...) to (doc_id, held_out, lang_pred, score).

    A byte network learns from a bounded sample (`Training`) of the labelled
    documents outside the held-out fold, crc32(doc_id as text) mod 3 = 1. Every
    whole text, however long, is cut into windows of 256 bytes; the mean of their log
    probabilities, weighted by letters, gives the language and its softmax
    the score; of equal languages the first by code point is taken. Null texts and texts without a letter are `und` with score 0,
    and so is all if nothing is labelled. Repeated rows get the same answer, a null doc_id counts as the empty text
    for the fold, other columns are left out, an empty table gives no rows.
    """
    of = language(docs, how)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), of(F.col("text")).alias("p"))
    return own.select("doc_id", "held_out", "p.lang_pred", "p.score")
