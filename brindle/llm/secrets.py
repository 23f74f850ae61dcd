"""Secret scans by patterns and character Markov models (operator 5)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stored

KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Symbols of the models, after the start symbol 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Labelled random strings besides those that the corpus has: alphabets to draw from.
RANDOM_KINDS = (ALPHABET[:62], "0123456789abcdef", ALPHABET[26:62], ALPHABET[:64], ALPHABET[:26])
#: Counts that the shorter context is worth where the longer one is backed off to it.
BACKED_OFF = 5
#: Scores of strings that a task keeps.
REMEMBERED = 100_000
#: Least log-likelihood ratio of a span, in nats, and per character, where the ordinary strings ask for no more.
LEAST, LEAST_PER_CHAR = 10.0, 0.4
#: Share of the ordinary strings of `CANDIDATE` length that may pass each threshold.
FALSE_HITS = 0.001

_TABLE = np.zeros(128, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _TABLE[ord(_c)] = _i + 1


@dataclass(frozen=True)
class Sample:
    """About looked_at documents by a seeded hash, of these at most docs with a hit and docs without, `chars` characters of each from the hit or a seeded place; drawn: random strings of each kind that are added."""

    looked_at: int = 40_000
    docs: int = 2000
    chars: int = 4000
    drawn: int = 60


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def codes(s: str) -> np.ndarray:
    return _TABLE[np.frombuffer(s.encode("ascii"), np.uint8)]


def contexts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last character but one and the last one before each of c, 0 where there is none."""
    padded = np.concatenate(([0, 0], c)).astype(np.intp)
    return padded[:-2], padded[1:-1]


class Markov:
    """Log probabilities of a character after two others, from labelled strings, backed off to the last one and to the characters alone with the weight of BACKED_OFF counts each."""

    def __init__(self, samples: list[str]):
        n = len(ALPHABET) + 1
        counts = np.zeros((n, n, n))
        for s in samples:
            c = codes(s)
            np.add.at(counts, (*contexts(c), c), 1)
        two = counts[:, :, 1:]
        one = two.sum(axis=0)
        single = one.sum(axis=0) + 0.5
        one = one + BACKED_OFF * single / single.sum()
        two = two + BACKED_OFF * one / one.sum(axis=1, keepdims=True)
        self.log = np.log(two / two.sum(axis=2, keepdims=True))


def labelled_samples(docs: DataFrame, how: Sample) -> tuple[list[str], list[str]]:
    """(random, ordinary) labelled strings of a bounded sample (`Sample`): what the patterns match, and the identifiers that several documents have; `drawn` random strings of each of `RANDOM_KINDS` are added."""
    order = F.xxhash64(F.lit("secrets"), "doc_id", "text")
    part = lambda at: F.substr("text", at, F.lit(how.chars))
    hit = r"(?i)(?:passwd|password|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
    own = docs.where("text is not null").select("doc_id", "text").withColumn("order", order)
    # the hash is looked at before any text is searched
    chance = min(1.0, how.looked_at / max(docs.count(), 1))
    some = own.where(F.pmod("order", F.lit(1_000_003)) / 1_000_003.0 < chance)
    at = F.regexp_instr("text", F.lit(hit)).cast("int")
    start = F.when(F.col("at") > 0, F.greatest(F.col("at") - 20, F.lit(1))).otherwise((F.pmod("order", F.greatest(F.length("text") - how.chars, F.lit(1))) + 1).cast("int"))
    parts = some.withColumn("at", at).select("order", (F.col("at") > 0).alias("hit"), part(start).alias("t")).groupBy("order", "hit").agg(F.min("t").alias("t"))  # a repeated row once
    parts = stored(parts, "secret-sample")
    kept = parts.where("hit").orderBy("order").limit(how.docs).union(parts.where("not hit").orderBy("order").limit(how.docs))
    random, found = [], Counter()
    for (t,) in sorted(kept.select("t").collect()):
        spans = base_spans(t)
        random += [s for a, _, b in spans for s in re.findall(r"[A-Za-z0-9+/_=-]{8,}", t[a:b])[-1:]]
        found.update({m[0] for m in IDENTIFIER.finditer(t) if not any(a < m.end() and m.start() < b for a, _, b in spans)})
    draw = np.random.default_rng(5)
    for kind in RANDOM_KINDS:
        random += ["".join(draw.choice(list(kind), draw.integers(20, 41))) for _ in range(how.drawn)]
    # what only one document has may be a secret that no pattern knows
    ordinary = {s for s, n in found.items() if n > 1} or set(found)
    # identifiers in capitals are as ordinary, and too few to learn from
    ordinary |= {s.upper() for s in ordinary}
    return sorted(random), sorted(ordinary)


def log_ratio(ratio: np.ndarray, s: str) -> float:
    c = codes(s).astype(np.intp)
    return float(ratio[(*contexts(c), c - 1)].sum())


class Detector:
    """Log-likelihood ratio of two Markov models, and its least values: in all and per character, what `FALSE_HITS` of a quarter of the ordinary strings exceed that the thresholds' models didn't see."""

    def __init__(self, random: list[str], ordinary: list[str]):
        # a fixed hash parts the strings, so that neighbours in the alphabet part too
        held = lambda s: hashlib.blake2b(s.encode(), digest_size=1).digest()[0] % 4 == 0
        seen = Markov([s for s in random if not held(s)]).log - Markov([s for s in ordinary if not held(s)]).log
        scores = [(log_ratio(seen, s), len(s)) for s in ordinary if held(s) and CANDIDATE.fullmatch(s)]
        top = lambda x, floor: max(floor, float(np.quantile(x, 1 - FALSE_HITS))) if scores else floor
        self.per_char = top([r / n for r, n in scores], LEAST_PER_CHAR)
        self.least = top([r for r, _ in scores], LEAST)
        self.ratio = (Markov(random).log - Markov(ordinary).log).astype(np.float32)

    def __call__(self, s: str) -> bool:
        return log_ratio(self.ratio, s) >= max(self.least, self.per_char * len(s))


def scan_secrets(docs: DataFrame, how: Sample = Sample()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row of docs.

    Every whole text is scanned, however long (null: empty). The pattern matches stay as
    they are; kind markov adds runs of 8 or more of `ALPHABET`, letters or digits alone too, that
    overlap none of them and that a second-order Markov model of random strings finds
    likelier than one of ordinary identifiers, by the values of `Detector`. The
    models are trained on a bounded sample of the corpus: see
    `labelled_samples`. Repeated rows get equal spans, other columns are left
    out, an empty table gives no rows.
    """
    secret = Detector(*labelled_samples(docs, how))

    def added(text: str, base: list, known: dict) -> list:
        out = []
        for m in CANDIDATE.finditer(text):
            if (score := known.get(m[0])) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                score = known[m[0]] = secret(m[0])
            if score and not any(a < m.end() and m.start() < b for a, _, b in base):
                out.append((m.start(), 3, m.end()))
        return out

    joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        known = {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added(text, base, known)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
