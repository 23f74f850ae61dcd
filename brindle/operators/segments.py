"""Words without blanks cut into known spans of letters, for many words at once, by a filter of the dictionary's terms.

A filter has no term missing but lets a few other spans pass, so whoever cuts by it looks up the spans that were used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of a segmentation: a word, a character of an unknown word (fixed values); longest word.
PER_WORD, PER_CHARACTER, LONGEST = 15.0, 6.0, 30
#: Bits of a filter for each term while it has no more than MOST_BITS (64 MB); a term's bits lie in one page of 2**PAGE.
BITS, MOST_BITS, PAGE = 64, 1 << 29, 15
#: Constants of the rolling hash and of splitmix64 (fixed values); a term has three times four bits.
BASE, GAMMA, MIX1, MIX2, ROUNDS = 0x100000001B3, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 3
#: Spans looked up at once, and lengths up to which words are cut together; longer ones are cut alone.
SPANS, WIDTHS = 1 << 19, (12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 64)


def best_cuts(size: int, known: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts (start, end) of the highest score of a word of so many letters: a known span earns its squared length, unknown characters and every part cost; of equal scores the longest last part wins."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, size + 1):
        value, back = -20.0 * end, end - 1
        for start in range(max(0, end - LONGEST), end):
            gain = (end - start) ** 2 if (start, end) in known else -PER_CHARACTER * (end - start)
            if best[start][0] - PER_WORD + gain > value:
                value, back = best[start][0] - PER_WORD + gain, start
        best.append((value, back))
    return followed(size, lambda end: best[end][1])


def followed(end: int, back) -> list[tuple[int, int]]:
    cuts = []
    while end:
        cuts.append((back(end), end))
        end = cuts[-1][0]
    return cuts[::-1]


def joined(word: str, cuts: list[tuple[int, int]], known) -> str:
    """word with blanks between the cuts; one of up to 14 letters only if all of them are known."""
    return word if len(word) <= 14 and not all(c in known for c in cuts) else " ".join(word[a:b] for a, b in cuts)


def mixed(h: np.ndarray) -> np.ndarray:
    z = h + np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def places(h: np.ndarray):
    """For each step the function of hashes that gives their next bit in a page."""
    for _ in range(ROUNDS):
        h = mixed(h)
        for shift in range(0, 4 * PAGE, PAGE):
            yield (h >> np.uint64(shift)) & np.uint64((1 << PAGE) - 1)


def columns(words: list[str], width: int) -> np.ndarray:
    """A column for each word of ASCII letters, with zeros after it."""
    raw = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("ascii"), np.uint8)
    return np.ascontiguousarray(raw.reshape(len(words), width).T).astype(np.uint64)


def rolled(letters: np.ndarray) -> np.ndarray:
    """The rolling hash of what stands before each place of a column."""
    out = np.zeros((len(letters) + 1, letters.shape[1]), np.uint64)
    for i, x in enumerate(letters):
        out[i + 1] = out[i] * np.uint64(BASE) + x
    return out


def span_hashes(before: np.ndarray, size: int) -> np.ndarray:
    return before[size:] - before[: len(before) - size] * np.uint64(pow(BASE, size, 1 << 64))


def hashes(words: list[str]) -> np.ndarray:
    out, sizes = np.zeros(len(words), np.uint64), np.array([len(w) for w in words], int)
    for n in set(sizes.tolist()):
        at = np.flatnonzero(sizes == n)
        out[at] = rolled(columns([words[i] for i in at], n))[-1]
    return out


def filter_of(terms: DataFrame) -> np.ndarray:
    """The bits of a filter of the terms (term) of small ASCII letters. Pages are made in tasks; all together have 64 MB at most."""
    pages = max(2, min(MOST_BITS, 1 << (BITS * max(1, terms.count()) - 1).bit_length()) >> PAGE)

    @F.pandas_udf("long")
    def hashed(t: pd.Series) -> pd.Series:
        return pd.Series(mixed(hashes(t.tolist())).view(np.int64))

    @F.pandas_udf("binary")
    def page(lists: pd.Series) -> pd.Series:
        made = []
        for own in lists:
            bits = np.zeros(1 << PAGE, np.uint8)
            for at in places(np.array(own, np.int64).view(np.uint64)):
                bits[at] = 1
            made.append(np.packbits(bits, bitorder="little").tobytes())
        return pd.Series(made)

    own = terms.select(hashed("term").alias("h")).groupBy(F.shiftrightunsigned("h", 65 - pages.bit_length()).alias("page")).agg(F.collect_list("h").alias("own"))
    out = np.zeros((pages, 1 << (PAGE - 3)), np.uint8)
    for number, bits in own.select("page", page("own")).toLocalIterator():
        out[number] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


class Segmenter:
    """Cuts words by a filter, without the spans that are known to pass it wrongly."""

    def __init__(self, bits: np.ndarray, wrong: frozenset[str] = frozenset()):
        self.bits, self.wrong, self.wrong_hashes = bits, wrong, hashes(list(wrong))
        self.shift = np.uint64(64 - (len(bits).bit_length() - 1 - (PAGE - 3)))

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Whether the filter lets each hash pass; what a bit rules out needs no further one."""
        out, at, h = np.zeros(len(h), bool), np.arange(len(h)), mixed(h)
        page = (h >> self.shift) << np.uint64(PAGE)
        for _ in range(ROUNDS):
            h = mixed(h)
            for shift in range(0, 4 * PAGE, PAGE):
                bit = page | ((h >> np.uint64(shift)) & np.uint64((1 << PAGE) - 1))
                on = (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at, h, page = at[on], h[on], page[on]
        out[at] = True
        return out

    def known(self, low: list[str], width: int) -> list[np.ndarray]:
        """For each size from 1 the table of starts and words of whether the span may be a form of a term (the rules of `spelling.ENDINGS`)."""
        x, sizes = columns(low, width), np.array([len(w) for w in low])
        before, n, k = rolled(x), width, len(low)
        top = min(LONGEST, n)
        spans = [None, *(span_hashes(before, s) for s in range(1, top + 1))]
        inside = [None, *(np.arange(s, n + 1)[:, None] <= sizes for s in range(1, top + 1))]
        term, ending = [np.zeros((n + 1 - s, k), bool) for s in range(top + 1)], [np.zeros((n + 1 - s, k), bool) for s in range(top + 1)]
        is_ = lambda text: np.logical_and.reduce([x[i : n + 1 - len(text) + i] == ord(c) for i, c in enumerate(text)]) if n >= len(text) else np.zeros((0, k), bool)
        asked = [(term[s], np.flatnonzero(inside[s]), spans[s], None) for s in range(1, top + 1)]
        # where a term lost a letter to its ending: that letter follows the stem
        for text, least, letter in (("ing", 6, "e"), ("ies", 5, "y")):
            ends = is_(text)
            asked += [(ending[s], np.flatnonzero(ends[s - 3 :] & inside[s]), spans[s - 3][: n + 1 - s], ord(letter)) for s in range(least, top + 1)]
        while asked:
            some = [asked.pop()]
            while asked and sum(len(a[1]) for a in some) + len(asked[-1][1]) <= SPANS:
                some.append(asked.pop())
            h = [(v := span.reshape(-1)[at]) if letter is None else span.reshape(-1)[at] * np.uint64(BASE) + np.uint64(letter) for _, at, span, letter in some]
            ok = self.passing(np.concatenate(h))
            for (table, at, _, _), own in zip(some, np.split(ok, np.cumsum([len(a[1]) for a in some])[:-1]), strict=True):
                table.reshape(-1)[at] = own
        found = [None]
        for s in range(1, top + 1):
            m = n + 1 - s
            now = term[s] & inside[s] & ((x[:m] == ord("a")) | (x[:m] == ord("i"))) if s == 1 else term[s].copy()
            for text, least, cuts in (("s", 4, (1,)), ("ed", 5, (2, 1)), ("ing", 6, (3,)), ("er", 5, (2,)), ("est", 6, (3,))):
                if s >= least:
                    now |= is_(text)[s - len(text) :] & inside[s] & np.logical_or.reduce([term[s - c][:m] for c in cuts])
            now |= ending[s]
            for at in np.flatnonzero(now.reshape(-1) & np.isin(spans[s].reshape(-1), self.wrong_hashes)) if self.wrong else ():
                start, word = divmod(int(at), k)
                if low[word][start : start + s] in self.wrong:
                    now[start, word] = False
            found.append(now)
        return found

    def cut(self, words: list[str]) -> tuple[list[str], set[str]]:
        """The words of ASCII letters with blanks between their parts, and the spans, in small letters, that these rest on."""
        out, used = list(words), set()
        sizes = np.array([len(w) for w in words], int)
        group = np.searchsorted(WIDTHS, sizes)
        for g in set(group.tolist()):
            at = np.flatnonzero(group == g)
            width = WIDTHS[g] if g < len(WIDTHS) else 0
            step = max(1, SPANS // (width * min(width, LONGEST))) if width else 1
            for first in range(0, len(at), step):
                own = at[first : first + step].tolist()
                low = [words[i].lower() for i in own]
                for i, (text, spans) in zip(own, self._cut([words[i] for i in own], low, width or len(low[0]), bool(width)), strict=True):
                    out[i] = text
                    used.update(spans)
        return out, used

    def _cut(self, words: list[str], low: list[str], width: int, together: bool):
        known = self.known(low, width)
        k, cells = len(words), set()
        if together:
            best, back = np.zeros((width + 1, k), np.int32), np.zeros((width + 1, k), np.int32)
            for end in range(1, width + 1):
                value, place = np.full(k, -20 * end, np.int32), np.full(k, end - 1, np.int32)
                for start in range(max(0, end - LONGEST), end):
                    s = end - start
                    gained = best[start] + np.where(known[s][start], np.int32(s * s - PER_WORD), np.int32(-PER_CHARACTER * s - PER_WORD))
                    better = gained > value
                    value, place = np.where(better, gained, value), np.where(better, np.int32(start), place)
                best[end], back[end] = value, place
        else:
            cells = {(int(a), int(a) + s) for s in range(1, len(known)) for a in np.flatnonzero(known[s][:, 0])}
        for j, word in enumerate(words):
            n = len(word)
            cuts = followed(n, lambda end: int(back[end, j])) if together else best_cuts(n, cells)  # noqa: B023
            sure = {(a, b) for a, b in cuts if b - a < len(known) and known[b - a][a, j]}
            # a word of which nothing is known stays, so one that no known span helps to cut rests on all it has
            spans = sure or {(a, a + s) for s in range(1, len(known)) for a in range(n + 1 - s) if n > LONGEST and known[s][a, j]}
            yield (joined(word, cuts, sure) if spans else word), [low[j][a:b] for a, b in spans]
