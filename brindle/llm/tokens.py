"""Word-piece token counts by a linear longest-match automaton (operator 3)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 500_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str) -> list[tuple[bytes, bool]]:
    """(bytes, whether it ends a word) of each piece of a tokenizer.json whose pieces mark word ends; special tokens go."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["content"] for t in made.get("added_tokens", ())}
    letters = byte_letters()
    out = []
    for piece in made["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith(WORD_END)
            out.append((bytes(letters[c] for c in piece.removesuffix(WORD_END)), ends))
    return out


class Automaton:
    """Symbols are bytes, and 256 + byte for the last byte of a word, so a piece that ends a word matches only there.

    Each trie node has a failure link to the node of what is left after the
    longest pieces are popped from its string, and how many those are. A step
    that the trie lacks follows the links, so a word of n bytes takes at most
    2n steps, and no piece is built. All single symbols count as pieces.
    """

    def __init__(self, pieces: list[tuple[bytes, bool]]):
        self.goto: dict[int, int] = {}
        piece_at, depth = {0: False}, [[]]
        singles = [((s,), True) for s in range(512)]
        for symbols, _ in [*singles, *((tuple(p[:-1]) + (p[-1] + 256 * ends,), True) for p, ends in pieces if p)]:
            node = 0
            for d, s in enumerate(symbols):
                key = node * 512 + s
                if key not in self.goto:
                    self.goto[key] = len(piece_at)
                    piece_at[len(piece_at)] = False
                    while len(depth) <= d + 1:
                        depth.append([])
                    depth[d + 1].append((node, s, self.goto[key]))
                node = self.goto[key]
            piece_at[node] = True
        self.fail, self.popped = [-1] * len(piece_at), [0] * len(piece_at)
        for level in depth:
            for parent, s, node in level:
                if piece_at[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                z, n = self.fail[parent], self.popped[parent]
                while z >= 0 and z * 512 + s not in self.goto:
                    n, z = n + self.popped[z], self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.goto[z * 512 + s], n

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of a word."""
        if not word:
            return 0
        goto, fail, popped = self.goto.get, self.fail, self.popped
        node, n = 0, 0
        for s in (*word[:-1], word[-1] + 256):
            while (to := goto(node * 512 + s)) is None:
                n, node = n + popped[node], fail[node]
            node = to
        while node:
            n, node = n + popped[node], fail[node]
        return n


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word_tokens) for each row of docs (doc_id, text).

    Texts are lower-cased and split at white space; each word is split greedily into the longest
    pieces of the vocabulary file (a parameter; its automaton is built once and sent to
    the tasks, as it is of fixed size). Null and blank texts have no words and no tokens; long texts and
    long words are counted whole, in linear time. Repeated rows get equal counts, a null doc_id stays null, other columns
    are left out, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(load_pieces(vocabulary or default_vocabulary())))

    def run(batches):
        automaton, known = sent.value, {}
        for b in batches:
            words, tokens, most = [], [], []
            for text in b.column(1):
                split = (text.as_py() or "").lower().encode().split()
                counts = []
                for w in split:
                    n = known.get(w)
                    if n is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        n = known[w] = automaton.count(w)
                    counts.append(n)
                words.append(len(split))
                tokens.append(sum(counts))
                most.append(max(counts, default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, most))], ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")
