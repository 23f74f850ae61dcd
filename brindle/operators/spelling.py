"""Known words, spelling repair and segmentation of run-together words, against a dictionary table.

Everything is decided once a distinct word by joins with the dictionary, so neither
side has to fit into a task; the repairs then go back into the texts.
"""

from __future__ import annotations

import re

try:
    import ahocorasick
except ImportError:  # then spans are joined
    ahocorasick = None
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.relational import dealt, within_one_edit
from brindle.operators.segments import LONGEST, PER_CHARACTER, PER_WORD, Segmenter, best_cuts, filter_of, joined  # noqa: F401
from brindle.session import stored
from brindle.sources.loaders import spread

#: Endings of inflected words: ending, length that the word must exceed, letters to cut, letters to add (fixed values).
ENDINGS = (("'s", 0, 2, ""), ("s", 3, 1, ""), ("ies", 4, 3, "y"), ("ed", 4, 2, ""), ("ed", 4, 1, ""), ("ing", 5, 3, ""), ("ing", 5, 3, "e"), ("er", 4, 2, ""), ("est", 5, 3, ""))
#: What optical reading takes for something else, in the order applied (fixed values).
TYPOS = (("rn", "m"), ("cl", "d"), ("1", "l"), ("0", "o"), ("5", "s"), ("8", "b"), ("vv", "w"))
#: Characters that look alike, those of the same case first (fixed values).
ALIKE = {"i": "lI1", "I": "il1", "l": "iI1", "1": "iIl", "0": "Oo", "O": "0o", "o": "0O"}
#: What is no ASCII letter, and what parts words in a line.
LETTERS, WORD = re.compile("[^A-Za-z]"), re.compile(r"[^ \t\n\x0b\f\r]+")
#: Forms of a dictionary that are sent to all tasks, and spans that are known to pass a filter of a larger one wrongly.
MOST_FORMS = MOST_WRONG = 1_000_000
#: Words whose cuts a task keeps.
KEPT = 1 << 17


def inflected(dictionary: DataFrame) -> DataFrame:
    """(form): the lower-case words that the terms of dictionary (term) make known, themselves and with `ENDINGS`; no single letters other than a and i.

    A term has a few forms, while texts have far more words (and spans of
    words) to look up, so the forms are what is made.
    """
    t = F.col("term")
    made = [t]
    for end, least, cut, add in ENDINGS:
        form = F.concat(F.substr(t, F.lit(1), F.length(t) - len(add)), F.lit(end[-cut:]))
        made.append(F.when(F.endswith(t, F.lit(add)) & F.endswith(form, F.lit(end)) & (F.octet_length(form) > least), form))
    forms = dictionary.select("term").distinct().select(F.explode(F.array_distinct(F.array_compact(F.array(*made)))).alias("form"))
    return forms.where((F.octet_length("form") != 1) | F.col("form").isin("a", "i")).distinct()


def known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The distinct words (word) of which dictionary (term) has a form, in any case."""
    w = words.select("word").distinct()
    return w.join(inflected(dictionary), F.lower("word") == F.col("form"), "left_semi")


def _restored(fixed: Column, original: Column) -> Column:
    """fixed in the case of original: as it is for lower case, capitals for up to three characters, else its first letter."""
    first = F.substring(original, 1, 1)
    capital = F.when((first != F.lower(first)), F.concat(F.upper(F.substring(fixed, 1, 1)), F.substr(fixed, F.lit(2)))).otherwise(fixed)
    return F.when(original == F.lower(original), fixed).when(F.length(original) <= 3, F.upper(fixed)).otherwise(capital)


def spelling_fixes(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, fixed) for the words (word) that are unknown and can be repaired: misread groups of letters, then one look-alike character, then one edit.

    Known words, numbers, punctuation and words of four characters or more with capitals stay.
    """
    parts = F.regexp_extract("word", r"""(?s)^(.*?)([.,!?;:)\]"'”’]*)$""", 1)
    w = words.select("word").distinct().withColumn("clean", parts).where(F.col("clean").rlike(r"[^\d\p{P}]") & ((F.col("clean") == F.lower("clean")) | (F.length("clean") < 4)))
    low = F.lower("clean")
    typo = low
    for old, new in TYPOS:
        typo = F.replace(typo, F.lit(old), F.lit(new))
    alike = F.create_map(*(F.lit(x) for k, v in ALIKE.items() for x in (k, v)))
    swap = lambda i: F.transform(F.split(F.coalesce(alike[F.substr("clean", i, F.lit(1))], F.lit("")), ""), lambda c: F.when(c != "", F.concat(F.substr("clean", F.lit(1), i - 1), c, F.substr("clean", i + 1))))
    swaps = F.when(F.length("clean") >= 2, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("clean"), F.lit(1))), swap)))
    tries = F.filter(F.concat(F.array(F.when(typo != low, typo)), F.coalesce(swaps, F.array().cast("array<string>"))), lambda c: c.isNotNull())
    cand = dealt(w, "clean").select("clean", F.posexplode(F.concat(F.array("clean"), tries)).alias("place", "cand"))
    hits = cand.join(inflected(dictionary), F.lower("cand") == F.col("form"), "left_semi").groupBy("clean").agg(F.min(F.struct("place", "cand")).alias("hit"))
    seen = w.join(hits, "clean", "left").where("hit is null or hit.place > 0")
    lost = seen.where("hit is null").select(F.lower("clean").alias("word"))
    near = within_one_edit(lost, dictionary).select(F.col("word").alias("low"), "suggestion")
    found = seen.withColumn("low", F.when(F.col("hit").isNull(), F.lower("clean"))).join(near, "low", "left").withColumn("fixed", F.coalesce("hit.cand", "suggestion"))
    return found.select("word", F.concat(_restored(F.col("fixed"), F.col("clean")), F.substr("word", F.length("clean") + 1)).alias("fixed")).where("word <> fixed")


def best_split(word: str, known: set[tuple[int, int]]) -> str:
    """word cut into parts of the highest score: a known span earns its squared length, unknown characters and every part cost; of equal scores the longest last part wins.

    A word of up to 14 letters is only cut into parts that are all known.
    """
    return joined(word, best_cuts(len(word), known), known)


def automaton_of(forms: DataFrame, most: int):
    """The forms (form) as an automaton that finds all of them in one walk over a word; None if there are more than `most`."""
    if forms.limit(most + 1).count() > most:
        return None
    found = ahocorasick.Automaton()
    for (form,) in forms.where(F.length("form") <= LONGEST).collect():  # `most` words at most
        found.add_word(form, len(form))
    if len(found):
        found.make_automaton()
    return found


def long_words(words: DataFrame, word: str) -> DataFrame:
    """The words that may be cut: of ten bytes or more, at least ten ASCII letters (clean) and these 0.7 of it."""
    w = words.where(F.octet_length(word) >= 10).withColumn("clean", F.regexp_replace(word, "[^A-Za-z]", ""))
    return w.where((F.length("clean") >= 10) & (F.length("clean") >= 0.7 * F.octet_length(word)))


def walked(clean: str, found) -> str:
    """clean cut by the forms that an automaton finds in it; a word without any stays."""
    spans = {(end + 1 - n, end + 1) for end, n in found.iter(clean.lower())} if len(found) else set()
    return best_split(clean, spans) if spans else clean


def word_splits(words: DataFrame, dictionary: DataFrame, most: int = MOST_FORMS) -> DataFrame:
    """(word, fixed) for run-together words (word) of ten bytes or more, at least ten ASCII letters and these 0.7 of it: its letters with blanks between the words found in them.

    Known spans have up to LONGEST letters. A dictionary of up to `most` forms, which is that of any language, goes to all tasks as an
    automaton, and each word is walked once. Spans are joined with the forms of a larger one. The rows are the same.
    """
    w = long_words(words.select("word").distinct(), "word")
    forms = inflected(dictionary)
    walker = automaton_of(forms, most) if ahocorasick is not None else None
    if walker is not None:
        sent = words.sparkSession.sparkContext.broadcast(walker)

        @F.pandas_udf("string")
        def walk(clean: pd.Series) -> pd.Series:
            return clean.map(lambda c: walked(c, sent.value))

        return dealt(w, "word").withColumn("clean", F.regexp_replace("word", "[^A-Za-z]", "")).withColumn("fixed", walk("clean")).where("clean <> fixed").select("word", "fixed")
    ends = lambda a: F.transform(F.sequence(a + 1, F.least(a + LONGEST, F.length("clean"))), lambda b: F.struct(a.alias("a"), b.alias("b")))
    spans = dealt(w, "clean").select("clean", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.length("clean") - 1), ends))).alias("s"))
    spans = spans.select("clean", "s", F.lower(F.substr("clean", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))).alias("word"))
    known = spans.join(forms, F.col("word") == F.col("form"), "left_semi").groupBy("clean").agg(F.collect_list("s.a").alias("starts"), F.collect_list("s.b").alias("ends"))

    @F.pandas_udf("string")
    def cut(clean: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([best_split(c, set(zip(map(int, a), map(int, b), strict=True))) for c, a, b in zip(clean, starts, ends, strict=True)])

    return w.join(known.select("clean", cut("clean", "starts", "ends").alias("fixed")), "clean").where("clean <> fixed").select("word", "fixed")


def distinct_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): what blanks and line breaks part, once a document."""
    return df.select(key, F.explode(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda x: x != ""))).alias("word"))


def replace_words(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """df with the words of fixes (word, fixed) replaced in text; lines stay lines, the blanks of a changed text are squeezed, other texts stay as they are."""
    mine = distinct_words(df, key, text).join(fixes, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("_fixes"))
    line = lambda x: F.array_join(F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.col("_fixes")[w], w)), " ")
    done = F.when(F.col("_fixes").isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.split(text, "\n", -1), line), "\n"))
    return df.join(mine, key, "left").withColumn(text, done).drop("_fixes")


def _once(df: DataFrame, dictionary: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The distinct words of df and terms of dictionary as tables, of sizes that the planner knows: several joins read them."""
    words = distinct_words(spread(df.select(key, text)), key, text).select("word").distinct()
    return stored(words, "words"), stored(dictionary.select("term").distinct(), "terms")


def spell_fix(df: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the misspelt words of text repaired."""
    return replace_words(df, key, text, spelling_fixes(*_once(df, dictionary, key, text)))


def _long(text: str) -> list[str]:
    """The words of a text that may be cut."""
    return [w for w in WORD.findall(text) if len(w) > 9]


def _letters(word: str) -> str:
    """The ASCII letters of a word that may be cut; '' for others, as in `long_words`."""
    size, clean = len(word.encode()), LETTERS.sub("", word)
    return clean if size >= 10 and len(clean) >= 10 and len(clean) >= 0.7 * size else ""


def _texts(batches, text: str):
    """Parts of batches that are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield part, part.column(text).to_pylist()


def _split_in_place(df: DataFrame, text: str, sent, cutter) -> DataFrame:
    """df with its long words cut where they stand, and (used) what these cuts rest on, once or more often. No word leaves its row, and a task has a few texts at a time.

    cutter makes of the broadcast `sent` a function of words of letters that gives them cut, and a set of what it used.
    """

    def run(batches):
        cut, kept, told = cutter(sent.value), {}, set()

        def one(word: str) -> str:
            return kept.get(word, word) if len(word) > 9 else word

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(text).to_pylist()
                for done in (kept, told):
                    if len(done) > KEPT:
                        done.clear()
                new = list({w for t in texts if t for w in _long(t) if w not in kept})
                clean = [_letters(w) for w in new]
                made, used = cut([c for c in clean if c])
                made = iter(made)
                for w, c in zip(new, clean, strict=True):
                    fixed = next(made) if c else ""
                    kept[w] = fixed if " " in fixed else w
                for i, t in enumerate(texts):
                    if t and any(kept[w] != w for w in _long(t)):
                        texts[i] = "\n".join(" ".join(map(one, WORD.findall(line))) for line in t.split("\n"))
                part = part.set_column(part.schema.get_field_index(text), text, pa.array(texts, pa.string()))
                yield part.append_column("used", pa.array([list(used - told)] + [None] * (len(texts) - 1), pa.list_(pa.string())))
                told |= used

    return spread(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("used", T.ArrayType(T.StringType()))]))


def _split_by_filter(df: DataFrame, text: str, terms: DataFrame) -> DataFrame | None:
    """df with its long words cut by a filter of terms (term), stored; None if too many spans pass it wrongly.

    Spans on which a cut rests are looked up, and without those that are no forms all is cut again, until there are none. What is
    best among more spans than are known, and needs none but known ones, is best among these: so nothing else has to be looked up.
    """
    own = stored(terms.where(F.col("term").rlike(r"^[a-z]+\z") & (F.length("term") <= LONGEST)), "filtered-terms")
    bits, forms, wrong = filter_of(own), inflected(own), frozenset()
    while len(wrong) <= MOST_WRONG:
        # sent as plain values: a broadcast is unpickled where this library may not be installed
        sent = df.sparkSession.sparkContext.broadcast((bits, wrong))
        made = stored(_split_in_place(df, text, sent, lambda own: Segmenter(*own).cut), "split", compression="zstd")
        used = made.select(F.explode("used").alias("form")).distinct()
        new = used.join(forms, "form", "left_anti").limit(MOST_WRONG + 1).collect()
        if not new:
            return made.drop("used")
        wrong |= {r["form"] for r in new}
    return None


def split_words(df: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_FORMS) -> DataFrame:
    """df with the run-together words of text parted where they stand, by an automaton of the dictionary's forms or, if there are more than `most`, by a filter of its terms, whose choices are looked up."""
    terms = stored(dictionary.select("term").distinct(), "terms")
    # a term of two letters or more is a form itself
    few = ahocorasick is not None and terms.where("length(term) > 1").count() <= most
    if few and (walker := automaton_of(inflected(terms), most)) is not None:
        sent = df.sparkSession.sparkContext.broadcast(walker)
        return _split_in_place(df, text, sent, lambda found: lambda words: ([walked(w, found) for w in words], set())).drop("used")
    if (made := _split_by_filter(df, text, terms)) is not None:
        return made
    words, terms = _once(df, terms, key, text)
    return replace_words(df, key, text, word_splits(words, terms, most))
