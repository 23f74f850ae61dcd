"""What users plug in: embedders, scorers, loaders by extension, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scalars import CJK

#: Files of an Arrow batch that are Python objects at once.
ROWS = 256

#: By name: a function without arguments that makes, once a task, a function of texts giving a row of floats for each.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


def register_embedder(name: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    EMBEDDERS[name] = make


def embed_with(name: str | None, text, dim: int = 384) -> Column:
    """Vectors of texts by the embedder registered under name, or by hashing where there is none; null texts are empty."""
    from brindle.operators.vectors import hash_embed

    make = EMBEDDERS.get(name)
    if make is None:
        return hash_embed(text, dim)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)))

    return run(text)


def scorer(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """score(query, document) as a column function for `rerank`; a pair that fails scores null."""

    def one(q: str, t: str) -> float | None:
        try:
            return float(score(q or "", t or ""))
        except (ValueError, TypeError, ArithmeticError):
            return None

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([one(q, t) for q, t in zip(queries, texts, strict=True)], dtype="float64")

    return run


def load_with(files: DataFrame, loaders: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, text, error) of files (path, ext, content) by the loader of their extension; a file that fails or has none carries an error."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = []
                for path, ext, content in zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns), strict=True):
                    try:
                        rows.append((path, loaders[ext](content), None))
                    except KeyError:
                        rows.append((path, None, "no loader"))
                    except Exception as e:  # a user's loader may raise anything, and must not end the job
                        rows.append((path, None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "text", "error"])

    return files.select("path", "ext", "content").mapInArrow(run, "path string, text string, error string")


#: Functions for SQL that stay in the JVM.
SQL_FUNCTIONS = (
    rf"tokenize(t string) returns array<string> return flatten(transform(regexp_extract_all(lower(t), r'[\p{{L}}\p{{Nd}}]+', 0), x -> if(length(x) > 2 and x rlike '^{CJK}+$', transform(sequence(1, length(x) - 1), i -> substr(x, i, 2)), array(x))))",
    r"contains_word(t string, word string) returns boolean return trim(word) <> '' and regexp_like(lower(t), concat('(?<![a-z0-9])', regexp_replace(lower(trim(word)), r'([\\.\[\]{}()*+?^$|-])', r'\\$1'), '(?![a-z0-9])'))",
    "score_level(rate double) returns int return case when rate >= 0.9 then 4 when rate >= 0.65 then 3 when rate >= 0.4 then 2 when rate >= 0.2 then 1 else 0 end",
)


def register_sql(spark: SparkSession, dim: int = 384) -> None:
    """tokenize, contains_word, score_level and hash_embed as functions of the session's SQL."""
    from brindle.operators.vectors import embedded

    for f in SQL_FUNCTIONS:
        spark.sql(f"create or replace temporary function {f}")

    @F.pandas_udf("array<float>")
    def hash_embed(texts: pd.Series) -> pd.Series:
        return embedded(texts, dim)

    spark.udf.register("hash_embed", hash_embed)
