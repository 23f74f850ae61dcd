"""A training corpus from `documents`, in stages that each read what the one before has written.

Each stage takes nulls in any column, repeated rows and empty tables as the
operator that it calls says; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stored, table
from brindle.llm.decontam import without_benchmark
from brindle.llm.langid import language
from brindle.llm.linededup import without_repeated_lines
from brindle.llm.mixing import mixed_sources
from brindle.llm.neardup import without_near_duplicates

#: Least score of a language (a softmax over the learned ones): see the README for what it costs.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go, and those whose language the network gives less than LEAST_SCORE. Each row by its own text, so repeated rows go or stay together; of equally likely languages either will do, as the score alone decides."""
    p = language(docs)(F.col("text"))
    return docs.where((p["lang_pred"] != "und") & (p["score"] >= LEAST_SCORE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in the first one only; documents of which nothing stays go."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of the benchmark go, each row by its own text."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; every row has its own answer, and equal rows may swap theirs."""
    return mixed_sources(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix)]

#: Stages with a trained model and with string tiling have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
