"""Cleaning of a corpus in stages: language, near copies, benchmark passages, secrets, tokenization.

Every stage takes ``(spark, docs, folder)`` and works on all rows its predecessor kept. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm import bpe, decontaminate, language, near_dedup, secrets
from minekit.llm.queries import RANKS
from minekit.scale import fresh_path


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language cannot be told go: null texts and texts without a letter.

    The language profiles are learned from the rows with a language other than ``und``; if there are none, only the letters
    decide.
    """
    prototypes = language.train(docs.where(F.col("lang") != language.UNKNOWN))
    if not prototypes:
        return language.lettered(docs)
    named = language.predict(docs, prototypes, out="__lang", score="__score")
    return named.where(F.col("__lang") != language.UNKNOWN).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; see ``near_dedup.keep_one``.

    Rows that repeat an id with different texts are different documents.
    """
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every character of a secret becomes ``*``; all documents stay, and their lengths."""
    found = secrets.find_secrets(docs, out="__secrets")
    return found.select(*[secrets.masked(F.col(c), F.col("__secrets")).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The token ids of every document; its text is what the ids decode to."""
    tokens = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.encode_decode(docs, tokens, public_tokenizers.PATTERN, decoded="text")


STAGES = [
    ("language", known_language),
    ("near-dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte-bpe", encoded),
]
#: No SQL form: language profiles, consistent sampling and merge replay are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again for the next one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, folder)
