"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. SQL can't
express the learnt, tokenised and greedy stages, so ORACLE_SQL is None and tests compare each stage with
its operator's brute-force version. Nulls in any column, empty texts, repeated rows, empty tables and columns
with clashing names are handled as the operators' docstrings say: null and empty texts pass the first, third and
fourth stage (the first by the score of no features), and go in the second only if it took their last word.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from spindrift.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines, and single lines of three words or more, that occurred before are cut out, ``n_chars`` follows; a document of which no word is left goes."""
    found = line_dedup.line_dedup(docs, run=2, lone=3)
    return found.where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest doc_id."""
    return jaccard_join.one_of_each(docs, length=5, threshold=75)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
