"""Suffix-array dedup: passages of 50 words or more that occur in several documents.

A sparse suffix array: only suffixes at minimiser positions are kept, the word windows of least hash
among WINDOWS in a row, so that a repeated passage has a kept suffix at the same word of each copy.
Suffixes are sorted by the hash of their first words (equality is all that counts, so any order does) and
neighbours compared by Spark's grouping; those that agree on ``passage - WINDOWS + 1`` words in two
documents are extended: left to every word whose minimiser they are, and right to the full length. Extended
windows that two documents share are joined up to passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, scratch, staged, texts_of
from .shingles import chunks, distinct, window_hashes, words_of

#: Words that a minimiser looks at, and windows of which it is the least.
GRAM, WINDOWS = 8, 25
#: Words of the bit filter that says which suffixes have an equal neighbour (4 MB), and the keys up to which it is sharp;
#: more keys are joined to their texts.
FILTER_WORDS, FILTER_KEYS = 1 << 19, 3_000_000


def _minimisers(words: np.ndarray, passage: int) -> np.ndarray:
    """For each window of ``passage`` words, the position of its minimiser: one of its first WINDOWS words."""
    starts = len(words) - passage + 1
    if starts <= 0:
        return np.zeros(0, np.int64)
    grams = window_hashes(words, GRAM)
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOWS)[:starts].argmin(axis=1) + np.arange(starts)


def _place(keys: np.ndarray) -> np.ndarray:
    """Bits of the filter for suffix keys."""
    return (keys >> np.uint64(7)) % np.uint64(FILTER_WORDS * 64)


def repeated_windows(rows: DataFrame, passage: int = 50) -> DataFrame:
    """(uid, at, other): windows of ``passage`` words, by first word, that another of ``rows`` (uid, text) has too."""
    spark, tail = rows.sparkSession, passage - WINDOWS + 1
    rows = rows.select("uid", "text")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                keys, uids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                hashed, starts = words_of(part.column(1).to_pylist(), lower=False)
                for uid, a, b in zip(part.column(0).to_pylist(), starts, starts[1:], strict=False):
                    words = hashed[a:b]
                    at = distinct(_minimisers(words, passage))
                    if len(at):
                        keys.append(distinct(window_hashes(words, tail)[at]))
                        uids.append(np.full(len(keys[-1]), uid, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(uids))], ["key", "uid"])

    keyed = rows.mapInArrow(suffixes, "key long, uid long")
    alike = staged(keyed.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi").select("key"), "suffix-alike")

    def extended(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
        """All windows whose minimiser is a suffix with an equal neighbour; ``known`` says of which keys of a row that holds."""
        for batch in batches:
            for part in chunks(batch):
                keys, uids, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                hashed, starts = words_of(part.column(1).to_pylist(), lower=False)
                for i, (uid, a, b) in enumerate(zip(part.column(0).to_pylist(), starts, starts[1:], strict=False)):
                    words = hashed[a:b]
                    least = _minimisers(words, passage)
                    if len(least):
                        at = np.flatnonzero(known(window_hashes(words, tail)[least], part, i))
                        if len(at):
                            keys.append(window_hashes(words, passage)[at])
                            uids.append(np.full(len(at), uid, np.int64))
                            ats.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(uids)), pa.array(np.concatenate(ats).astype(np.int32))], ["key", "uid", "at"])

    if alike.count() <= FILTER_KEYS:

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = _place(batch.column(0).to_numpy().view(np.uint64)).astype(np.int64)
                one = (np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((bit // 64).astype(np.int32)), pa.array(one)], ["w", "b"])

        bits = np.zeros(FILTER_WORDS, np.int64)
        for r in alike.mapInArrow(places, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most FILTER_WORDS rows
            bits[r["w"]] = r["b"]
        sent = spark.sparkContext.broadcast(bits.view(np.uint64))

        def in_filter(keys: np.ndarray, part: pa.RecordBatch, i: int) -> np.ndarray:
            bit = _place(keys)
            return (sent.value[(bit // np.uint64(64)).astype(np.int64)] >> (bit % np.uint64(64))) & np.uint64(1)

        windows = rows.mapInArrow(lambda batches: extended(batches, in_filter), "key long, uid long, at int")
    else:

        def in_row(keys: np.ndarray, part: pa.RecordBatch, i: int) -> np.ndarray:
            return np.isin(keys, np.array(part.column(2)[i].as_py(), np.int64).view(np.uint64))

        # of each text the keys of its own suffixes that another has: no more than its words
        held = keyed.join(alike, "key").groupBy("uid").agg(F.collect_set("key").alias("keys"))
        windows = rows.join(held, "uid").select("uid", "text", "keys").mapInArrow(lambda batches: extended(batches, in_row), "key long, uid long, at int")
    shared = windows.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi")
    return windows.join(shared, "key").select("uid", "at", F.when(F.col("uid") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))


def repeated_passages(docs: DataFrame, passage: int = 50) -> DataFrame:
    """Per repeated passage of a document: doc_id, start_word, end_word (exclusive), n_words, other_doc_id.

    Words are cut at white space and compared byte by byte. A passage is a longest run of words that
    windows of ``passage`` words cover which another document has; ``other_doc_id`` is one that has its
    first window. Null, empty and shorter texts have none; repeats inside one document alone don't count;
    rows with a null or repeated doc_id are documents of their own. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        return kept(_passages(texts_of(docs, "suffix-texts"), passage), "suffix-passages")


def _passages(rows: DataFrame, passage: int) -> DataFrame:
    found = staged(repeated_windows(rows, passage), "suffix-windows")
    order = Window.partitionBy("uid").orderBy("at")
    opens = F.coalesce(F.col("at") > F.lag("at").over(order) + passage, F.lit(True)).cast("int")
    runs = found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    spans = runs.groupBy("uid", "run").agg(F.min("at").alias("start"), (F.max("at") + passage).alias("end"), F.min_by("other", "at").alias("other"))
    ids = rows.select("uid", "doc_id")
    spans = spans.join(ids, "uid").join(ids.select(F.col("uid").alias("other"), F.col("doc_id").alias("other_doc_id")), "other")
    return spans.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "other_doc_id")
