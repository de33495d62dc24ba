"""Token counts: count pieces once per distinct pre-token, join, and sum; ids are never kept.

1. Every text is split into pre-tokens; tasks add up how often each occurs, Spark sums over tasks.
2. The vocabulary is applied once to each distinct pre-token, giving its number of pieces.
3. Each document's pre-token frequencies meet that dictionary. Its commonest part, of a fixed size, is
   broadcast and joined where the text is split; only frequencies of rarer pre-tokens are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged, utf8_bytes
from .tokens import Vocabulary

#: Entries of the dictionary that are broadcast, at about 100 bytes each in a worker. Changes speed only.
BROADCAST_PIECES = 250_000
#: Distinct pre-tokens a task gathers before it hands them on.
GATHERED = 400_000


def _split(vocabulary: Vocabulary, special: list[str], text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text, and the tokens that are settled already: special strings, or texts left to the library."""
    if any(s in text for s in special):
        parts, done = [text], 0
        for s in special:
            parts = [q for p in parts for q in p.split(s)]
        done = len(vocabulary.encode([text])[0])
        return [], done
    got = vocabulary.pieces(text)
    if got is None:
        spans = vocabulary.library.pre_tokenizer.pre_tokenize_str(text) if vocabulary.library.normalizer is None else None
        if spans is None:
            return [], len(vocabulary.encode([text])[0])
        return [text[a:b] for _, (a, b) in spans], 0
    return got, 0


def dictionary(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, freq, n_pieces) of every distinct pre-token of all texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = Vocabulary.at(vocabulary), Counter()
        special = v._kind[2]

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "freq"])
            seen.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py()
                if text:
                    seen.update(_split(v, special, text)[0])
                    if len(seen) > GATHERED:
                        yield out()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.at(vocabulary)
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = [len(ids) for at in range(0, len(words), 5000) for ids in v.encode(words[at : at + 5000])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["piece", "freq", "n_pieces"])

    seen = docs.select("text").mapInArrow(gather, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return seen.mapInArrow(count, "piece string, freq long, n_pieces int")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null texts count as empty: no bytes, no tokens. Rows with null or repeated doc_id stay apart; an
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = staged(dictionary(docs, vocabulary), "token-counts")
    step = F.floor(F.log2("freq") * 8).cast("int").alias("step")
    least, n = None, 0
    for r in sorted(pieces.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 8 rows for each doubling
        n += r["n"]
        if n > BROADCAST_PIECES:
            break
        least = r["step"]
    # at most BROADCAST_PIECES rows, whatever the input
    common = pieces.where(step >= least if least is not None else F.lit(False)).select("piece", "n_pieces").toPandas()
    common = dict(zip(common["piece"], common["n_pieces"].tolist(), strict=True))
    shared = spark.sparkContext.broadcast(common)
    fields = ["uid", "doc_id", "n_bytes", "piece", "freq", "known"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document one row with what the common dictionary settles, and a row for each rarer pre-token."""
        v, n_of = Vocabulary.at(vocabulary), shared.value
        special = v._kind[2]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[] for _ in fields]
                for uid, doc, size, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    got, known = _split(v, special, text or "")
                    rare = Counter()
                    for p in got:
                        n = n_of.get(p)
                        if n is None:
                            rare[p] += 1
                        else:
                            known += n
                    # the piece of a document's own row meets nothing; it only spreads these rows
                    rows = [(uid, doc, size, f"\0{uid}", 0, known), *((uid, None, None, p, n, 0) for p, n in rare.items())]
                    for row in rows:
                        for col, value in zip(cols, row, strict=True):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], fields)

    texts = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), utf8_bytes(F.col("text")).alias("n_bytes"), "text")
    found = texts.mapInArrow(frequencies, "uid long, doc_id long, n_bytes long, piece string, freq long, known long")
    met = found.join(pieces.select("piece", "n_pieces"), "piece", "left")
    counted = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.coalesce(F.col("freq") * F.col("n_pieces"), F.lit(0))).cast("long").alias("n_tokens"),
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
