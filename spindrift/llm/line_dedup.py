"""Line dedup: winnowing over line hashes finds runs of lines that occurred before, and deletes them.

Each document is its sequence of lines with a word. In every window of ``run`` lines the line of least
hash is a fingerprint, so two places that share ``run`` lines share a fingerprint at the same line of
them. Places are joined on fingerprints and what surrounds them: the match is extended to the left and to the
right to every run of ``run`` lines that holds the fingerprint, and a run that occurs earlier (by doc_id,
then line) is deleted where it occurs again. Longer matches are chains of such runs; ``repeated_runs`` joins
them up along their diagonal to maximal ones.

With ``lone`` words given, a line of so many words is a run by itself, wherever it stands: a window of one.

Runs are told apart by 96 bits (two hashes of different kinds), so that a chance likeness deletes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, kept, row_copy, scratch, staged

#: Lines with a character other than space, tab, line feed, vertical tab, form feed or return.
_HAS_WORD = "[^ \\t-\\r]"


def _place(at: Column) -> Column:
    """Order of places: rows with null doc_id are the last; ``at`` is the place among the worded lines."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", at.cast("int").alias("at"))


def _lines(rows: DataFrame, lone: int | None) -> DataFrame:
    """(uid, doc_id, s): worded lines in order as (no, h, g, long): place among all lines, two hashes, whether it is a run by itself."""
    pattern = "^[ \\t-\\r]*" + "[^ \\t-\\r]+[ \\t-\\r]+" * ((lone or 1) - 1) + _HAS_WORD
    alone = (lambda line: line.rlike(pattern)) if lone else (lambda line: F.lit(False))
    every = F.transform(F.split("text", "\n"), lambda line, i: F.when(line.rlike(_HAS_WORD), F.struct(i.alias("no"), F.xxhash64(line).alias("h"), F.hash(line).alias("g"), alone(line).alias("long"))))
    return rows.select("uid", "doc_id", F.filter(every, lambda x: x.isNotNull()).alias("s"))


def _winnowed(rows: DataFrame, run: int) -> DataFrame:
    """Runs of ``run`` lines round the fingerprints that places share: h, g, place, nos."""
    lines = rows.where(F.size("s") >= run).withColumn("hs", F.transform("s", lambda x: x["h"]))

    def least(i: Column) -> Column:
        window = F.slice("hs", i + 1, run)
        return (i + F.array_position(window, F.array_min(window)) - 1).cast("int")

    # outer, as Spark would push "not empty" below an inner explode and compute its array there too
    picked = lines.withColumn("p", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("hs") - run), least))))
    first = F.greatest(F.col("p") - (run - 1), F.lit(0))
    # what surrounds a fingerprint: run - 1 lines to either side
    prints = picked.select("uid", "doc_id", F.element_at("hs", F.col("p") + 1).alias("print"), first.alias("first"), (F.col("p") - first).alias("left"), F.slice("s", first + 1, (F.col("p") - first) + run).alias("near"))
    shared = staged(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "lines-prints")
    met = prints.join(shared, "print", "left_semi")
    starts = F.sequence(F.lit(0), F.least(F.col("left"), F.size("near") - run))
    grown = met.where(F.size("near") >= run).select("uid", "doc_id", "first", "near", F.explode(starts).alias("at"))
    within = F.slice("near", F.col("at") + 1, run)
    return grown.select(
        F.xxhash64(F.transform(within, lambda x: x["h"])).alias("h"),
        F.hash(F.transform(within, lambda x: x["g"])).alias("g"),
        _place(F.col("first") + F.col("at")).alias("place"),
        F.transform(within, lambda x: x["no"]).alias("nos"),
    )


def _lone(rows: DataFrame) -> DataFrame:
    """Every line that is a run by itself: h, g, place, nos."""
    lines = F.filter(F.transform("s", lambda x, i: F.struct(x["h"].alias("h"), x["g"].alias("g"), x["long"].alias("long"), i.alias("at"), x["no"].alias("no"))), lambda x: x["long"])
    out = rows.select("uid", "doc_id", F.explode_outer(lines).alias("x")).where("x is not null")
    return out.select("x.h", "x.g", _place(F.col("x.at")).alias("place"), F.array("x.no").alias("nos"))


def _later(runs: DataFrame) -> DataFrame:
    """(place, nos, origin): all runs but the earliest of each key, with the place of the earliest.

    Origins are kept of repeated keys alone, as a table of their own: the join can then be split where a
    third of all places have one key.
    """
    runs = staged(runs, "lines-runs")
    origins = staged(runs.groupBy("h", "g").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "lines-origins")
    return runs.join(origins, ["h", "g"]).where(F.col("place") > F.col("origin")).select("place", "nos", "origin")


def _repeats(rows: DataFrame, run: int, lone: int | None) -> DataFrame:
    lines = _lines(rows, lone)
    found = _later(_winnowed(lines, run))
    return found if lone is None else found.unionByName(_later(_lone(lines)))


def _texts(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """A copy of ``docs``, the name of its row id, and (uid, doc_id, text) of it."""
    rows, uid = row_copy(docs, "lines-rows")
    return rows, uid, rows.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def repeated_runs(docs: DataFrame, run: int = 2, lone: int | None = None) -> DataFrame:
    """Maximal later runs: doc_id, start_line, n_lines, origin_doc_id, origin_line; lines with a word are counted, from 0.

    Matches that follow each other on one diagonal (same two rows, same distance of lines) are one run. A line may lie
    in several runs with different origins. Nulls, repeated rows and empty tables as in ``line_dedup``.
    """
    _, _, texts = _texts(docs)
    found = _repeats(texts, run, lone).select(F.col("place.uid").alias("uid"), F.col("place.doc_id").alias("doc_id"), F.col("origin.uid").alias("origin_uid"), F.col("origin.doc_id").alias("origin_doc_id"), F.col("place.at").alias("at"), (F.col("place.at") - F.col("origin.at")).alias("diagonal"), F.size("nos").alias("size"))
    spread = found.withColumn("at", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1))).drop("size").distinct()
    along = Window.partitionBy("uid", "origin_uid", "diagonal").orderBy("at")
    runs = spread.withColumn("island", F.col("at") - F.row_number().over(along))
    key = ["uid", "doc_id", "origin_uid", "origin_doc_id", "diagonal", "island"]
    runs = runs.groupBy(*key).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    return runs.select("doc_id", F.col("start").cast("long").alias("start_line"), F.col("n").alias("n_lines"), "origin_doc_id", (F.col("start") - F.col("diagonal")).cast("long").alias("origin_line"))


def line_dedup(docs: DataFrame, run: int = 2, lone: int | None = None) -> DataFrame:
    """``docs`` with later repeats of runs of ``run`` lines, and of single lines of ``lone`` words or more, cut out of ``text``.

    All columns stay, whatever their names, but for columns n_lines and n_removed of ``docs``, which the operator's own
    (long) replace; ``n_chars``, if there is one, follows the new text. Lines without a word are never removed and
    don't part a run. A null text stays null with no lines; a text that is one line stays as it is unless ``lone``
    applies, and is then left empty; a row that repeats loses its repeated runs; runs that overlap themselves (A A A)
    shrink to the first line. Rows with null doc_id count as later than all others. An empty table gives an empty result.
    """
    rows, uid, texts = _texts(docs)
    gone = fresh([*docs.columns, uid], "gone")
    with scratch(docs.sparkSession):
        lines = _repeats(texts, run, lone).select(F.col("place.uid").alias(uid), F.explode("nos").alias(gone))
        doomed = kept(lines.groupBy(uid).agg(F.collect_set(gone).alias(gone)), "lines-doomed")
    rows = rows.join(doomed.hint("merge"), uid, "left")  # grows with the corpus: one plan for every size
    split = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    n_removed = F.coalesce(F.size(gone), F.lit(0))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    out = rows.select(*(text.alias("text") if c == "text" else F.col(c) for c in names), n_lines.alias("n_lines"), F.greatest(n_removed, F.lit(0)).cast("long").alias("n_removed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
