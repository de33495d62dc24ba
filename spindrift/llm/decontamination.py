"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names become typed placeholders, so that a question asked again with other values has
the same template. There are two templates of a text: ``plain`` keeps names as words, so that copies don't depend on
case; ``typed`` makes every capitalised word a name. Windows of template words are hash-joined to those of the
benchmark items; where they meet, the values in the placeholders are held against each other: in a
re-parameterised question one value of the item always stands for the same value in the document. Each
occurrence is judged by itself, as a document may hold an item several times with several sets of values.

A number right after a number keeps its value: a table of numbers would otherwise be one placeholder for ever,
alike in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, row_copy, scratch, staged

#: Words in a window (all of a shorter item), and item words that must be covered on the whole (all of a shorter item).
WINDOW, COVERED = 8, 13
#: Words beside the slots that an item shorter than a window needs to be found with other values; word for word it needs none.
SHORT = 4
#: Private-use characters for a number, a unit and a name.
NUM, UNIT, NAME = "\ue000", "\ue001", "\ue002"
#: Words that count as units right after a number. Fixed values.
UNITS = (
    "km m cm mm mi mile miles foot feet ft inch inches kg g mg lb lbs pound pounds ton tons l ml liter liters litre litres "
    "hour hours hr hrs h min minute minutes sec second seconds s day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents meter meters metre metres kph mph degree degrees"
).split()
#: Windows of the benchmark that may be broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 300_000
#: Documents that may be broadcast as those to read slots of (8 bytes each); more are joined by shuffle.
BROADCAST_DOCS = 2_000_000
#: Parts that the documents' windows of one hash are dealt to in that shuffle, as one may stand in a third of all documents.
PARTS = 16


def _is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def _followed(hashes: str, others: str, by: int) -> Column:
    """Hash of each element with that of ``others`` which stands ``by`` places on; shorter by so many."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(others) - by, F.lit(0))), F.slice(others, by + 1, F.greatest(F.size(others) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def _window_hashes(rows: DataFrame, words: str, size: int, name: str) -> DataFrame:
    """Add ``name``: one hash for each window of ``size`` of the hashes in ``words``, put together from windows of 1, 2, 4, ..."""
    rows, have, width = rows.withColumn(name, F.col(words)).withColumn("_power", F.col(words)), 0, 1
    while width <= size:
        if size & width:
            rows = rows.withColumn(name, _followed(name, "_power", have) if have else F.col("_power"))
            have += width
        if 2 * width <= size:
            rows = rows.withColumn("_power", _followed("_power", "_power", width))
        width *= 2
    return rows.drop("_power")


def _templates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``words`` (letters and digits alone, case kept), and the word hashes ``plain`` and ``typed`` of the two templates."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\p{L}\\p{N}\\s]+", "")
    rows = rows.withColumn("words", F.array_remove(F.split(bare, "\\s+"), "")).drop("text")

    def plain(word: Column, i: Column) -> Column:
        before = F.get("words", i - 1)
        unit = word.isin(UNITS) & _is_number(before)
        return F.xxhash64(F.when(_is_number(word) & ~F.coalesce(_is_number(before), F.lit(False)), NUM).when(unit, UNIT).otherwise(F.lower(word)))

    def typed(word: Column, hashed: Column) -> Column:
        return F.when((word >= "A") & (word < "[") & F.substring(word, 2, 1).between("a", "z"), F.xxhash64(F.lit(NAME))).otherwise(hashed)

    return rows.withColumn("plain", F.transform("words", plain)).withColumn("typed", F.zip_with("words", "plain", typed))


def _windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(..., pos, h, typed): windows of ``sizes`` words of ``plain``, and of ``typed`` where that differs.

    A pass over ``rows`` for each size; all but one stand for items under ``WINDOW`` words, if there are any.
    """
    kept = [c for c in rows.columns if c not in ("words", "plain", "typed")]
    for size in sizes:
        rows = _window_hashes(_window_hashes(rows, "plain", size, "_hp"), "typed", size, "_ht")
        changed = F.zip_with("_hp", "_ht", lambda p, t: F.when(p != t, t))
        # all of plain, then all of typed, each of which starts anew from 0
        rows = rows.withColumn(f"_w{size}", F.concat("_hp", changed)).withColumn(f"_n{size}", F.size("_hp")).drop("_hp", "_ht")
    out = None
    for size in sizes:
        n = F.col(f"_n{size}")
        # outer, as Spark would push "not empty" below an inner explode and hash each window again there
        of = rows.select(*kept, n, F.posexplode_outer(f"_w{size}").alias("pos", "h")).where("h is not null")
        of = of.select(*kept, F.when(F.col("pos") < n, F.col("pos")).otherwise(F.col("pos") - n).alias("pos"), "h", (F.col("pos") >= n).alias("typed"))
        out = of if out is None else out.union(of)
    return out


def _slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slots``: (pos, value, name) of the words that a template replaces."""
    # zipped, as a column that is named inside a function would be computed anew for each word
    words = F.transform(F.arrays_zip("words", "plain", "typed"), lambda x, i: F.struct(i.alias("pos"), F.lower(x["words"]).alias("value"), x["plain"].alias("plain"), x["typed"].alias("typed"), F.xxhash64(F.lower(x["words"])).alias("h")))
    slot = F.transform(words, lambda x: F.when((x["plain"] != x["h"]) | (x["typed"] != x["h"]), F.struct(x["pos"].alias("pos"), x["value"].alias("value"), (x["plain"] == x["h"]).alias("name"))))
    return rows.withColumn("slots", F.filter(slot, lambda x: x.isNotNull())).drop("words", "plain", "typed")


def _occurrences(met: DataFrame) -> DataFrame:
    """``met`` once for each part of the document that a row is judged in, named by ``part``.

    Parts are the whole document, the diagonals (pos - item_pos) less than ``WINDOW`` apart from one to the
    next, as words put in or left out move a copy along, and each diagonal alone, as versions of a short item
    may follow each other that closely. Each is judged by plain windows alone and by all, as names add to the slots.
    """
    rows = met.withColumn("diagonal", (F.col("pos") - F.col("item_pos")).cast("long"))
    along = Window.partitionBy("uid", "item_id").orderBy("diagonal")
    rows = rows.withColumn("starts", (F.col("diagonal") - F.lag("diagonal").over(along) >= WINDOW).cast("long"))
    rows = rows.withColumn("near", F.coalesce(F.sum("starts").over(along), F.lit(0)))
    parts = [F.concat_ws(":", F.lit(kind), at.cast("string")) for kind, at in (("whole", F.lit(0)), ("near", F.col("near")), ("diagonal", F.col("diagonal")))]
    parts = F.array(*(F.concat_ws(":", part, F.lit(ending)) for part in parts for ending in ("plain", "typed")))
    return rows.withColumn("part", F.explode(parts)).where(F.col("part").endswith("typed") | ~F.col("typed")).drop("starts", "near", "diagonal")


def _met(rows: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(uid, doc_id, item_id, item_words, pos, item_pos, typed): windows of ``rows`` that an item has.

    Where a window repeats, its k-th place in the document meets its k-th place in the item, counted round:
    a repeating text doesn't meet a repeating item in every pair of places.
    """
    found = _windows(_templates(rows), sizes)
    again = Window.partitionBy("item_id", "h").orderBy("item_pos")
    items = items.withColumn("turn", F.row_number().over(again) - 1).withColumn("turns", F.count(F.lit(1)).over(Window.partitionBy("item_id", "h")))
    items = items.select("item_id", "item_words", "h", "item_pos", "turn", "turns", F.col("typed").alias("item_typed"))
    if items.count() <= BROADCAST_WINDOWS:
        met = found.join(F.broadcast(items), "h")
    else:
        met = found.withColumn("_deal", F.pmod("uid", F.lit(PARTS))).join(items.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["h", "_deal"]).drop("_deal")
    once = Window.partitionBy("uid", "item_id", "h", "item_pos").orderBy("pos")
    return met.withColumn("k", F.row_number().over(once) - 1).where(F.col("k") % F.col("turns") == F.col("turn"))


def _matches(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``matches`` of rows (uid, doc_id, text) that give the same whenever they are read; staged."""
    with scratch(rows.sparkSession):
        return kept(_found(rows, benchmark), "decontamination")


def _found(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = _templates(benchmark.select("item_id", "text")).withColumn("item_words", F.size("words")).where("item_words > 0")
    items = staged(items.select("item_id", "item_words", "words", "plain", "typed"), "decontamination-items")
    sizes = sorted({*(r[0] for r in items.where(F.col("item_words") < WINDOW).select("item_words").distinct().collect()), WINDOW})
    # an item's windows are as long as itself where it is short: at most WINDOW - 1 such sizes
    windows = None
    for size in sizes:
        of = items.where(F.col("item_words") == size if size < WINDOW else F.col("item_words") >= size)
        of = _windows(of, [size]).withColumnRenamed("pos", "item_pos")
        windows = of if windows is None else windows.union(of)
    windows = staged(windows, "decontamination-windows")
    met = staged(_met(rows, windows, sizes).select("uid", "doc_id", "item_id", "item_words", "pos", "item_pos", (F.col("typed") | F.col("item_typed")).alias("typed")), "decontamination-met")
    # a document and item whose shared windows cover too little on the whole do so in every part
    size = F.least(F.lit(WINDOW), F.col("item_words"))
    after = F.lead("item_pos").over(Window.partitionBy("uid", "item_id").orderBy("item_pos"))
    reach = met.select("uid", "item_id", "item_words", "item_pos").distinct().withColumn("w", F.least(size, F.coalesce(after - F.col("item_pos"), size)))
    reach = reach.groupBy("uid", "item_id", "item_words").agg(F.sum("w").alias("w")).where(F.col("w") >= F.least(F.lit(COVERED), F.col("item_words")))
    reach = staged(reach.select("uid", "item_id"), "decontamination-reach")
    met = met.join(reach, ["uid", "item_id"], "left_semi")
    # slots only of texts that are left
    wanted = reach.select("uid").distinct()
    wanted = F.broadcast(wanted) if reach.count() <= BROADCAST_DOCS else wanted
    slots = _slots(_templates(rows.join(wanted, "uid", "left_semi").drop("doc_id"))).select("uid", "slots")
    item_slots = _slots(items).select("item_id", F.col("slots").alias("item_slots"))

    def inside(slots: str, start: str) -> Column:
        return F.filter(slots, lambda s: (s["pos"] >= F.col(start)) & (s["pos"] < F.col(start) + size))

    def paired(s: Column) -> Column:
        """An item's slot and what the document has there; the same word if that is no slot of the document."""
        there = F.filter("there", lambda d: d["pos"] == s["pos"] - F.col("item_pos") + F.col("pos"))
        return F.struct(s["value"].alias("asked"), F.coalesce(F.get(there, F.lit(0))["value"], s["value"]).alias("has"), s["name"].alias("name"))

    # one window's slots at a time, eight at most
    held = met.join(item_slots, "item_id").withColumn("here", inside("item_slots", "item_pos")).drop("item_slots")
    held = held.join(slots, "uid").withColumn("there", inside("slots", "pos")).drop("slots")
    met = _occurrences(staged(held.withColumn("pairs", F.transform("here", paired)).drop("here", "there"), "decontamination-slots"))
    places = met.select("uid", "doc_id", "item_id", "part", "item_words", "item_pos").distinct()
    following = F.lead("item_pos").over(Window.partitionBy("uid", "item_id", "part").orderBy("item_pos"))
    covered = places.withColumn("w", F.least(size, F.coalesce(following - F.col("item_pos"), size)))
    covered = covered.groupBy("uid", "doc_id", "item_id", "part", "item_words").agg(F.sum("w").cast("long").alias("covered"))
    pairs = met.select("uid", "item_id", "part", F.explode("pairs").alias("pair")).where(F.col("part").endswith("typed") | ~F.col("pair.name")).select("uid", "item_id", "part", F.struct("pair.asked", "pair.has").alias("pair")).distinct()
    by_value = pairs.groupBy("uid", "item_id", "part", F.col("pair.asked").alias("asked")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pair.asked") != F.col("pair.has")).cast("long")).alias("changed"))
    slots = by_value.groupBy("uid", "item_id", "part").agg(F.count(F.lit(1)).alias("n_slots"), F.sum((F.col("changed") > 0).cast("long")).alias("n_changed"), F.sum((F.col("n") > 1).cast("long")).alias("n_torn"))
    whole = covered.join(slots, ["uid", "item_id", "part"], "left").na.fill(0, ["n_slots", "n_changed", "n_torn"])
    enough = F.col("covered") >= F.least(F.lit(COVERED), F.col("item_words"))
    # values that stand for several others: a chance likeness, unless most agree or no more than a fifth are torn
    consistent = 5 * F.col("n_torn") <= F.col("n_slots")
    beside = F.col("covered") - F.col("n_slots")
    known = (F.col("item_words") >= WINDOW) | (F.col("n_changed") == 0) | (beside >= SHORT)
    passed = whole.where(enough & known & (consistent | (beside >= COVERED)))
    best = F.max(F.struct("covered", (-F.col("n_changed")).alias("unchanged"), "n_slots")).alias("best")
    found = passed.groupBy("uid", "doc_id", "item_id", "item_words").agg(best)
    n_changed = -F.col("best.unchanged")
    return found.select("uid", "doc_id", "item_id", "best.covered", F.col("item_words").cast("long").alias("item_words"), "best.n_slots", n_changed.alias("n_changed"), F.when(n_changed > 0, "reparameterised").otherwise("exact").alias("kind"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: of its occurrences that pass, the one covered most and changed least.

    Columns: uid (row of ``docs``), doc_id, item_id, covered (item words in shared windows), item_words,
    n_slots (pairs of values compared), n_changed (pairs that differ), kind (``exact`` or
    ``reparameterised``). Null and empty texts hold nothing; an item under ``WINDOW`` words is found
    where all of it stands, with other values only if ``SHORT`` words are no slots. Repeated rows and null ids are rows of
    their own; other columns are not read. Empty tables give an empty result.
    """
    rows, _ = row_copy(docs, "decontamination-texts", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _matches(rows, benchmark)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay, whatever their names.

    Null and empty texts stay, and so does each of several equal rows that hold nothing; an empty table
    gives an empty result, an empty benchmark all rows.
    """
    rows, uid = row_copy(docs, "decontamination-rows")
    held = _matches(rows.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return rows.join(held.select(F.col("uid").alias(uid)).distinct(), uid, "left_anti").drop(uid)
