"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of its language's commonest words are held against
the language's own, gathered over all documents of that language, by Jensen-Shannon distance. Texts too
short for a histogram to mean anything are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SPACE = "[ \\t-\\r]+"
WINDOW = 5
#: Commonest words of a language that its histogram has; each makes up SHARE of all words at least.
WORDS, SHARE = 16, 0.005
#: Least lengths at which the histograms count, and the greatest distances (0 to 1) of kept documents. Texts under LONG words
#: may be further off, as their histograms are rougher. The cuts lie between the distances of labelled good and bad texts.
MIN_CHARS, MIN_WORDS, LONG = 200, 30, 100
MAX_CLASS, MAX_WORD, MAX_WORD_SHORT = 0.25, 0.27, 0.35
#: Languages whose references may be broadcast (under 2 kB each); more are joined by shuffle.
BROADCAST_LANGS = 2000


def _without(pattern: str) -> Column:
    return F.length(F.regexp_replace("t", pattern, ""))


def _followed(hashes: str, others: str, by: int) -> Column:
    """Hash of each element with that of ``others`` which stands ``by`` places on; shorter by so many."""
    n = F.greatest(F.size(others) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(others, by + 1, n), lambda x, y: F.xxhash64(x, y))


def _features(docs: DataFrame) -> DataFrame:
    """Base counts of every document; ``classes`` has the counts of its character classes."""
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    # windows of five words from those of one, two and four
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("two", _followed("h", "h", 1))
    rows = rows.withColumn("four", _followed("two", "two", 2)).withColumn("hs", _followed("four", "h", WINDOW - 1)).drop("two", "four", "h")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    rows = rows.select(
        "doc_id",
        "lang",
        "words",
        F.size("words").cast("long").alias("n_words"),
        _without(SPACE).cast("long").alias("word_chars"),
        _without("[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.length("t").cast("long").alias("chars"),
        (F.length("t") - _without("[a-z]+")).cast("long").alias("lower"),
        _without("[^A-Z]+").cast("long").alias("upper"),
        _without("[^0-9]+").cast("long").alias("digits"),
        _without("[\\x00-\\x7f]+").cast("long").alias("beyond"),
        # windows in order of hash, where any occurs twice
        F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"),
    )
    again = F.transform("sorted", lambda s, j: F.when((F.get("sorted", j - 1)["h"] == s["h"]) | (F.get("sorted", j + 1)["h"] == s["h"]), s["i"]))
    rows = rows.withColumn("places", F.sort_array(F.array_compact(again)))
    covered = F.aggregate(F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    blank = F.col("chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("lower") - F.col("upper") - F.col("digits") - F.col("beyond")
    return rows.select(
        "doc_id",
        "lang",
        "words",
        "chars",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.array(*(F.greatest(c, F.lit(0)) for c in (F.col("lower"), F.col("upper"), F.col("digits"), F.col("n_symbols"), F.col("beyond"), blank, rest))).alias("classes"),
    )


CLASSES = 7


def references(docs: DataFrame) -> DataFrame:
    """One row per language: class_ref (shares of character classes), word_list, word_ref (shares, others last)."""
    rows = docs.select("lang", F.coalesce("text", F.lit("")).alias("t"))
    blank = F.length("t") - _without(SPACE)
    lower, upper, digits, symbols, beyond = F.length("t") - _without("[a-z]+"), _without("[^A-Z]+"), _without("[^0-9]+"), _without("[^#*$%&|<>]+"), _without("[\\x00-\\x7f]+")
    counted = rows.select("lang", F.length("t").alias("c6"), lower.alias("c0"), upper.alias("c1"), digits.alias("c2"), symbols.alias("c3"), beyond.alias("c4"), blank.alias("c5"))
    sums = counted.groupBy("lang").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(CLASSES)))
    others = F.col("c6") - sum(F.col(f"c{i}") for i in range(CLASSES - 1))
    shares = [F.greatest(c, F.lit(0)) / F.greatest("c6", F.lit(1)) for c in (*(F.col(f"c{i}") for i in range(CLASSES - 1)), others)]
    classes = sums.select("lang", F.array(*shares).alias("class_ref"))
    words = rows.select("lang", F.explode_outer(F.split(F.lower("t"), SPACE)).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = staged(words, "quality-words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    # at most 1 / SHARE words of a language are left to rank
    common = words.alias("w").join(total.alias("x"), F.col("w.lang").eqNullSafe(F.col("x.lang"))).where(F.col("n") >= SHARE * F.col("total")).select("w.lang", "word", (F.col("n") / F.col("total")).alias("share"))
    common = common.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "word"))).where(F.col("rank") <= WORDS)
    lists = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "share"))).alias("top"))
    lists = lists.select("lang", F.transform("top", lambda x: x["word"]).alias("word_list"), F.transform("top", lambda x: x["share"]).alias("top_shares"))
    joined = classes.alias("c").join(lists.alias("l"), F.col("c.lang").eqNullSafe(F.col("l.lang")), "left")
    top = F.coalesce("top_shares", F.array().cast("array<double>"))
    left = F.lit(1.0) - F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    return joined.select(F.col("c.lang").alias("ref_lang"), "class_ref", F.coalesce("word_list", F.array().cast("array<string>")).alias("word_list"), F.concat(top, F.array(F.greatest(left, F.lit(0.0)))).alias("word_ref"))


def _distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of counts from shares."""
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))

    def term(p: Column, m: Column) -> Column:
        return F.when((p > 0) & (m > 0), p * F.log2(p / m)).otherwise(0.0)

    each = F.zip_with(counts, reference, lambda n, q: term(n / F.col("_total"), (n / F.col("_total") + q) / 2) + term(q, (n / F.col("_total") + q) / 2))
    return total, F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts (long), base_failed, kept, and the two distances.

    Null texts have no words and fail the base rule (n_words < 10). A null language is a language of its
    own. A distance that a minimum length rules out is null and doesn't count against its document.
    Repeated rows are judged each for itself, as are rows with a null doc_id; an empty table gives an
    empty result.
    """
    refs = staged(references(docs), "quality-references")
    n_langs = refs.count()
    rows = _features(docs)
    rows = rows.join(F.broadcast(refs) if n_langs <= BROADCAST_LANGS else refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    # double spaces: every word has one of its own to either side
    rows = rows.withColumn("spaced", F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))).drop("words", "lang", "ref_lang")
    size = F.octet_length("spaced")
    counts = F.transform("word_list", lambda w: (size - F.octet_length(F.replace("spaced", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2))
    rows = rows.withColumn("hits", counts).drop("spaced", "word_list")
    others = F.greatest(F.col("n_words") - F.aggregate("hits", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    rows = rows.withColumn("hits", F.concat("hits", F.array(others))).withColumn("classes", F.col("classes").cast("array<double>"))
    total, distance = _distance("classes", "class_ref")
    rows = rows.withColumn("_total", total).withColumn("class_distance", F.when(F.col("chars") >= MIN_CHARS, distance)).drop("_total")
    total, distance = _distance("hits", "word_ref")
    rows = rows.withColumn("_total", total).withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, distance)).drop("_total")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS) & (F.coalesce("word_distance", F.lit(0.0)) <= F.when(F.col("n_words") >= LONG, MAX_WORD).otherwise(MAX_WORD_SHORT))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance")
