"""Spelling variants: one-edit neighbours from a frontier of states over a distributed trie.

1. Words are counted in tasks and added up by Spark.
2. The trie is a table of edges: from a node (a prefix) by a letter, with the letter after it and the set of numbers of letters
   that may still follow, as bits, so that hopeless steps are not taken. At most 90 letters exist, so a node has at most
   91 * 91 of these.
3. States (word, position, node, edits) are joined with the edges, level by level. A state without an edit is on the word's own
   path; it spends its edit on a deleted letter or on one replaced by a greater. A state with an edit only follows its word. States at the end of their word on a node where a word ends are neighbours, and so is the other way round:
   what is an insertion or a replacement by a smaller letter from one end is among these from the other.
   Two words that differ by one edit share a prefix or a suffix of half their length, so there is a second trie of reversed
   words, and in both the edit is spent in the second half only, where nodes have few edges.
4. Words beyond ``LONG`` letters (runs without a blank) would need a level for each letter. They meet by keys of the word with
   one letter taken out instead: each key and place is shared by at most 90 words.
5. Forms are aggregates over neighbours; roots follow forms by doubling, as counts grow tenfold with each step.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch, staged

#: Words with more letters meet by keys; 64 bits hold the numbers of letters that may follow.
LONG = 64
#: Distinct words a task gathers before it hands them on.
GATHERED = 400_000
#: Keys of two remainders of polynomials, 120 bits together; matches are checked letter by letter.
_MOD, _BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def words(docs: DataFrame, least_letters: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, with a letter deleted where ``every`` divides their hash."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
                for word, n in Counter(run.findall(text.encode().lower().decode())).items():  # bytes.lower: A-Z only
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_letters:
                            continue
                    seen[word] += n
                if len(seen) > GATHERED:
                    yield out()
        yield out()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(gather, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def edge_table(spelt: DataFrame) -> DataFrame:
    """(level, d, node, ch, after, rests): the tries of ``spelt`` (d, s), from the levels that states may reach on; the end of a word is an edge without a letter."""
    n = F.length("s")
    path = spelt.select("d", "s", F.explode(F.sequence(F.floor((n - 1) / 2).cast("int"), n)).alias("level"))
    edges = path.select(
        "level", "d", F.expr("substring(s, 1, level)").alias("node"), F.expr("substring(s, level + 1, 1)").alias("ch"), F.expr("substring(s, level + 2, 1)").alias("after"),
        F.expr("shiftleft(1L, greatest(length(s) - level - 1, 0))").alias("rest"),
    )
    return edges.groupBy("level", "d", "node", "ch", "after").agg(F.bit_or("rest").alias("rests"))


def trie_neighbours(found: DataFrame) -> DataFrame:
    """(word, near) for words of up to ``LONG`` letters, both ways round; inside a ``scratch``."""
    spelt = staged(found.select(F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("word").alias("s")), F.struct(F.lit(1).alias("d"), F.reverse("word").alias("s")))).alias("x"), F.length("word").alias("n")).select("x.*", "n"), "spelling-spelt", by="n")
    edges = staged(edge_table(spelt), "spelling-edges", by="level")
    bounds = found.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    if bounds[0] is None:
        return found.select("word", F.col("word").alias("near")).limit(0)

    def ahead(states: DataFrame) -> DataFrame:
        """With the word's next letters a, b, c ('' behind its end) and how many are left."""
        return states.withColumns({"left": F.length("s") - F.col("pos"), **{x: F.expr(f"substring(s, pos + {i + 1}, 1)") for i, x in enumerate("abc")}})

    ends, edited = [], None
    fits = F.expr("getbit(rests, need) = 1 AND IF(greater, ch > letter, ch = letter)")
    columns = ["d", "s", "node", "pos", "letter", "greater", "after", "need"]
    for level in range((bounds[0] - 1) // 2, bounds[1] + 1):
        here = edges.where(F.col("level") == level).drop("level")
        # without an edit a word is on its own path
        plain = spelt.where((F.floor((F.col("n") - 1) / 2) <= level) & (F.col("n") > level)).select("d", "s", F.lit(level).alias("pos"), F.expr(f"substring(s, 1, {level})").alias("node"))
        # a greater letter instead; or one left out: on with the next but one, behind the last one to the end
        replaced = F.struct((F.col("pos") + 1).alias("pos"), F.col("a").alias("letter"), F.lit(True).alias("greater"), F.col("b").alias("after"), (F.col("left") - 1).alias("need"))
        deleted = F.when(F.col("a") != F.col("b"), F.struct(F.expr("least(pos + 2, length(s))").alias("pos"), F.col("b").alias("letter"), F.lit(False).alias("greater"), F.col("c").alias("after"), F.greatest(F.col("left") - 2, F.lit(0)).alias("need")))
        asked = ahead(plain).select("d", "s", "node", F.explode(F.array_compact(F.array(replaced, deleted))).alias("x")).select("d", "s", "node", "x.*").select(*columns)
        if edited is not None:
            asked = asked.unionByName(ahead(edited).select("d", "s", "node", (F.col("pos") + 1).alias("pos"), F.col("a").alias("letter"), F.lit(False).alias("greater"), F.col("b").alias("after"), (F.col("left") - 1).alias("need")))
        made = staged(asked.join(here, ["d", "node", "after"]).where(fits).select("d", "s", "pos", F.concat("node", "ch").alias("node")), "spelling-states")
        done = F.col("pos") == F.length("s")
        ends.append(made.where(done))
        edited = made.where(~done)
    near = ends[0]
    for e in ends[1:]:
        near = near.unionByName(e)
    back = F.col("d") == 1
    near = near.select(F.when(back, F.reverse("s")).otherwise(F.col("s")).alias("word"), F.when(back, F.reverse("node")).otherwise(F.col("node")).alias("near")).distinct()
    return near.unionByName(near.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _without_one(word: str) -> tuple[list[list[int]], list[int]]:
    """Keys of the word without its i-th letter, for each i, and of the word itself."""
    codes, cut, own = list(map(ord, word)), [], []
    for base in _BASES:
        n = len(codes)
        ahead, power = [0] * (n + 1), [1] * (n + 1)
        for i, c in enumerate(codes):
            ahead[i + 1] = (ahead[i] * base + c) % _MOD
            power[i + 1] = power[i] * base % _MOD
        own.append(ahead[n])
        cut.append([(ahead[i] * power[n - i - 1] + ahead[n] - ahead[i + 1] * power[n - i - 1]) % _MOD for i in range(n)])
    return cut, own


def long_neighbours(found: DataFrame) -> DataFrame:
    """(word, near) where one of the two has more than ``LONG`` letters; inside a ``scratch``."""
    spelt = staged(found.where(F.length("word") >= LONG).select(F.monotonically_increasing_id().alias("id"), "word"), "spelling-long")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (one, two), own = _without_one(word)
                k, l, at = [*one, own[0]], [*two, own[1]], [*range(len(word)), -1]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(k, pa.int64()), pa.array(l, pa.int64())], ["id", "at", "k", "l"])

    dealt = staged(spelt.repartition("id").mapInArrow(keys, "id long, at int, k long, l long"), "spelling-keys")
    cut, own = dealt.where("at >= 0"), dealt.where("at < 0").select("k", "l", F.col("id").alias("short"))
    swapped = cut.alias("x").join(cut.alias("y"), ["k", "l", "at"]).where("x.id <> y.id").select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), "at", F.lit(True).alias("same"))
    shorter = cut.join(own, ["k", "l"]).groupBy("id", F.col("short").alias("other")).agg(F.min("at").alias("at")).withColumn("same", F.lit(False))
    met = swapped.unionByName(shorter).join(spelt, "id").join(spelt.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    less = F.expr("concat(substring(word, 1, at), substring(word, at + 2))")
    whole = F.when(F.col("same"), F.expr("concat(substring(near, 1, at), substring(near, at + 2))")).otherwise(F.col("near"))
    met = met.where((less == whole) & (F.greatest(F.length("word"), F.length("near")) > LONG))
    both = met.select(F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("x"))
    return both.select("x.*").distinct()


def variants(docs: DataFrame, least_letters: int = 7, least_count: int = 2, factor: int = 10) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    ``form``: the near word of largest n (ties: smallest in code-point order) if that n is at least ``factor`` times the
    word's own, else null, as is ``form_n``. ``root``: where forms lead in the end; the word itself without one.
    Null and empty texts have no words. A null doc_id is hashed as no digits; repeated rows count each. Words of any length
    take part. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    if factor < 2:
        raise ValueError("forms end only if counts grow: factor must be 2 or more")
    spark = docs.sparkSession
    with scratch(spark):
        found = staged(words(docs, least_letters, least_count), "spelling-words")
        most = found.agg(F.max("n"), F.max(F.length("word"))).first()
        pairs = trie_neighbours(found.where(F.length("word") <= LONG))
        if (most[1] or 0) > LONG:
            pairs = pairs.unionByName(long_neighbours(found))
        met = pairs.join(found.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
        best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
        given = found.join(best, "word", "left").withColumn("is", -F.col("best.m") >= factor * F.col("n"))
        given = staged(given.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), F.col("best.near")).alias("form"), F.when(F.col("is"), -F.col("best.m")).cast("long").alias("form_n")), "spelling-forms")
        steps = int(math.log(max((most[0] or 1) / least_count, 1), factor)) + 1
        to = given.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
        for _ in range(math.ceil(math.log2(steps + 1))):
            to = staged(to.join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        out = given.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return kept(out, "spelling")
