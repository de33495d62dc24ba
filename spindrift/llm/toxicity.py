"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

1. Features that set labelled toxic rows apart are mined and dealt to lexicon voters (whole words) and
   pattern voters (word beginnings). Fixed voters look at a list of insults and at the form of a text: words
   repeated in a row, shouted words, rows of exclamation marks, words that address the reader. One more votes
   for the label 0, by words mined from rows that are not toxic. A voter votes or abstains.
2. The votes of all documents are counted by pattern: with V voters there are at most 2^V patterns.
3. A label model explains these counts: each voter's rates given the hidden label, and its dependence on
   one other voter (a tree over the pairs that go together most), are fitted by expectation maximisation,
   anchored by the votes on rows whose label may be learnt, each of which counts ANCHOR times as much as any other row.
4. The model's posterior labels a bounded sample of rows, on which a logistic regression is trained; that
   classifier alone scores every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that mining and training take, by hash of doc_id. A bound, not a share.
LABELLED_ROWS = 20_000
#: Mined features, in lexicon and pattern voters, and features of the classifier.
MINED, LEXICONS, PATTERNS, CLASSIFIER = 600, 6, 5, 4000
#: Rows that a feature must occur in, and its least log ratio of rates to be a voter's or the classifier's.
SUPPORT, LEAST_RATIO, CLASSIFIER_RATIO = 5, 2.5, 1.5
#: Common English insults: the fixed voter. Fixed values.
INSULTS = frozenset("bastard clown crap disgusting dumb fool idiot idiotic imbecile jerk loser moron pathetic scum stupid trash ugly vermin worthless".split())
#: Words that address a reader, in four languages. Fixed values.
ADDRESS = frozenset("you your yours yourself du dich dir dein deine tu te toi ton ta tes vous votre vos usted ustedes tus".split())
#: Forms of a text, as features that no word can be.
FORMS = ("#repeated", "#shouted", "#exclaimed", "#address")
#: Features of the voter for label 0, the rows each needs, and its greatest log ratio of rates.
NEGATIVE, NEGATIVE_SUPPORT, NEGATIVE_RATIO = 60, 30, -1.5
#: Voters in order: lexicons, patterns, insults, forms, and the one for label 0.
V = LEXICONS + PATTERNS + 1 + len(FORMS) + 1
#: How much a row of known label counts in the label model, against 1 for any other row.
ANCHOR = 4.0

_WORD = re.compile(r"[^\W_]+")


def features(text: str) -> set[str]:
    """Distinct lower-case words of a text, as ``^abcd`` and ``^abcde`` how they begin, and the text's FORMS."""
    found = _WORD.findall(text)
    words = {w.lower() for w in found}
    forms = []
    if any(a == b == c for a, b, c in zip(found, found[1:], found[2:], strict=False)):
        forms.append(FORMS[0])
    if 3 * sum(map(str.isupper, found)) > 2 * len(found) > 8:
        forms.append(FORMS[1])
    if text.count("!!") >= 3:
        forms.append(FORMS[2])
    if not ADDRESS.isdisjoint(words):
        forms.append(FORMS[3])
    return words.union({"^" + w[:5] for w in words if len(w) > 5}, {"^" + w[:4] for w in words if len(w) > 4}, forms)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class LabelModel:
    """P(label), and P(vote | parent's vote, label) of every voter in a tree."""

    prior: float
    parent: list[int]  # -1: none
    rate: np.ndarray  # voter x parent's vote x label

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) of rows of votes (0 or 1)."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for v in range(votes.shape[1]):
            above = votes[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes), int)
            p = self.rate[v][above]
            log += np.log(np.where(votes[:, [v]] == 1, p, 1 - p))
        log -= log.max(axis=1, keepdims=True)
        e = np.exp(log)
        return e[:, 1] / e.sum(axis=1)


def _tree(votes: np.ndarray, weight: np.ndarray, q: np.ndarray) -> list[int]:
    """Parents in the tree of greatest mutual information between voters, given the label (weights q)."""
    n = votes.shape[1]
    info = np.zeros((n, n))
    for label in (1 - q, q):
        w = weight * label
        total = w.sum() + 1e-9
        for i in range(n):
            for j in range(i):
                for a in (0, 1):
                    for b in (0, 1):
                        pab = (w @ ((votes[:, i] == a) & (votes[:, j] == b)) + 1e-9) / total
                        pa_, pb = (w @ (votes[:, i] == a) + 1e-9) / total, (w @ (votes[:, j] == b) + 1e-9) / total
                        info[i, j] += total * pab * math.log(pab / (pa_ * pb))
    info += info.T
    parent, joined = [-1] * n, {0}
    while len(joined) < n:
        i, j = max(((i, j) for i in joined for j in range(n) if j not in joined), key=lambda x: info[x])
        parent[j] = i
        joined.add(j)
    return parent


def fit_label_model(votes: np.ndarray, weight: np.ndarray, known: np.ndarray, rounds: int = 60, negative: tuple[int, ...] = ()) -> LabelModel:
    """Expectation maximisation over vote patterns (rows), their counts, and counts of them by known label.

    Known labels (pattern x label) anchor the hidden one: without them, the label could settle on any cause
    that voters share. Each of them counts ANCHOR times as much as a row without one. A voter may speak for either label;
    ``negative`` ones start as speaking for 0.
    """
    anchor = known * ANCHOR
    positive = [v for v in range(votes.shape[1]) if v not in negative]
    guess = np.where(votes[:, positive].sum(axis=1) > 0, 0.9, 0.02)
    q = (known[:, 1] + 2 * guess) / (known.sum(axis=1) + 2)
    parent = _tree(votes, weight, q)
    n = votes.shape[1]
    model = LabelModel(0.5, parent, np.full((n, 2, 2), 0.5))
    for _ in range(rounds):
        both = np.stack([weight * (1 - q), weight * q], axis=1) + anchor
        model.prior = float(np.clip(both[:, 1].sum() / max(both.sum(), 1e-9), 1e-4, 0.6))
        for v in range(n):
            above = votes[:, parent[v]] if parent[v] >= 0 else np.zeros(len(votes), int)
            for a in (0, 1):
                at = both[above == a]
                yes = (at * votes[above == a][:, [v]]).sum(axis=0)
                model.rate[v, a] = np.clip((yes + [0.01, 0.5]) / (at.sum(axis=0) + 1), [1e-5, 1e-3], [0.999, 0.999])
        q = model.posterior(votes)
    return model


def _dealt(ranked: list[str], n: int) -> list[frozenset[str]]:
    """Features in order of strength, dealt to ``n`` voters, each of twice as many as the one before: the model finds out how far each is to be trusted."""
    ends = [len(ranked) * (2**i - 1) // (2**n - 1) for i in range(n + 1)]
    return [frozenset(ranked[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _pattern(found: set[str], voters: list[frozenset[str]]) -> int:
    return sum(1 << i for i, lexicon in enumerate(voters) if not lexicon.isdisjoint(found))


def _bits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(V)) & 1


def _logistic(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 4000) -> tuple[np.ndarray, float]:
    """Weights and intercept over sparse 0/1 rows, by gradient steps with diagonal scaling and an L2 term.

    Weights are kept from falling below 0: a long text doesn't outweigh its insults by all else it says.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], int)
    w, b = np.zeros(size), math.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    g2, gb2 = np.full(size, 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(at, w[col], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(1, len(rows))
        g = np.bincount(col, r[at], size) + 1e-6 * w
        g2, gb = g2 + g * g, r.sum()
        gb2 += gb * gb
        w = np.maximum(w - g / np.sqrt(g2), 0.0)
        b -= 0.1 * gb / math.sqrt(gb2)
    return w, b


@dataclass
class Classifier:
    """A linear score over features; what the executors get. At most CLASSIFIER entries."""

    weights: dict[str, float]
    intercept: float

    def score(self, text: str) -> float:
        get = self.weights.get
        z = self.intercept + sum(sorted(get(f, 0.0) for f in features(text) if f in self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Train on ``docs``; labels count only of rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > LABELLED_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * LABELLED_ROWS / n))
    # about LABELLED_ROWS rows of two numbers, whatever the input
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names, toxic = [], []
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    got = features(text or "")
                    names += got
                    toxic += [y] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])

    totals = sample.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = totals["pos"] or 0, totals["n"] - (totals["pos"] or 0)
    counts = sample.mapInArrow(mine, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    ratio = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
    rated = counts.where((F.col("p") + F.col("q") >= SUPPORT) & ~F.col("feature").startswith("#")).select("feature", "p", "q", ratio.alias("ratio"))
    mined = [r["feature"] for r in rated.where((F.col("p") >= SUPPORT) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc(F.col("ratio") * F.sqrt("p")), "feature").limit(MINED).collect()]
    chosen = [r["feature"] for r in rated.where(F.col("ratio") >= CLASSIFIER_RATIO).orderBy(F.desc(F.col("ratio") * F.log2(F.col("p") + 2)), "feature").limit(CLASSIFIER).collect()]
    words, starts = [f for f in mined if f[0] != "^"], [f for f in mined if f[0] == "^"]
    harmless = rated.where((F.col("q") >= NEGATIVE_SUPPORT) & (F.col("ratio") <= NEGATIVE_RATIO)).orderBy(F.col("ratio") * F.sqrt("q"), "feature").limit(NEGATIVE)
    voters = _dealt(words, LEXICONS) + _dealt(starts, PATTERNS) + [INSULTS, *(frozenset([f]) for f in FORMS), frozenset(r["feature"] for r in harmless.collect())]
    index = {f: i for i, f in enumerate(chosen)}
    sent = spark.sparkContext.broadcast((voters, index))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, _ = sent.value
        for batch in batches:
            seen = np.zeros(1 << V, np.int64)
            for i in range(batch.num_rows):
                seen[_pattern(features(batch.column(0)[i].as_py() or ""), voters)] += 1
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["pattern", "n"])

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, index = sent.value
        for batch in batches:
            sets = [features(t or "") for t in batch.column(0).to_pylist()]
            patterns = [_pattern(s, voters) for s in sets]
            rows = [sorted(index[f] for f in s if f in index) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int64()), pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["pattern", "row", "toxic"])

    votes = docs.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 2^V rows
    if not votes or not pos:
        return Classifier({}, -6.0)
    # about LABELLED_ROWS rows of the classifier's few features
    taken = sample.mapInArrow(examples, "pattern long, row array<int>, toxic int").orderBy("pattern", "row", "toxic").collect()
    patterns = sorted({r["pattern"] for r in votes})
    at = {p: i for i, p in enumerate(patterns)}
    weight, known = np.zeros(len(at)), np.zeros((len(at), 2))
    for r in votes:
        weight[at[r["pattern"]]] += r["n"]
    for r in taken:
        known[at[r["pattern"]], int(r["toxic"] > 0)] += 1
    model = fit_label_model(_bits(np.array(patterns)), weight, known, negative=(V - 1,))
    target = model.posterior(_bits(np.array([r["pattern"] for r in taken])))
    w, b = _logistic([r["row"] for r in taken], target, len(chosen))
    return Classifier({f: float(w[i]) for f, i in index.items() if w[i]}, float(b))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            rated = [of.score(batch.column(1)[i].as_py() or "") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rated, pa.float64())], ["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train and score. Null and empty texts get the score of no features; a null doc_id is never held out.

    Rows with null or repeated doc_id are scored each for itself; a document with several labels counts
    as toxic if one says so; null labels are left out. Without toxic labels every score is low. Empty
    tables give an empty result; other columns are not read.
    """
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay.

    Null and empty texts get the score of no features and stay where that is low; repeated rows and null ids are
    rows of their own; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            texts = batch.column(text)
            yield batch.filter(pa.array([of.score(texts[i].as_py() or "") < 0.5 for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
