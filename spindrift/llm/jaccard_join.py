"""N-gram Jaccard join: components of documents whose shingle sets overlap by 75 of 100.

Exact, in two steps. The first links each set to one likely partner, found by its smallest hashes; what
it finds lets the second leave out most pairs, as it only has to look between components. The second is
the prefix join: in a global order, rare shingles first, two sets that overlap enough share a shingle of
their prefixes, at places that leave room for the overlap. Candidates of one document are held in a
prefix tree, which is walked once: sets that begin alike share the overlap counted so far, and subtrees
are left where the remaining lengths can't reach the threshold.

Equal sets are one class from the start, so that copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, row_copy, scratch, staged, texts_of
from .components import components
from .shingles import chunks, mix, shingle_sets

#: Smallest hashes of a set, and how many two sets must share to be tried in the first step.
SMALLEST, SHARED = 8, 3
#: Rounds with hubs at most, by smallest hashes and by prefixes; each leaves fewer pairs for the join and changes no result.
ROUNDS, PREFIX_ROUNDS = 1, 1
#: Shingles in so many sets count as common and go last in the order; at most COMMON of them are broadcast
#: (16 bytes each). The order changes cost alone, never results.
OFTEN, COMMON = 32, 200_000
#: Shingles a task counts at a time.
COUNTED = 6_000_000
#: Words of the bit filter that keeps texts without candidates from being shuffled (1 MB), and the ids up to which it is
#: sharp; more ids select their texts by a join.
FILTER_WORDS, FILTER_IDS = 1 << 17, 1_000_000
#: Sets in one prefix tree.
TREE = 256


def _need(threshold: int, a, b):
    """Least overlap at which sets of sizes a and b link: 100 * i >= threshold * (a + b - i)."""
    return -(-threshold * (a + b) // (100 + threshold))


def tree_links(probe: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[bool]:
    """Which of the sets link with ``probe``, by one walk of their prefix tree."""
    if len(sets) == 1:
        overlap = len(np.intersect1d(probe, sets[0], assume_unique=True))
        return [overlap >= _need(threshold, len(probe), len(sets[0]))]
    # the tree's order: shingles of most sets first, so that branches part late
    tokens, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -often))] = np.arange(len(tokens))
    in_probe = np.zeros(len(tokens), bool)
    in_probe[rank] = np.isin(tokens, probe, assume_unique=True)
    parts = np.split(rank[where], np.cumsum([len(s) for s in sets])[:-1])
    keyed = sorted((np.sort(p).astype(">u4").tobytes(), i) for i, p in enumerate(parts))
    ordered = [np.frombuffer(k, ">u4").astype(np.int64) for k, _ in keyed]
    sizes, links = np.array([len(o) for o in ordered]), [False] * len(sets)
    nodes = [(0, len(ordered), 0, 0)]  # a node: the sets [lo, hi) agree on the first ``depth`` shingles
    while nodes:
        lo, hi, depth, overlap = nodes.pop()
        first, last = ordered[lo], ordered[hi - 1]
        end = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:end] != last[depth:end])
        end = depth + int(differ[0]) if len(differ) else end
        overlap += int(in_probe[first[depth:end]].sum())
        room = min(int(sizes[lo:hi].max()) - end, len(probe) - overlap)
        if overlap + room < _need(threshold, len(probe), int(sizes[lo:hi].min())):
            continue
        while lo < hi and sizes[lo] == end:  # sets that end here
            links[keyed[lo][1]] = overlap >= _need(threshold, len(probe), end)
            lo += 1
        while lo < hi:
            token, to = ordered[lo][end], lo + 1
            while to < hi and ordered[to][end] == token:
                to += 1
            nodes.append((lo, to, end, overlap))
            lo = to
    return links


def _sets(rows: DataFrame, length: int) -> DataFrame:
    """Two kinds of rows: of documents (token null), and of shingles that a task met in several sets (uid null)."""
    fields = ["uid", "doc_id", "n", "s1", "s2", "smallest", "token", "cnt"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n > 1].view(np.int64), n[n > 1]
        none = [None] * len(token)
        return pa.RecordBatch.from_arrays([*(pa.array(none, k) for k in kinds[:6]), pa.array(token), pa.array(n.astype(np.int64))], fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, seen = [], 0, set()
        for batch in batches:
            for part in chunks(batch):
                cols: list[list] = [[] for _ in range(6)]
                uids, ids, texts = (c.to_pylist() for c in part.columns)
                for uid, doc, s in zip(uids, ids, shingle_sets(texts, length), strict=True):
                    # two sums over the set: equal sets have equal sums, others don't but by a chance of 2^-128
                    s1, s2 = (int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, mix(s))) if len(s) else (None, None)
                    for col, v in zip(cols, (uid, doc, len(s), s1, s2, s[:SMALLEST].view(np.int64).tolist()), strict=True):
                        col.append(v)
                    if len(s) and (s1, s2) not in seen:
                        seen.add((s1, s2))
                        held.append(s)
                        held_n += len(s)
                none = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), pa.array(none, pa.int64()), pa.array(none, pa.int64())], fields)
                if held_n > COUNTED:
                    yield often(held)
                    held, held_n = [], 0
        if held:
            yield often(held)

    return rows.select("uid", "doc_id", "text").mapInArrow(scan, "uid long, doc_id long, n long, s1 long, s2 long, smallest array<long>, token long, cnt long")


def _common(found: DataFrame) -> dict[int, int]:
    """Common shingles and in how many sets at least; no more than COMMON."""
    counts = staged(found.where("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= OFTEN), "jaccard-common")
    step = F.floor(F.log2("cnt") * 8).cast("int").alias("step")
    least, n = None, 0
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 8 rows for each doubling
        n += r["n"]
        if n > COMMON:
            break
        least = r["step"]
    got = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    return dict(zip(got["token"].tolist(), got["cnt"].tolist(), strict=True))


def _postings(rows: DataFrame, length: int, threshold: int, common: dict[int, int]) -> DataFrame:
    """(token, uid, n, pos): prefixes in the global order, of one document for each set that a task meets."""
    order = np.array(sorted(common), np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((order, np.array([common[t] for t in order.tolist()], np.int64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        known_u, seen = known.view(np.uint64), set()
        by = np.argsort(known_u)
        known_u, counts = known_u[by], counts[by]
        for batch in batches:
            for part in chunks(batch):
                out: list[list[np.ndarray]] = [[], [], [], []]
                uids, texts = (c.to_pylist() for c in part.columns)
                for uid, s in zip(uids, shingle_sets(texts, length), strict=True):
                    n = len(s)
                    key = s.tobytes() if n <= 8 else (n, int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64)))
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    if len(known_u):
                        at = np.minimum(np.searchsorted(known_u, s), len(known_u) - 1)
                        s = s[np.argsort(np.where(known_u[at] == s, counts[at], 0), kind="stable")]
                    k = n - -(-threshold * n // 100) + 1
                    for col, v in zip(out, (s[:k].view(np.int64), np.full(k, uid, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)), strict=True):
                        col.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["token", "uid", "n", "pos"])

    return rows.select("uid", "text").mapInArrow(scan, "token long, uid long, n int, pos int")


def _wanted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, text) of the rows that a pair names, and few others."""
    ids = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
    if ids.count() > FILTER_IDS:
        return rows.select("uid", "text").join(ids, "uid", "left_semi")
    place = F.pmod(F.xxhash64("uid"), F.lit(FILTER_WORDS * 64))
    one = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(uid), {FILTER_WORDS * 64}) % 64 as int))")
    bits = ids.select((place / 64).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    words = np.zeros(FILTER_WORDS, np.int64)
    for r in bits.toLocalIterator():  # at most FILTER_WORDS rows
        words[r["w"]] = r["b"]
    sent = rows.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf("boolean")
    def wanted(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((sent.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1)

    return rows.select("uid", "text").where(wanted(place))


def _verified(rows: DataFrame, pairs: DataFrame, length: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of ``pairs``, a staged table, whose sets link; a and b are row ids."""
    texts = _wanted(rows, pairs)
    left = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, probe = None, None
        for batch in batches:
            for part in chunks(batch, TREE):
                a, b, ta, tb = (c.to_pylist() for c in part.columns)
                at, found = 0, []
                while at < len(b):
                    to = at + 1
                    while to < len(b) and b[to] == b[at]:
                        to += 1
                    if b[at] != last:
                        last, probe = b[at], shingle_sets([tb[at]], length)[0]
                    found += [i for i, ok in zip(range(at, to), tree_links(probe, shingle_sets(ta[at:to], length), threshold), strict=True) if ok]
                    at = to
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64())], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, length: int = 5, threshold: int = 75) -> DataFrame:
    """Per document: uid, doc_id, n_shingles, component_id.

    Words are cut at white space and A-Z lower-cased; a set holds the distinct ``length``-word shingles of
    the whole text, or the whole sequence where there are fewer words. Two documents link when
    100 * |a & b| >= threshold * |a | b|; component_id is the smallest doc_id reachable. Null texts and
    texts without words have an empty set and link with nothing. Rows with equal doc_id are documents of
    their own; a null doc_id is no component's id unless all of its are null. An empty table gives an
    empty result; other columns are not read.
    """
    with scratch(docs.sparkSession):
        return kept(_components(texts_of(docs, "jaccard-texts"), length, threshold).drop("component"), "jaccard-result")


def _components(rows: DataFrame, length: int, threshold: int) -> DataFrame:
    """``jaccard_components`` of rows (uid, doc_id, text) that give the same whenever they are read."""
    found = staged(_sets(rows, length), "jaccard-sets")
    own = found.where("uid is not null").select("uid", "doc_id", "n", "s1", "s2", "smallest")
    full = own.where("n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep"))
    table = staged(full.join(classes, ["n", "s1", "s2"]).select("uid", "rep", "n", "smallest"), "jaccard-classes")
    reps = table.where("uid = rep")

    # first step: in each round the likeliest partner of each class in another component, among those of about its size
    band = F.floor(F.log("n") / np.log(100 / threshold)).cast("int").alias("band")
    small = reps.select("uid", band, F.explode("smallest").alias("token"))
    several = small.groupBy("token", "band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    small = staged(small.join(several, ["token", "band"]), "jaccard-smallest")
    links, near = None, None
    for turn in range(ROUNDS):
        placed = small.withColumn("component", F.col("uid")) if near is None else small.join(near.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        # the hub of a shingle: first its earliest row, as originals come before their copies, then another one in each round
        order = F.struct((F.col("uid") if turn == 0 else F.xxhash64("uid", F.lit(turn))).alias("o"), "uid", "component")
        hubs = placed.groupBy("token", "band").agg(F.min(order).alias("hub")).select("token", "band", F.col("hub.uid").alias("hub"), F.col("hub.component").alias("hub_component"))
        tries = placed.join(hubs, ["token", "band"]).where(F.col("component") != F.col("hub_component")).groupBy("uid", "hub").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED)
        best = tries.groupBy("uid").agg(F.max(F.struct("k", (-F.col("hub")).alias("h"))).alias("x"))
        firsts = staged(best.select(F.col("uid").alias("a"), (-F.col("x.h")).alias("b")), "jaccard-first")
        more = staged(_verified(rows, firsts, length, threshold), "jaccard-first-links")
        found_links = more.count()
        links = more if links is None else links.union(more)
        if found_links or near is None:
            near = components(links if near is None else near.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "jaccard-stars")
        if 50 * found_links < firsts.count():
            break

    # second step: prefixes that meet between those components
    posts = _postings(rows, length, threshold, _common(found))
    spread = posts.groupBy("token").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi").select("token")
    met = staged(posts.join(spread, "token"), "jaccard-postings")
    labels = table.select("uid", "rep").join(near.select(F.col("node").alias("rep"), "component"), "rep", "left").select("uid", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = met.join(labels, "uid").groupBy("token", "rep", "component").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    labelled = staged(labelled, "jaccard-labelled")
    # hubs of a shingle's sets: the one with fewest shingles of its own before it, as an original has none beside its copies
    for _ in range(PREFIX_ROUNDS):
        hubs = labelled.groupBy("token").agg(F.min(F.struct("pos", "n", "rep", "component")).alias("hub"), F.max("component").alias("hi"), F.min("component").alias("lo")).where("lo < hi").select("token", "hub")
        tries = labelled.join(hubs, "token").where(F.col("component") != F.col("hub.component")).groupBy("rep", F.col("hub.rep").alias("hub")).agg(F.count(F.lit(1)).alias("k"), F.min("hub.pos").alias("p"))
        best = tries.groupBy("rep").agg(F.max(F.struct((-F.col("p")).alias("p"), "k", (-F.col("hub")).alias("h"))).alias("x"))
        firsts = staged(best.select(F.col("rep").alias("a"), (-F.col("x.h")).alias("b")), "jaccard-hubs")
        more = staged(_verified(rows, firsts, length, threshold), "jaccard-hub-links")
        if more.isEmpty():
            break
        near = components(near.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "jaccard-stars")
        moved = labelled.drop("component").join(near.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        labelled = staged(moved.select("token", "rep", "component", "n", "pos"), "jaccard-labelled")
    between = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    open_ = labelled.join(between, "token")
    x, y = open_.alias("x"), open_.alias("y")
    need = F.ceil(threshold * (F.col("x.n") + F.col("y.n")) / (100 + threshold))
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (F.col("x.rep") > F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & (room >= need) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * threshold)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = _verified(rows, staged(pairs, "jaccard-pairs"), length, threshold)

    known = near.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    whole = components(known.union(staged(more, "jaccard-links")), "jaccard-components")
    of = table.select("uid", "rep").join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left").select("uid", F.coalesce("component", "rep").alias("component"))
    joined = staged(own.select("uid", "doc_id", "n").join(of, "uid", "left").withColumn("component", F.coalesce("component", "uid")), "jaccard-result")
    names = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return joined.join(names, "component").select("uid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "component")


def one_of_each(docs: DataFrame, length: int = 5, threshold: int = 75) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest doc_id. All columns stay, whatever their names.

    Null and empty texts all stay, as they link with nothing; of rows with equal doc_id and text one stays;
    a null doc_id counts as the greatest. An empty table gives an empty result.
    """
    rows, uid = row_copy(docs, "jaccard-rows")
    with scratch(docs.sparkSession):
        found = _components(rows.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), length, threshold)
        # a component may hold a third of all documents: its first is found by aggregation
        key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
        firsts = kept(found.groupBy("component").agg(F.min(key).alias("k")).select(F.col("k.uid").alias(uid)), "jaccard-firsts")
    return rows.join(firsts, uid, "left_semi").drop(uid)
