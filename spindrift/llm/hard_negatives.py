"""Hard negatives by an inverted multi-index over two half spaces.

1. Vectors become integers. Two codebooks, one for each half of the dimensions, are fitted on a bounded sample; every row is
   assigned to a cell, its pair of codes, and each code and cell keeps the radius of its rows. Cells are stored as
   blocks of about ``BLOCK`` rows, so a cell with a third of all rows is many blocks.
2. For an anchor, a code's bound is the half score of its centre plus the anchor's half norm times the radius. A heap over the two
   sorted lists visits cells by the sum of bounds, without forming all of them.
3. Anchors ask for cells in rounds that cover more and more rows. An anchor stops asking once the next sum is below what it
   has: its worst positive, then, for each positive's window, the worst negative in it or the window's lower end. So what
   it has is certified, and results are exact; only cost depends on the codebooks.
4. What anchors ask of a block is joined to the block, scored as a product of matrices, and cut to the best few for each anchor.
   Asks grow with anchors times blocks, which no estimate of Spark's knows: joins are by shuffle, never through the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, row_copy, scratch, staged

#: Rows the codebooks are fitted on, and rounds of fitting. Change cost only.
SAMPLE, FIT_ROUNDS = 20_000, 8
#: Codes of a half at most; rows that a cell should hold on average.
CODES, CELL_ROWS = 64, 1024
#: Rows of a block and anchors that meet it at once.
BLOCK, ASKS = 2048, 256
#: Parts of all rows that an anchor may have asked for by the end of each round.
ROUNDS = (1 / 32, 1 / 4, 1)
_NO_ID = (1 << 63) - 1
_FLOOR = -(1 << 62)


def quantised(vectors: DataFrame, anchor: Column, scale: int = 256) -> DataFrame:
    """(uid, vec_id, label, anchor, q) of the rows that take part, staged."""
    whole = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    copy, _ = row_copy(vectors.where(whole), "negatives-rows", F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), q.alias("q"))
    return copy


def codebook(sample: np.ndarray, codes: int) -> np.ndarray:
    """Centres by Lloyd's rounds from rows spread over the sample; an empty code keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, codes).astype(int)].astype(np.float64)
    for _ in range(FIT_ROUNDS):
        to = assign(sample, centres)[0]
        for c in range(codes):
            if len(mine := sample[to == c]):
                centres[c] = mine.mean(axis=0)
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    to = ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
    return to, np.sqrt(((x - centres[to]) ** 2).sum(axis=1))


def visits(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs (sum of bounds, i, j) by falling sum: a heap of candidates over two sorted lists."""
    i_of, j_of = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = a[i_of].tolist(), b[j_of].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, i_of[i], j_of[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):  # each pair has one way in
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up with zeros."""
    n, lengths = len(column), np.asarray(column.value_lengths())
    if (lengths == dims).all():
        return np.asarray(column.flatten(), dtype=np.float64).reshape(n, dims)
    out = np.zeros((n, dims))
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


class Index:
    """Codebooks, radii and the blocks of each cell: what anchors need to choose cells. Bounded by ``CODES`` squared."""

    def __init__(self, rows: DataFrame, total: int, dims: int):
        self.dims, self.half, self.total = dims, dims // 2, total
        picked = rows.select("q").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow()["q"].combine_chunks()
        sample = _matrix(picked, dims)
        self.codes = codes = int(min(CODES, max(2, math.isqrt(total // CELL_ROWS))))
        self.books = codebook(sample[:, : self.half], codes), codebook(sample[:, self.half :], codes)
        self.rows = staged(self._assigned(rows), "negatives-cells")
        found = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max("t").alias("t")).orderBy("cell").collect()  # at most CODES ** 2
        self.count, self.first, at = {}, {}, 0
        self.radius, self.own = np.zeros((2, codes)), {}
        for x in found:
            c = x["cell"]
            self.count[c], self.first[c], self.own[c] = x["n"], at, (x["r"], x["t"])
            at += -(-x["n"] // BLOCK)
            for h, (code, r) in enumerate(zip(divmod(c, codes), (x["r"], x["t"]), strict=True)):
                self.radius[h, code] = max(self.radius[h, code], r)

    def _assigned(self, rows: DataFrame) -> DataFrame:
        dims, half, codes, books = self.dims, self.half, self.codes, self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("q"), dims)
                (i, r), (j, t) = assign(x[:, :half], books[0]), assign(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "vec_id", "label", "q")), pa.array(i * codes + j, pa.int32()), pa.array(r), pa.array(t)], ["uid", "vec_id", "label", "q", "cell", "r", "t"])

        return rows.select("uid", "vec_id", "label", "q").mapInArrow(run, "uid long, vec_id long, label long, q array<long>, cell int, r double, t double")

    def blocks(self) -> DataFrame:
        """(block, uids, ids, labels, vectors): rows dealt within their cell by hash, packed as little-endian numbers; staged."""
        spark, dims = self.rows.sparkSession, self.dims
        cells = spark.createDataFrame([(c, self.first[c], -(-n // BLOCK)) for c, n in self.count.items()], "cell int, first long, n long")
        dealt = self.rows.join(F.broadcast(cells), "cell")  # at most CODES ** 2 rows
        dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("uid"), F.col("n"))).alias("block"), "uid", "vec_id", "label", "q")

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros((len(part), dims), "<i4")
            for i, q in enumerate(part["q"]):
                x[i, : len(q)] = q
            ids = part["vec_id"].astype("Int64").fillna(_NO_ID).to_numpy("<i8")
            return pd.DataFrame({"block": [key[0]], "uids": [part["uid"].to_numpy("<i8").tobytes()], "ids": [ids.tobytes()], "labels": [part["label"].to_numpy("<i8").tobytes()], "vectors": [x.tobytes()]})

        return staged(dealt.groupBy("block").applyInPandas(pack, "block long, uids binary, ids binary, labels binary, vectors binary"), "negatives-blocks")

    def asks(self, anchors: DataFrame, share: tuple[float, float]) -> DataFrame:
        """(block, uid, label, q, windows) for the cells each anchor visits in this round; ``windows`` are (lo, hi, enough)."""
        dims, half, codes, books, radius, own = self.dims, self.half, self.codes, self.books, self.radius, self.own
        count, first, begin, end = self.count, self.first, share[0] * self.total, share[1] * self.total
        fields = ["block", "uid", "label", "q", "windows"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("q"), dims)
                blocks, which = [], []
                for k, windows in enumerate(batch.column("windows").to_pylist()):
                    least = min((max(w["lo"], w["enough"]) for w in windows), default=None)
                    if least is None:
                        continue
                    one, two = x[k, :half], x[k, half:]
                    n = float(np.sqrt(one @ one)), float(np.sqrt(two @ two))
                    slack = 1e-6 * (1 + abs(n[0]) + abs(n[1])) ** 2
                    a, b = books[0] @ one, books[1] @ two
                    seen = 0
                    for bound, i, j in visits(a + n[0] * radius[0], b + n[1] * radius[1]):
                        if bound + slack < least or seen >= end:
                            break
                        c = i * codes + j
                        if c not in count:
                            continue
                        if seen >= begin and a[i] + b[j] + n[0] * own[c][0] + n[1] * own[c][1] + slack >= least:
                            more = range(first[c], first[c] - (-count[c] // BLOCK))
                            blocks.extend(more)
                            which.extend([k] * len(more))
                        seen += count[c]
                        if len(blocks) > 4096:
                            yield taken(batch, blocks, which)
                            blocks, which = [], []
                if blocks:
                    yield taken(batch, blocks, which)

        def taken(batch: pa.RecordBatch, blocks: list[int], which: list[int]) -> pa.RecordBatch:
            of = pa.array(which, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(batch.column(f).take(of) for f in fields[1:])], fields)

        kind = "block long, uid long, label long, q array<long>, windows array<struct<lo:long,hi:long,enough:long>>"
        # an anchor asks for more than its few bytes tell: dealt to all tasks (a deal by uid would be taken as done by the join before)
        parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return anchors.select("uid", "label", "q", "windows").repartition(parts).mapInArrow(run, kind)

    def hits(self, blocks: DataFrame, asked: DataFrame, chunks: int, same: bool, best: int) -> DataFrame:
        """(uid, w, score, id, other): for each ask and window, the best rows of the block."""
        dims = self.dims
        grouped = asked.groupBy("block", F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("uid", "label", "q", "windows")).alias("asks"))
        met = grouped.join(blocks.hint("merge"), "block").drop("block", "chunk")
        names, kinds = ["uid", "w", "score", "id", "other"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    asks = batch.column("asks")[row].as_py()
                    uids, ids, labels = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in ("uids", "ids", "labels"))
                    rows = np.frombuffer(batch.column("vectors")[row].as_buffer(), "<i4").reshape(len(uids), dims).astype(np.float64)
                    x = np.zeros((len(asks), dims))
                    for k, ask in enumerate(asks):
                        x[k, : len(ask["q"])] = ask["q"]
                    scores = (x @ rows.T).astype(np.int64)  # exact: whole numbers below 2 ** 53
                    found: list[list] = [[] for _ in names]
                    for k, ask in enumerate(asks):
                        s = scores[k]
                        may = ((labels == ask["label"]) & (uids != ask["uid"])) if same else labels != ask["label"]
                        for w, window in enumerate(ask["windows"]):
                            at = np.flatnonzero(may & (s >= max(window["lo"], window["enough"])) & (s <= window["hi"]))
                            if len(at) > best:
                                worst = np.partition(s[at], len(at) - best)[len(at) - best]
                                at = at[s[at] >= worst]
                            at = at[np.lexsort((uids[at], ids[at], -s[at]))][:best]
                            for to, values in zip(found, ([ask["uid"]] * len(at), [w] * len(at), s[at].tolist(), ids[at].tolist(), uids[at].tolist()), strict=True):
                                to.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(f, kind) for f, kind in zip(found, kinds, strict=True)], names)

        return met.mapInArrow(run, "uid long, w int, score long, id long, other long")

    def search(self, blocks: DataFrame, anchors: DataFrame, chunks: int, same: bool, best: int) -> DataFrame:
        """The ``best`` rows of each anchor (uid, label, q, windows with lo and hi) and window, staged, with ``rank`` from 1."""
        got, done = None, 0.0
        order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id", "other")
        for share in ROUNDS:
            windows = F.transform("windows", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.lit(_FLOOR).alias("enough")))
            asking = anchors.withColumn("windows", windows)
            if got is not None:
                full = got.where(F.col("rank") == best).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
                windows = F.transform("windows", lambda x, w: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.coalesce(F.try_element_at("full", w), F.lit(_FLOOR)).alias("enough")))
                asking = anchors.join(full.hint("merge"), "uid", "left").withColumn("windows", windows)
            hits = self.hits(blocks, self.asks(asking, (done, share)), chunks, same, best)
            hits = hits if got is None else hits.unionByName(got.drop("rank"))
            got = staged(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best), "negatives-best")
            done = share
        return got


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Per anchor and positive, up to ``negatives`` rows: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; components become floor(scale * x), a score is their inner product. An anchor's
    positives are its first ``positives`` other rows of its label by falling score, then by vec_id. Negatives have another label and
    low * positive_score <= 100 * score <= high * positive_score, in the same order, so a positive below 0 has none.
    Rows with a null label or vector, or a null or non-finite component, take no part. A null vec_id comes last among ties and
    stays null. Rows with repeated vec_id are rows of their own, also as anchors. Shorter vectors are filled up with zeros. Vectors whose
    squared length in integers reaches 2 ** 53 are an error, as scores would not be exact. An empty table, or one without
    anchors, gives an empty result. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        rows = quantised(vectors, anchor, scale)
        about = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x)), F.count_if("anchor")).first()
        total, dims, longest, n_anchors = about
        if not total or not n_anchors:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        if longest >= 2.0**53:
            raise ValueError("vectors are too long for exact scores")
        index = Index(rows, total, dims)
        blocks = index.blocks()
        chunks = -(-n_anchors // ASKS)
        everything = F.array(F.struct(F.lit(_FLOOR).alias("lo"), F.lit(-_FLOOR).alias("hi")))
        anchors = rows.where("anchor").drop("anchor")
        near = index.search(blocks, anchors.withColumn("windows", everything), chunks, True, positives)
        bounds = F.struct("positive", F.expr(f"(score * {low} + 99) div 100").alias("lo"), F.expr(f"score * {high} div 100").alias("hi"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        near = near.withColumn("positive", F.col("rank") - 1).where("score >= 0")
        near = near.groupBy("uid").agg(F.sort_array(F.collect_list(bounds)).alias("near"))
        anchors = staged(anchors.join(near.hint("merge"), "uid").withColumn("windows", F.transform("near", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))), "negatives-anchors")
        found = index.search(blocks, anchors, chunks, False, negatives)
        out = found.join(anchors.select("uid", "vec_id", "near").hint("merge"), "uid").withColumn("p", F.col("near")[F.col("w")])

        def id_of(c: str) -> Column:
            return F.when(F.col(c) != _NO_ID, F.col(c))

        return kept(out.select(F.col("vec_id").alias("anchor_id"), id_of("p.positive_id").alias("positive_id"), "rank", id_of("id").alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
