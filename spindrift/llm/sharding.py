"""Sharding: a k-d tree over document metadata, split at weighted medians along the widest dimension.

A node stands for a number of shards and is split in two halves of them, in proportion to bytes, until
every leaf is one shard. All nodes of a level are split together: one job finds each node's extent in
every dimension, and a few jobs close in on the weighted median with histograms of a fixed number of
bins. The driver sees nodes x bins sums, never rows. Order inside a dimension is (value, text CRC, row
hash), so equal texts go apart only where a median falls inside their group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, staged, utf8_bytes

#: Histogram bins of a node in one pass.
BINS = 4096
#: The search stops once the bin at the median holds less than this share of one shard, or one row.
CLOSE = 0.002


@dataclass
class _Split:
    """The search for a node's median: ``below`` is the weight left of [lo, hi) in the order's present part."""

    dim: int
    lo: int
    hi: int
    goal: float
    close: float
    part: int = 0  # 0: the dimension's value, 1: CRC, 2: hash
    below: int = 0
    fixed: tuple[int, ...] = ()
    cut: tuple[int, int, int] | None = None

    @property
    def width(self) -> int:
        return -(-(self.hi - self.lo) // BINS)

    def narrow(self, sums: list[tuple[int, int, int]]) -> None:
        """Go on into the bin that holds the goal, or settle on one of its edges."""
        for b, w, n in sums:
            if self.below + w >= self.goal:
                break
            self.below += w
        lo, hi = self.lo + b * self.width, min(self.hi, self.lo + (b + 1) * self.width)
        if w <= self.close or n == 1 or (hi - lo == 1 and self.part == 2):
            edge = lo if self.goal - self.below <= self.below + w - self.goal else hi
            self.cut = (*self.fixed, edge, 0, 0)[:3]
        elif hi - lo == 1:
            self.fixed, self.part, self.lo, self.hi = (*self.fixed, lo), self.part + 1, 0, 1 << 32
        else:
            self.lo, self.hi = lo, hi


def _of(values: list) -> Column:
    """The value of a row's node."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("node") + 1)


def _split_level(rows: DataFrame, nodes: list[tuple[int, int]], dims: list[str], overall: list[tuple[int, int]]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Split all nodes (first shard, shards) of more than one shard; rows have their place in ``nodes`` as ``node``."""
    sums = rows.groupBy("node").agg(F.sum("size").alias("w"), *(f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))))
    splits: dict[int, _Split] = {}
    for r in sums.collect():
        first, shards = nodes[r["node"]]
        if shards > 1:
            spread = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, hi - lo) for d, (lo, hi) in zip(dims, overall, strict=True)]
            k = spread.index(max(spread))
            splits[r["node"]] = _Split(k, r[f"lo_{dims[k]}"], r[f"hi_{dims[k]}"] + 1, r["w"] * (shards // 2) / shards, CLOSE * r["w"] / shards)
    none = _Split(0, 0, 0, 0, 0, part=9)

    def values(splits: dict[int, _Split], get) -> Column:
        return _of([get(splits.get(i, none)) for i in range(len(nodes))])

    dim = values(splits, lambda s: s.dim + 1).cast("int")
    value = F.element_at(F.array(*(F.col(d) for d in dims)), dim)
    while open_ := {i: s for i, s in splits.items() if s.cut is None}:
        part = values(open_, lambda s: s.part)
        at = F.when(part == 0, value).when(part == 1, F.col("text_crc32")).when(part == 2, F.col("hash"))
        lo, hi, width = (values(open_, g) for g in (lambda s: s.lo, lambda s: s.hi, lambda s: max(1, s.width)))
        fixed = ((part < 1) | (value == values(open_, lambda s: (*s.fixed, 0)[0]))) & ((part < 2) | (F.col("text_crc32") == values(open_, lambda s: (*s.fixed, 0, 0)[1])))
        bins = rows.withColumn("_bin", F.when(fixed & (at >= lo) & (at < hi), F.floor((at - lo) / width))).where("_bin is not null")
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in bins.groupBy("node", "_bin").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            found.setdefault(r["node"], []).append((r["_bin"], r["w"], r["n"]))
        for i, s in open_.items():
            s.narrow(sorted(found[i]))
    # children take their places in the next list of nodes
    after, left = [], []
    for i, (first, shards) in enumerate(nodes):
        left.append(len(after))
        half = shards // 2
        after += [(first, half), (first + half, shards - half)] if i in splits else [(first, shards)]
    cuts = [values(splits, lambda s, k=k: (s.cut or (0, 0, 0))[k]) for k in range(3)]
    crc, hashed = F.col("text_crc32"), F.col("hash")
    below = (value < cuts[0]) | ((value == cuts[0]) & ((crc < cuts[1]) | ((crc == cuts[1]) & (hashed < cuts[2]))))
    right = F.when((_of([int(i in splits) for i in range(len(nodes))]) == 1) & ~below, 1).otherwise(0)
    return staged(rows.withColumn("node", (_of(left) + right).cast("int")), "sharding"), after


def shard(docs: DataFrame, shards: int, dims: list[str] | None = None) -> DataFrame:
    """Put every document into a shard of nearly equal bytes; a document weighs its UTF-8 bytes plus 16.

    ``dims`` names whole-number or text columns of ``docs`` to split along, beside ``size`` and the text's
    CRC; null values come first. Null texts weigh 16 and have CRC 0. Rows with null or repeated doc_id
    are placed one by one; an empty table gives an empty result. Returns doc_id, size, text_crc32, law,
    shard, slot (0, 1, ... in each shard) and grown_shard (null: the law is ``bytes``).
    """
    kinds = dict(docs.dtypes)
    named = {f"_dim{i}": F.coalesce(F.crc32(F.col(d).cast("binary")) if kinds[d] == "string" else F.col(d).cast("long"), F.lit(-1)).alias(f"_dim{i}") for i, d in enumerate(dims or [])}
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), (utf8_bytes(F.col("text")) + 16).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), *named.values())
    rows = staged(own.withColumn("hash", F.shiftrightunsigned(F.xxhash64("uid"), 32)).withColumn("node", F.lit(0)), "sharding")
    axes, nodes = ["size", "text_crc32", *named], [(0, shards)]
    ends = rows.agg(*(f(d).alias(f"{k}_{d}") for d in axes for k, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends["lo_size"] is not None:
        overall = [(ends[f"lo_{d}"], ends[f"hi_{d}"]) for d in axes]
        for _ in range(shards.bit_length()):
            if any(n > 1 for _, n in nodes):
                rows, nodes = _split_level(rows, nodes, axes, overall)
    placed = rows.withColumn("shard", _of([first for first, _ in nodes]).cast("int"))
    hottest = max((r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
    return gapless_rank(placed, ["shard"], ["uid"], "slot", hottest).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
