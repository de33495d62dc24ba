"""Movies as rows (keys, frame, y, x, value): blocks of low rank, and masked pixels filled from their neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.staging import staged


def _weight(c: Column, b: Column, size: int, block: int, overlap: int) -> Column:
    """Weight of a pixel in block ``b`` along one axis: it rises over the part shared with the block before and falls over the part shared with the next, so that a pixel's weights add up to 1."""
    step = block - overlap
    inside = c - b * step
    up = F.when((b == 0) | (inside >= overlap), F.lit(1.0)).otherwise((inside + 1) / F.lit(overlap + 1.0))
    ahead = inside - step  # place in the next block
    down = F.when((b == _last(size, block, overlap)) | (ahead < 0), F.lit(1.0)).otherwise(1 - (ahead + 1) / F.lit(overlap + 1.0))
    return up * down


def _last(size: int, block: int, overlap: int) -> int:
    """Number of the last block along an axis: blocks begin every block - overlap pixels until one reaches the edge."""
    return max(0, math.ceil((size - block) / (block - overlap)))


def _blocks_of(c: str, size: int, block: int, overlap: int) -> Column:
    """Array of (b, w): the blocks along one axis that hold a pixel, with its weight in each."""
    step = block - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col(c) - block + 1) / F.lit(step)).cast("int"))
    found = F.sequence(first, F.least(F.lit(_last(size, block, overlap)), F.floor(F.col(c) / F.lit(step)).cast("int")))
    return F.transform(found, lambda b: F.struct(b.alias("b"), _weight(F.col(c), b, size, block, overlap).alias("w")))


def blocks(movie: DataFrame, keys: list[str], height: int, width: int, block: int = 40, overlap: int = 10) -> DataFrame:
    """Pixels dealt to their blocks: keys, by, bx, y, x, frame, value, weight; a pixel of an overlap belongs to two blocks along that axis."""
    if not 0 <= overlap <= block // 2:
        raise ValueError("blocks overlap by half at most")
    rows = movie.withColumn("_y", F.explode(_blocks_of("y", height, block, overlap))).withColumn("_x", F.explode(_blocks_of("x", width, block, overlap)))
    return rows.select(*keys, F.col("_y.b").alias("by"), F.col("_x.b").alias("bx"), "y", "x", "frame", "value", (F.col("_y.w") * F.col("_x.w")).alias("weight"))


def _dense(row: dict, pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, matrix of frames by pixels) of one chunk."""
    frames, t = np.unique(np.asarray(row["frame"], np.int64), return_inverse=True)
    m = np.zeros((len(frames), pixels))
    m[t, np.asarray(row["p"], np.int64)] = np.asarray(row["value"], float)
    return frames, m


def _rank(s2: np.ndarray, total: float, shape: tuple[int, int], components: int, noise: float | None, part: float) -> int:
    """How many components a block keeps, from its squared singular values in falling order."""
    if noise is not None:
        return min(int((np.sqrt(s2) > noise * (np.sqrt(shape[0]) + np.sqrt(shape[1]))).sum()), components)
    if total <= 0:
        return 0
    enough = int(np.argmax(total - np.cumsum(s2) <= (1 - part + 1e-12) * total)) + 1 if (total - s2.sum() <= (1 - part + 1e-12) * total) else len(s2)
    return min(enough, int((s2 > 1e-12 * s2[0]).sum()), components)


def low_rank(
    movie: DataFrame, keys: list[str], height: int, width: int, block: int = 40, overlap: int = 10, components: int = 50, noise: float | None = None, part: float = 1.0, chunk: int = 200
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(u, v, errors): each block of a movie as a few images times a few courses.

    ``u`` has keys, by, bx, k, y, x, weight, u; ``v`` has keys, by, bx, k, frame, v; ``errors`` has keys, by, bx, rank, error, total: the squares
    left out, and all. A block keeps its leading components, up to ``components``: with ``noise`` (the standard deviation of a
    pixel's noise) those whose singular value exceeds noise (sqrt(pixels) + sqrt(frames)), the largest that noise alone
    gives; else as many as leave 1 - ``part`` of the squares at most.

    Frames are stored in chunks of ``chunk``. The images are the leading vectors of the Gram matrix of a block's pixels, added up while its
    chunks stream by; the courses are made chunk by chunk. So memory holds block ** 4 numbers and one chunk, however long the movie
    is. Pixels without a finite value count as 0.
    """
    pixels, step, names = block * block, block - overlap, [*keys, "by", "bx"]
    place = (F.col("y") - F.col("by") * step) * block + F.col("x") - F.col("bx") * step
    value = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
    dealt = blocks(movie, keys, height, width, block, overlap).select(*names, F.floor(F.col("frame") / chunk).alias("_c"), "frame", place.cast("int").alias("p"), value.alias("value"))
    chunks = staged(dealt.groupBy(*names, "_c").agg(*(F.collect_list(c).alias(c) for c in ("frame", "p", "value"))).drop("_c"), "chunks")
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in names)

    def images(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, frames = np.zeros((pixels, pixels)), 0
        for batch in batches:
            for row in batch.select(["frame", "p", "value"]).to_pylist():
                seen, m = _dense(row, pixels)
                gram += m.T @ m
                frames += len(seen)
        at = [k.as_py() for k in key]
        real = min(block, height - at[-2] * step) * min(block, width - at[-1] * step)
        total = float(np.trace(gram))
        s2, q = np.linalg.eigh(gram)
        s2, q = np.maximum(s2[::-1], 0), q[:, ::-1]
        rank = _rank(s2, total, (real, frames), components, noise, part)
        made = {**{c: [v] for c, v in zip(names, at, strict=True)}, "rank": [rank], "error": [max(total - float(s2[:rank].sum()), 0.0)], "total": [total], "u": [[list(x) for x in q[:, :rank].T]]}
        yield pa.RecordBatch.from_pydict(made, schema=shape)

    kind = f"{kinds}, rank int, error double, total double, u array<array<double>>"
    shape = to_arrow_schema(StructType.fromDDL(kind))
    found = staged(chunks.groupBy(*names).applyInArrow(images, kind), "images")
    one = found.select(*names, F.posexplode("u").alias("k", "_u")).select(*names, "k", F.posexplode("_u").alias("p", "u"))
    y, x = (F.col("by") * step + F.floor(F.col("p") / block)).cast("int"), (F.col("bx") * step + F.col("p") % block).cast("int")
    u = one.select(*names, "k", y.alias("y"), x.alias("x"), "u").where((F.col("y") < height) & (F.col("x") < width))
    u = u.select(*names, "k", "y", "x", (_weight(F.col("y"), F.col("by"), height, block, overlap) * _weight(F.col("x"), F.col("bx"), width, block, overlap)).alias("weight"), "u")

    def courses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                frames, m = _dense(row, pixels)
                v = m @ np.asarray(row["u"], float).T
                n, rank = v.shape
                made = {**{c: [row[c]] * (n * rank) for c in names}, "k": np.tile(np.arange(rank, dtype=np.int32), n), "frame": np.repeat(frames, rank).astype(np.int32), "v": v.ravel()}
                yield pa.RecordBatch.from_pydict(made, schema=line)

    line = to_arrow_schema(StructType.fromDDL(f"{kinds}, k int, frame int, v double"))
    v = chunks.join(found.where("rank > 0").select(*names, "u"), names).mapInArrow(courses, f"{kinds}, k int, frame int, v double")
    return u, v, found.select(*names, "rank", "error", "total")


def recomposed(u: DataFrame, v: DataFrame, keys: list[str], frames: tuple[int, int] | None = None) -> DataFrame:
    """(keys, frame, y, x, value): the movie from its factors, blocks blended by their weights; only frames in [first, last) where given.

    A block without components adds nothing, so a pixel of such blocks alone has no row: it is 0.
    """
    if frames is not None:
        v = v.where((F.col("frame") >= frames[0]) & (F.col("frame") < frames[1]))
    met = u.join(v, [*keys, "by", "bx", "k"])
    return met.groupBy(*keys, "frame", "y", "x").agg(F.sum(F.col("weight") * F.col("u") * F.col("v")).alias("value"))


def filled_in_space(movie: DataFrame, keys: list[str], sigma: float, value: str = "value", radius: int | None = None, most: float = 1 / 3, masked: str | None = None) -> DataFrame:
    """The movie with missing pixels as the Gaussian mean of the known ones within ``radius`` (4 sigma) along each axis; known ones stay.

    A convolution of the known values over one of what is known, in two passes: along x, then along y. ``movie`` has a row for each pixel of a
    frame. A frame in which more than ``most`` of the pixels are missing is left as it is, and so is a pixel with no known
    one near. Pixels where the boolean ``masked`` holds stay missing, though what they hold counts for their neighbours.
    """
    r = int(4 * sigma + 0.5) if radius is None else radius
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = movie.withColumn("_v", F.when(known, F.col(value).cast("double")))
    gone = F.col("_v").isNull() if masked is None else F.col("_v").isNull() | F.col(masked)
    rows = rows.withColumn("_few", F.avg(F.when(gone, 1.0).otherwise(0.0)).over(Window.partitionBy(*keys, "frame")) <= most)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    spread = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-r, r + 1), weights, strict=True))))
    at = [*keys, "frame", "y", "x"]
    # along x, only to columns that miss a pixel; then along y, only to missing pixels
    missing = rows.where(F.col("_v").isNull() & F.col("_few")).select(*at)
    columns = missing.select(*keys, "frame", "x").distinct()
    across = rows.where(F.col("_v").isNotNull() & F.col("_few")).select(*at, "_v", spread.alias("s")).select(*keys, "frame", "y", (F.col("x") + F.col("s.d")).cast("int").alias("x"), (F.col("s.w") * F.col("_v")).alias("a"), F.col("s.w").alias("b"))
    across = across.join(columns, [*keys, "frame", "x"], "left_semi").groupBy(*at).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    down = across.select(*at, "a", "b", spread.alias("s")).select(*keys, "frame", (F.col("y") + F.col("s.d")).cast("int").alias("y"), "x", (F.col("s.w") * F.col("a")).alias("a"), (F.col("s.w") * F.col("b")).alias("b"))
    found = down.join(missing, at, "left_semi").groupBy(*at).agg((F.sum("a") / F.sum("b")).alias("_f"))
    out = rows.join(found, at, "left")
    new = F.coalesce("_v", "_f")
    kept = new if masked is None else F.when(F.col("_few") & F.col(masked), F.lit(None).cast("double")).otherwise(new)
    return out.withColumn(value, kept).select(*movie.columns)
