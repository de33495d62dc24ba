"""Sequences of frames as one row each, and sums that tasks make over them: what the models of hidden states share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged

#: Frames that starting values are taken from; frames are drawn by hash.
SAMPLE = 20_000


def sequences(df: DataFrame, keys: list[str], roi: str = "roi", value: str = "value", order: str = "frame") -> tuple[DataFrame, list]:
    """((keys, frames, x), regions): one row for each sequence, x its frames one after another, regions in order within a frame.

    Staged, so that rounds of fitting read arrays and never the plan behind them. A frame that lacks a region has NaN there, as has a
    missing value. Regions are listed on the driver: thousands, not millions. A sequence is one row: hours of frames, not years.
    """
    names = sorted(r[0] for r in df.select(roi).where(F.col(roi).isNotNull()).distinct().collect())
    at = F.map_from_entries(F.collect_list(F.struct(F.col(roi).alias("k"), F.col(value).cast("double").alias("v"))))
    frames = df.where(F.col(roi).isNotNull()).groupBy(*keys, order).agg(at.alias("m"))
    dense = F.transform(F.lit(names) if names else F.array(), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(float("nan"))))
    rows = frames.select(*keys, F.struct(F.col(order).alias("o"), dense.alias("x")).alias("f")).groupBy(*keys).agg(F.sort_array(F.collect_list("f")).alias("f"))
    return staged(rows.select(*keys, F.transform("f", lambda f: f["o"]).alias("frames"), F.flatten(F.transform("f", lambda f: f["x"])).alias("x")), "sequences"), names


def matrices(pdf: pd.DataFrame, dims: int) -> list[np.ndarray]:
    """x of each row as frames by regions."""
    return [np.asarray(x, float).reshape(-1, dims) for x in pdf["x"]]


def summed(seqs: DataFrame, part: Callable[[list[np.ndarray]], np.ndarray], dims: int) -> np.ndarray:
    """The sum over all sequences of a vector that ``part`` makes of some of them; as many numbers come to the driver as the vector has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                v = part(matrices(pdf, dims))
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    got = seqs.select("x").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    return got["v"].to_numpy()


def sampled(seqs: DataFrame, dims: int) -> np.ndarray:
    """At most ``SAMPLE`` complete frames, chosen by hash."""
    last = (F.size("x") / F.lit(max(dims, 1))).cast("int") - 1
    frames = seqs.where(F.size("x") > 0).select("x", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    rows = frames.select(F.slice("x", F.col("i") * dims + 1, F.lit(dims)).alias("r")).where(~F.exists("r", F.isnan))
    got = rows.orderBy(F.xxhash64("r")).limit(SAMPLE).collect()
    return np.array([r[0] for r in got], float).reshape(-1, dims)


def per_frame(seqs: DataFrame, keys: list[str], make: Callable[[list[np.ndarray]], list[np.ndarray]], dims: int, name: str, order: str = "frame") -> DataFrame:
    """(keys, frame, name): what ``make`` gives for each sequence, a row of numbers for each frame, as an array."""
    kinds = ", ".join([*(f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in keys), f"`{order}` {seqs.schema['frames'].dataType.elementType.simpleString()}", f"`{name}` array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, got in enumerate(make(matrices(pdf, dims))):
                out = pd.DataFrame({order: list(pdf["frames"].iloc[i]), name: list(got)})
                for c in keys:
                    out[c] = [pdf[c].iloc[i]] * len(out)
                yield out[[*keys, order, name]]

    return seqs.mapInPandas(run, kinds)
