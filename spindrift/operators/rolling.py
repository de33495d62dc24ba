"""Centred rolling windows over frames of each region of interest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widest Gaussian that is written as a sum of lagged columns; wider ones run per trace in NumPy.
LAGGED = 64


def centred(width: int, keys: list[str], order: str = "frame"):
    """The window of ``width`` rows around each row: width // 2 before, (width - 1) // 2 after."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)


def guarded(value: Column, counted: str, window, least: int) -> Column:
    """``value`` where the window holds at least ``least`` values (one at least), else null."""
    return F.when(F.count(counted).over(window) >= max(1, least), value)


def by_traces(df: DataFrame, keys: list[str], order: str, made: dict[str, tuple[str, Callable[[np.ndarray], np.ndarray]]]) -> DataFrame:
    """Add columns: for each name, a function of the values of one column in order, one trace at a time; missing values are NaN there.

    Rows come sorted, in batches of many traces, so that traces cost what is computed on them; a task holds a batch and one trace.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, order)
    names = [f.name for f in df.schema.fields if f.name not in made]

    def filled(pdf: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        new = {}
        for name, (column, compute) in made.items():
            x = pdf[column].to_numpy(float)
            new[name] = np.concatenate([np.asarray(compute(x[i:j]), float) for i, j in zip(ends[:-1], ends[1:], strict=True)])
        return pdf[names].assign(**new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([held[-1].iloc[-1:], pdf], ignore_index=True) if held else pdf
            new = np.zeros(len(pdf), bool)
            for k in keys:
                x, y = pdf[k], pdf[k].shift()
                new |= (x.ne(y) & ~(x.isna() & y.isna())).to_numpy()
            new[0] = False
            starts = np.flatnonzero(new)
            if held:  # the row before is there to compare with
                pdf, starts = pdf.iloc[1:], starts - 1
            if not len(starts):
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True)
            before = len(whole) - starts[-1]
            ends = np.r_[0, starts + before]
            yield filled(whole, ends)
            held = [pdf.iloc[starts[-1] :]]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield filled(whole, np.array([0, len(whole)]))

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"`{c}` double" for c in made)])
    return rows.mapInPandas(run, schema)


def chained(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """One function of a trace after another."""

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = np.asarray(step(x), float)
        return x

    return run


def slider(how: str, width: int, least: int = 1, q: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """A rolling ``how`` of a trace, as ``rolling`` takes it."""

    def slide(x: np.ndarray) -> np.ndarray:
        w = pd.Series(x).rolling(width, center=True, min_periods=max(1, least))
        return w.quantile(q) if how == "quantile" else w.std(ddof=0) if how == "std" else getattr(w, how)()

    return slide


def smoother(width: int, sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """The Gaussian-weighted rolling mean of a trace, as ``gaussian_rolling`` takes it."""
    kernel = np.array(gaussian_weights(width, sigma))[::-1]

    def full(v: np.ndarray) -> np.ndarray:
        size = 1 << (len(v) + width - 1).bit_length()
        made = np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(kernel, size), size) if width > 512 else np.convolve(v, kernel)
        return made[(width - 1) // 2 : (width - 1) // 2 + len(v)]

    def smooth(x: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(x)
        under = full(seen.astype(float))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(under > 1e-12, full(np.where(seen, x, 0.0)) / under, np.nan)

    return smooth


def rolling(df: DataFrame, how: str, column: str, width: int, name: str, keys: list[str], least: int = 1, q: float = 0.5, order: str = "frame") -> DataFrame:
    """Add a rolling ``how``: mean, min, max, sum, std, median or quantile (``q``, linear).

    Spark evaluates a sliding frame anew for each row; windows over LAGGED rows slide along each trace in pandas, which keeps
    the window's sum, order or extremes from one row to the next.
    """
    if width > LAGGED:
        return by_traces(df, keys, order, {name: (column, slider(how, width, least, q))})
    w = centred(width, keys, order)
    made = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop, "median": lambda c: F.percentile(c, F.lit(0.5)), "quantile": lambda c: F.percentile(c, F.lit(q))}[how](column)
    return df.withColumn(name, guarded(made.over(w), column, w, least))


def gaussian_weights(width: int, sigma: float) -> list[float]:
    """Weights of a symmetric Gaussian window."""
    return [math.exp(-0.5 * ((k - (width - 1) / 2) / sigma) ** 2) for k in range(width)]


def gaussian_rolling(df: DataFrame, column: str, width: int, sigma: float, name: str, keys: list[str], order: str = "frame") -> DataFrame:
    """Add the Gaussian-weighted rolling mean; weights of missing values don't count.

    One window operator with lagged columns up to LAGGED rows; wider windows are convolved trace by trace.
    """
    weights, before = gaussian_weights(width, sigma), width // 2
    if width <= LAGGED:
        w = Window.partitionBy(*keys).orderBy(order)
        near = [F.col(column) if k == before else F.lag(column, before - k).over(w) if k < before else F.lead(column, k - before).over(w) for k in range(width)]
        top = sum((F.coalesce(x * F.lit(g), F.lit(0.0)) for x, g in zip(near, weights, strict=True)), F.lit(0.0))
        under = sum((F.when(x.isNotNull(), F.lit(g)).otherwise(0.0) for x, g in zip(near, weights, strict=True)), F.lit(0.0))
        return df.withColumn(name, F.when(under > 0, top / under))
    return by_traces(df, keys, order, {name: (column, smoother(width, sigma))})


def debounced(df: DataFrame, flag: str, seconds: float, fs: float, name: str, keys: list[str], order: str = "frame") -> DataFrame:
    """Median filter of a boolean over 2 (fs seconds // 2) + 1 rows; beyond its ends a trace is reflected, the last row first.

    Rows near an end stand in for those beyond it, so the window is always whole and never ties. A null counts as false.
    """
    half = int(fs * seconds) // 2
    by = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(by)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(order)).cast("int") - 1).withColumn("_n", n.cast("int"))
    turns = F.ceil(F.lit(half) / (2 * F.col("_n"))).cast("int") + 1
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(F.col("_i") + 2 * F.col("_n") * k, -1 - F.col("_i") + 2 * F.col("_n") * k)))
    rows = rows.withColumn("_p", F.explode(F.filter(places, lambda p: (p >= -half) & (p < F.col("_n") + half))))
    hits = F.sum(F.coalesce(F.col(flag).cast("int"), F.lit(0))).over(by.orderBy("_p").rowsBetween(-half, half))
    return rows.withColumn(name, hits > half).where("_p = _i").drop("_i", "_n", "_p")


def running(df: DataFrame, keys: list[str], fs: float = 10.0, threshold: int = 4, seconds: float = 4.0, name: str = "running", order: str = "frame") -> DataFrame:
    """Frames of running: velocity, cut to whole numbers, over ``threshold``, debounced over ``seconds``."""
    fast = df.withColumn("_fast", F.col("velocity").cast("double").cast("long") > threshold)
    return debounced(fast, "_fast", seconds, fs, name, keys, order).drop("_fast")


def zscore(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """(x - mean) / population deviation in each group; null where the deviation is 0."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0)))


def robust_zscore(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """(x - median) / interquartile range in each group."""
    q = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return df.join(q, keys).withColumn(name, (F.col(column) - F.get("_q", F.lit(1))) / F.nullif(F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)), F.lit(0.0))).drop("_q")


def interpolated(df: DataFrame, column: str, name: str, keys: list[str], order: str, limit: int | None = None) -> DataFrame:
    """Straight lines over missing values between known ones; edges take the nearest known value.

    With ``limit``, only the first ``limit`` rows of a gap are filled.
    """
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # backwards, as Spark reads a frame from each row to the end anew for each row
    ahead = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(order).cast("double").alias("o"), F.col(column).alias("v")))
    rows = df.withColumn("_a", F.last(known, True).over(past)).withColumn("_b", F.last(known, True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.o")) / (F.col("_b.o") - F.col("_a.o"))
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line).otherwise(F.coalesce("_a.v", "_b.v"))
    if limit is not None:
        value = F.when(F.col(column).isNotNull() | (F.col(order) - F.col("_a.o") <= limit), value)
    return rows.withColumn(name, value).drop("_a", "_b")


def find_first_n(df: DataFrame, flag: str, n: int, width: int, keys: list[str], order: str, name: str) -> DataFrame:
    """Per group, the first position with at least ``n`` hits in the ``width`` rows from it on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    hits = df.withColumn("_hits", F.sum(F.col(flag).cast("int")).over(w))
    return hits.groupBy(*keys).agg(F.min(F.when(F.col("_hits") >= n, F.col(order))).alias(name))
