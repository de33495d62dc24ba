"""Durations beyond which events are rarely false, from curves fitted to the false positive rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def false_positive_rates(positive: DataFrame, negative: DataFrame, per_second: float = 4.0) -> DataFrame:
    """(a, curve): per amplitude bin the rates of negative-going to positive-going events by duration, as (t, rate) in order; null where there are no events.

    Histograms have (a, d, n); duration bin d begins at d / ``per_second`` seconds.
    """
    both = positive.select("a", "d", F.col("n").alias("up")).join(negative.select("a", "d", F.col("n").alias("down")), ["a", "d"], "full")
    rate = ratio(F.coalesce("down", F.lit(0)), F.coalesce("up", F.lit(0)))
    point = F.struct((F.col("d") / F.lit(per_second)).alias("t"), rate.cast("double").alias("rate"))
    return both.groupBy("a").agg(F.sort_array(F.collect_list(point)).alias("curve"))


def exponential(t: np.ndarray, r: np.ndarray) -> tuple[float, float, float]:
    """(a, b, c) of a exp(-b t) + c by least squares: for each b the other two are a line; b is searched on a grid, then by narrowing."""

    def line(b: float) -> tuple[float, np.ndarray]:
        x = np.stack([np.exp(-b * t), np.ones_like(t)], axis=1)
        got = np.linalg.lstsq(x, r, rcond=None)[0]
        return float(((x @ got - r) ** 2).sum()), got

    span = max(t.max() - t.min(), 1e-9)
    grid = np.geomspace(0.01, 300, 200) / span
    at = int(np.argmin([line(b)[0] for b in grid]))
    low, high = np.log(grid[max(at - 1, 0)]), np.log(grid[min(at + 1, len(grid) - 1)])
    part = (np.sqrt(5) - 1) / 2
    for _ in range(80):
        p, q = high - part * (high - low), low + part * (high - low)
        if line(np.exp(p))[0] <= line(np.exp(q))[0]:
            high = q
        else:
            low = p
    b = float(np.exp((low + high) / 2))
    a, c = line(b)[1]
    return float(a), b, float(c)


def crossing(kind: str, t: np.ndarray, r: np.ndarray, p: float) -> tuple[float, list[float]]:
    """(duration at which the fitted curve falls to ``p``, parameters); NaN where it doesn't."""
    if kind == "exponential":
        if len(t) < 3:
            return np.nan, []
        a, b, c = exponential(t, r)
        inside = (p - c) / a if a else -1.0
        return (max(-np.log(inside) / b, 0.0) if inside > 0 else np.nan), [a, b, c]
    if len(t) < 5:
        return np.nan, []
    z = np.polyfit(t, r, 4)
    roots = np.roots(z - np.array([0, 0, 0, 0, p]))
    real = roots[(np.abs(roots.imag) < 1e-9 * np.maximum(1, np.abs(roots))) & (roots.real > 0)].real
    return (float(real.min()) if len(real) else np.nan), [float(x) for x in z]


def fitted_thresholds(curves: DataFrame, p: float, kind: str = "exponential") -> DataFrame:
    """(a, duration, parameters): per amplitude bin, the shortest duration (seconds) at which a fitted curve reaches ``p``.

    ``exponential``: a exp(-b t) + c, not below 0; ``polynomial``: of fourth degree, its first positive root. 0 where the first rate is below
    ``p`` already, null where no rate is, or where the curve never gets there. Missing rates take no part in the fit.
    """
    if kind not in ("exponential", "polynomial"):
        raise ValueError("kind must be exponential or polynomial")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for curve in pdf["curve"]:
                known = [(x["t"], x["rate"]) for x in curve if x["rate"] is not None]
                t, r = (np.array(x, float) for x in (zip(*known) if known else ((), ())))
                if not (r < p).any():
                    out.append((np.nan, []))
                elif r[0] < p:
                    out.append((0.0, []))
                else:
                    out.append(crossing(kind, t, r, p))
            yield pd.DataFrame({"a": pdf["a"], "duration": [x[0] for x in out], "parameters": [x[1] for x in out]})

    found = curves.mapInPandas(fit, f"a {curves.schema['a'].dataType.simpleString()}, duration double, parameters array<double>")
    return found.withColumn("duration", F.nanvl("duration", F.lit(None).cast("double")))
