"""Spatial tuning: binning, curves, smoothing, shuffles, place fields, information and correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log2_term, ratio
from . import blocks
from .intervals import runs


def bin_floor(position: Column, n: int) -> Column:
    """floor(position * n)."""
    return F.floor(position * F.lit(float(n))).cast("int")


def bin_left(position: Column, n: int) -> Column:
    """Bins closed on the right: an exact edge belongs to the bin below, 0 to bin -1."""
    return (F.ceil(position * F.lit(float(n))) - 1).cast("int")


def tuning(df: DataFrame, keys: list[str], n: int, value: str = "value", how: str = "mean") -> DataFrame:
    """Mean (or sum) of ``value`` by keys and position bin."""
    made = F.avg(value) if how == "mean" else F.sum(value)
    return df.groupBy(*keys, bin_floor(F.col("position"), n).alias("bin")).agg(made.alias("value"))


def raster(df: DataFrame, keys: list[str], n: int, fill: float | None = None) -> DataFrame:
    """``tuning`` with a row for every bin of each key; bins without samples are ``fill``."""
    spine = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = spine.join(tuning(df, keys, n), [*keys, "bin"], "left")
    return out if fill is None else out.na.fill(fill, ["value"])


def occupancy(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Samples and their share of all, by keys and bin."""
    counts = df.groupBy(*keys, bin_floor(F.col("position"), n).alias("bin")).agg(F.count(F.lit(1)).alias("samples"))
    return counts.withColumn("share", F.col("samples") / F.sum("samples").over(Window.partitionBy(*keys)) if keys else F.col("samples") / F.sum("samples").over(Window.partitionBy(F.lit(1))))


def gaussian_kernel(length: int, sigma: float) -> list[float]:
    """A normalised symmetric Gaussian of ``length`` points."""
    g = [math.exp(-0.5 * ((k - (length - 1) / 2) / sigma) ** 2) for k in range(length)]
    return [x / sum(g) for x in g]


def smooth_same(curves: DataFrame, keys: list[str], sigma: float, length: int | None = None, order: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Convolution of the values by bin with a Gaussian of 8 sigma points, zeros beyond the ends. Needs all bins.

    With ``order`` = (lap, bin), the laps of a key run on into each other.
    """
    m = length or int(8 * sigma)
    k, w = gaussian_kernel(m, sigma), Window.partitionBy(*keys).orderBy(*order)
    near = lambda o: F.col("value") if o == 0 else F.lead("value", o).over(w) if o > 0 else F.lag("value", -o).over(w)
    total = sum((F.coalesce(near(o), F.lit(0.0)) * F.lit(k[(m - 1) // 2 - o]) for o in range(-(m // 2), (m - 1) // 2 + 1)), F.lit(0.0))
    return curves.withColumn("smoothed", total)


def as_arrays(curves: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One array per key, in order of bin; missing values are 0."""
    got = curves.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", F.coalesce(value, F.lit(0.0)).alias("v")))).alias("_c"))
    return got.select(*keys, F.transform("_c", lambda x: x["v"]).alias("curve"))


def smooth_wrapped(curves: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """Circular Gaussian smoothing with a radius of 4 sigma; one row per bin."""
    r = int(4 * sigma + 0.5)
    g = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    kernel = F.array(*(F.lit(x / sum(g)) for x in g))
    n = F.size("curve")
    at = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), F.lit(0.0), lambda a, j: a + F.get("curve", F.pmod(i + j - r, n)) * F.get(kernel, j))
    return as_arrays(curves, keys).select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), at)).alias("bin", "smoothed"))


#: A prime below 2^31: squares of remainders fit into 64 bits.
_PRIME = 2147483647


def offsets(shuffle: Column, lap: Column, n: Column, seed: int = 17) -> Column:
    """A number below ``n`` drawn for each (seed, shuffle, lap): remainders squared three times, so that laps move apart from each other.

    Plain 64-bit arithmetic, the same in every engine and every run.
    """
    p = F.lit(_PRIME).cast("long")
    x = (F.lit(seed).cast("long") + 7919 * shuffle.cast("long") + 104729 * lap.cast("long")) % p
    for more in (shuffle, lap, F.lit(12345)):
        x = (x * x + more.cast("long")) % p
    return x % n


def shuffled(df: DataFrame, keys: list[str], lap: str, n_bins: int, n_shuffles: int, value: str = "value") -> DataFrame:
    """Rows (shuffle, keys, bin, value): bins rolled inside each lap by a number of its own, the same for all regions.

    Each lap is one pair of arrays, rolled where it is: nothing is shuffled for each of the shuffles.
    """
    laps = df.groupBy(*keys, lap).agg(F.sort_array(F.collect_list(F.struct("frame", bin_floor(F.col("position"), n_bins).alias("bin"), F.col(value).alias("v")))).alias("_s"))
    arrays = laps.select(*keys, lap, F.transform("_s", lambda x: x["bin"]).alias("_bins"), F.transform("_s", lambda x: x["v"]).alias("_values"))
    drawn = arrays.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1)))).withColumn("_off", offsets(F.col("shuffle"), F.col(lap), F.size("_bins").cast("long")).cast("int"))
    rolled = F.concat(F.slice("_bins", F.size("_bins") - F.col("_off") + 1, F.col("_off")), F.slice("_bins", F.lit(1), F.size("_bins") - F.col("_off")))
    pairs = drawn.select("shuffle", *keys, F.explode(F.arrays_zip(rolled.alias("bin"), F.col("_values").alias("value"))).alias("_x"))
    return pairs.select("shuffle", *keys, F.col("_x.bin").alias("bin"), F.col("_x.value").alias("value"))


def null_threshold(df: DataFrame, keys: list[str], lap: str, n_bins: int, n_shuffles: int, p: float, sigma: float | None = None, value: str = "value", seed: int = 17) -> DataFrame:
    """By keys and bin, the (1 - p) quantile of pooled curves of shuffled positions, smoothed as by ``smooth_wrapped`` with ``sigma``.

    The curves of ``shuffled``, made where the laps of a key are: one row of arrays for each key comes in, one threshold for each bin goes out.
    """
    none = -(1 << 31)  # stands for a missing bin, in its place in the order
    sample = F.struct(lap, "frame", F.coalesce(bin_floor(F.col("position"), n_bins), F.lit(none)).alias("b"), F.col(value).cast("double").alias("v"))
    got = df.where(F.col(lap).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(sample)).alias("_s"))
    rows = got.select(*keys, F.transform("_s", lambda x: x[lap].cast("long")).alias("_l"), F.transform("_s", lambda x: x["b"]).alias("_b"), F.transform("_s", lambda x: F.coalesce(x["v"], F.lit(0.0))).alias("_v"), F.transform("_s", lambda x: x["v"].isNotNull()).alias("_k"))
    kernel = None
    if sigma:
        r = int(4 * sigma + 0.5)
        g = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
        kernel = [x / sum(g) for x in g]
    shuffle = np.arange(n_shuffles, dtype=np.int64)

    def thresholds(laps: np.ndarray, bins: np.ndarray, values: np.ndarray, known: np.ndarray) -> tuple[list, np.ndarray]:
        ends = np.r_[0, np.flatnonzero(np.diff(laps)) + 1, len(laps)]
        starts, sizes = ends[:-1], np.diff(ends)
        x = np.fmod(seed + 7919 * shuffle[:, None] + 104729 * laps[starts][None], _PRIME)  # as ``offsets``
        for more in (shuffle[:, None], laps[starts][None], 12345):
            x = np.fmod(x * x + more, _PRIME)
        of = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(laps)) - starts[of]
        rolled = (at[None] - np.fmod(x, sizes[None])[:, of]) % sizes[of] + starts[of]
        names, code = np.unique(bins, return_inverse=True)
        n = len(names)
        cell = (code[rolled] + n * shuffle[:, None]).ravel()
        weights = np.broadcast_to(known.astype(float), rolled.shape).ravel()
        sums = np.bincount(cell, np.broadcast_to(values, rolled.shape).ravel(), n * n_shuffles).reshape(n_shuffles, n)
        counts = np.bincount(cell, weights, n * n_shuffles).reshape(n_shuffles, n)
        there = counts > 0
        curves = sums / np.where(there, counts, 1)
        if kernel is not None:
            curves = sum((np.roll(np.where(there, curves, 0.0), len(kernel) // 2 - j, axis=1) * w for j, w in enumerate(kernel)), np.zeros_like(curves))
            there, names = np.ones_like(there), np.arange(n)
        ordered, m = np.sort(np.where(there, curves, np.inf), axis=0), there.sum(axis=0)
        place = np.maximum(m - 1, 0) * (1 - p)
        low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
        u, v = ordered[low, np.arange(n)], ordered[high, np.arange(n)]
        with np.errstate(invalid="ignore"):
            found = np.where((low == high) | (u == v), u, (high - place) * u + (place - low) * v)
        return [None if b == none else int(b) for b in names], np.where(m > 0, found, np.nan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                bins, found = thresholds(*(np.asarray(pdf[c].iloc[i]) for c in ("_l", "_b", "_v", "_k")))
                yield pd.DataFrame({**{k: [pdf[k].iloc[i]] * len(bins) for k in keys}, "bin": pd.array(bins, dtype="Int32"), "threshold": found})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{kinds}, bin int, threshold double")


def fields(df: DataFrame, curve: DataFrame, keys: list[str], lap: str, n_bins: int, narrowest: int, widest: int, circular: bool = True) -> DataFrame:
    """Runs of bins where ``curve`` has value > threshold, with the number of laps whose mean inside is positive.

    Columns: keys, start_bin, stop_bin (the first bin after it; wrapped round), width, active_laps.
    """
    found = runs(curve, F.col("value") > F.col("threshold"), keys, "bin", circular=n_bins if circular else None)
    width = F.pmod(F.col("offset") - F.col("onset"), F.lit(n_bins))
    found = found.withColumn("width", F.when(width == 0, n_bins).otherwise(width)).where((F.col("width") >= narrowest) & (F.col("width") <= widest))
    bins = found.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("bin", F.pmod(F.col("onset") + F.col("bin"), F.lit(n_bins)).cast("int"))
    by_lap = tuning(df, [*keys, lap], n_bins).join(bins.select(*keys, "run", "bin"), [*keys, "bin"]).groupBy(*keys, "run", lap).agg(F.avg("value").alias("v"))
    active = by_lap.where("v > 0").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("active_laps"))
    return found.join(active, [*keys, "run"]).select(*keys, F.col("onset").alias("start_bin"), F.col("offset").alias("stop_bin"), "width", "active_laps")


def place_fields(df: DataFrame, keys: list[str], lap: str, n_bins: int, n_shuffles: int, p: float, narrowest: int = 1, widest: int | None = None, active_laps: int = 3) -> DataFrame:
    """Runs of bins (wrapping round) whose pooled curve exceeds the null threshold, active in enough laps."""
    curve = tuning(df, keys, n_bins).join(null_threshold(df, keys, lap, n_bins, n_shuffles, p), [*keys, "bin"])
    return fields(df, curve, keys, lap, n_bins, narrowest, widest or n_bins).where(F.col("active_laps") >= active_laps)


def information(curves: DataFrame, keys: list[str], share: str | None = None, value: str = "value") -> DataFrame:
    """Skaggs information (bits), entropy (bits) and tuning score log2(n) - entropy of non-negative curves.

    ``share`` holds the occupancy of each bin; uniform if not given.
    """
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    p = F.col(share) if share else 1 / n
    rows = curves.withColumn("_p", p).withColumn("_n", n)
    rows = rows.withColumn("_rate", F.sum(F.col("_p") * F.col(value)).over(w)).withColumn("_sum", F.sum(value).over(w))
    out = rows.groupBy(*keys).agg(F.sum(F.col("_p") * log2_term(ratio(F.col(value), F.col("_rate")))).alias("skaggs"), (-F.sum(log2_term(ratio(F.col(value), F.col("_sum"))))).alias("entropy"), F.max("_n").alias("_n"))
    return out.select(*keys, "skaggs", "entropy", (F.log2(F.col("_n").cast("double")) - F.col("entropy")).alias("tuning_score"))


def centres(curves: DataFrame, keys: list[str], n: int, value: str = "value", part: float | None = None) -> DataFrame:
    """Centre of mass by bin, and circular centroid (radians, bins on linspace(0, 2 pi, n) with the end).

    With ``part``, values below that share of the curve's greatest count as 0.
    """
    if part is not None:
        top = F.max(value).over(Window.partitionBy(*keys))
        curves = curves.withColumn("_top", top).withColumn(value, F.when(F.col(value) < part * F.col("_top"), F.lit(0.0)).otherwise(F.col(value)))
    theta = F.col("bin") * F.lit(2 * math.pi / (n - 1))
    return curves.groupBy(*keys).agg(
        ratio(F.sum(F.col("bin") * F.col(value)), F.sum(value)).alias("com"), F.atan2(F.sum(F.sin(theta) * F.col(value)), F.sum(F.cos(theta) * F.col(value))).alias("centroid"), F.min_by("bin", F.struct(-F.col(value), "bin")).alias("peak")
    )


def field_width(curves: DataFrame, keys: list[str], part: float = 0.05, value: str = "value") -> DataFrame:
    """Bins around the peak, to the nearest ones below ``part`` of it on either side."""
    w = Window.partitionBy(*keys)
    rows = curves.withColumn("_top", F.max(value).over(w))
    rows = rows.withColumn("_peak", F.min(F.when(F.col(value) == F.col("_top"), F.col("bin"))).over(w))
    low = F.col(value) < F.lit(part) * F.col("_top")
    out = rows.groupBy(*keys).agg(F.max(F.when(low & (F.col("bin") < F.col("_peak")), F.col("bin"))).alias("l"), F.min(F.when(low & (F.col("bin") > F.col("_peak")), F.col("bin"))).alias("r"), F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    return out.select(*keys, (F.coalesce("r", F.col("hi") + 1) - F.coalesce("l", F.col("lo") - 1) - 1).alias("width"))


def kuiper(events: DataFrame, occupied: DataFrame, keys: list[str]) -> DataFrame:
    """Kuiper's statistic D+ + D- of event bins against occupancy, over columns (bin, n) of each."""
    both = events.select(*keys, "bin", F.col("n").alias("a"), F.lit(0).alias("b")).unionByName(occupied.select(*keys, "bin", F.lit(0).alias("a"), F.col("n").alias("b")))
    both = both.groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    up, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    d = ratio(F.sum("a").over(up), F.sum("a").over(whole)) - ratio(F.sum("b").over(up), F.sum("b").over(whole))
    return both.withColumn("d", d).groupBy(*keys).agg((F.greatest(F.max("d"), F.lit(0.0)) - F.least(F.min("d"), F.lit(0.0))).alias("kuiper"))


def information_terms(curves: DataFrame, keys: list[str], share: str, value: str = "value") -> DataFrame:
    """Skaggs information bin by bin (``term``, bits): share x rate ratio x its logarithm; their sum is the information."""
    rate = F.sum(F.col(share) * F.col(value)).over(Window.partitionBy(*keys))
    return curves.withColumn("term", F.col(share) * log2_term(ratio(F.col(value), rate)))


def kuiper_p(statistic: Column, n1: Column, n2: Column, terms: int = 60) -> Column:
    """Probability of a Kuiper statistic as great by chance, by its asymptotic series, for two samples."""
    n = n1.cast("double") * n2 / (n1 + n2)
    lam = (F.sqrt(n) + 0.155 + 0.24 / F.sqrt(n)) * statistic
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, j: a + (4.0 * j * j * lam * lam - 1) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.4, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided probability of a Pearson correlation of ``n`` pairs under no correlation, by the finite series of Student's t.

    Null for fewer than three pairs; the series has n / 2 terms.
    """
    df = (n - 2).cast("int")
    even = F.pmod(df, F.lit(2)) == 0
    cos2 = F.greatest(1 - r * r, F.lit(0.0))  # cos of the angle, squared; its sine is |r|
    cos, sin = F.sqrt(cos2), F.abs(r)
    count = F.floor((df - F.when(even, 2).otherwise(3)) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, k: Column) -> Column:
        odd = F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
        term = a["term"] * odd * cos2
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    inside = F.when(even, sin * total).when(df == 1, 2 / F.lit(math.pi) * F.asin(sin)).otherwise(2 / F.lit(math.pi) * (F.asin(sin) + sin * cos * total))
    return F.when(df >= 1, F.greatest(1 - inside, F.lit(0.0)))


def correlations_with(curves: DataFrame, chosen: DataFrame, key: str, along: str, by: list[str], value: str = "value") -> DataFrame:
    """Pearson r of each of the ``chosen`` keys with every other key, over ``along``: by, a (chosen), b, r, n."""
    rows = curves.dropna(subset=[*by, key, along]).groupBy(*by, F.col(key).alias("id")).agg(F.collect_list(F.struct(F.col(along).alias("i"), F.col(value).cast("double").alias("v"))).alias("x"))
    return blocks.correlations(rows.join(chosen.select(F.col(key).alias("id")).distinct(), "id", "left_semi"), rows, by)


def normalised_by_peak(curves: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Curves divided by their greatest value; ``selection.ranked_by_peak`` puts them in order of its bin."""
    w = Window.partitionBy(*keys)
    return curves.withColumn(value, ratio(F.col(value), F.max(value).over(w)))


def autocorrelation(curves: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """Cyclic autocorrelation of each curve about its mean, at lags -lags to lags."""
    n = F.size("curve")
    arrays = as_arrays(curves, keys)
    arrays = arrays.withColumn("_m", F.aggregate("curve", F.lit(0.0), lambda a, x: a + x) / n)
    arrays = arrays.withColumn("curve", F.transform("curve", lambda x: x - F.col("_m"))).withColumn("_v", F.aggregate("curve", F.lit(0.0), lambda a, x: a + x * x))
    at = lambda lag: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.get("curve", i) * F.get("curve", F.pmod(i + lag, n)))
    rows = arrays.select(*keys, "_v", F.explode(F.transform(F.sequence(F.lit(-lags), F.lit(lags)), lambda lag: F.struct(lag.alias("lag"), at(lag).alias("c")))).alias("x"))
    return rows.select(*keys, F.col("x.lag").alias("lag"), ratio(F.col("x.c"), F.col("_v")).alias("acf"))


def autocorrelation_width(acf: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Twice the first lag from 0 on at which the autocorrelation is below ``cutoff``; 0 if there is none."""
    return acf.groupBy(*keys).agg((2 * F.coalesce(F.min(F.when((F.col("lag") >= 0) & (F.col("acf") < cutoff), F.col("lag"))), F.lit(0))).alias("width"))


def curve_correlations(curves: DataFrame, key: str, along: str, by: list[str], value: str = "value") -> DataFrame:
    """Pearson r of all pairs of ``key`` over ``along``, inside ``by``; a < b."""
    a = curves.select(*by, along, F.col(key).alias("a"), F.col(value).alias("x"))
    b = curves.select(*by, along, F.col(key).alias("b"), F.col(value).alias("y"))
    return a.join(b, [*by, along]).where("a < b").groupBy(*by, "a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def population_correlations(first: DataFrame, second: DataFrame, along: str, by: list[str], value: str = "value") -> DataFrame:
    """Pearson r and p of the population at each bin of one set of curves with that at each bin of another: by, a, b, r, n, p.

    The sets are curves under two time filters, or the same twice. Regions (``along``) that miss a value in either bin are left out
    of that pair; r is null where fewer than two are left or a population is constant, p where fewer than three are.
    """
    known = lambda df: df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    a = known(first).select(*by, along, F.col("bin").alias("a"), F.col(value).alias("x"))
    b = known(second).select(*by, along, F.col("bin").alias("b"), F.col(value).alias("y"))
    # bins are few: a pair of them is one row of sums, added up before the shuffle
    found = a.join(b, [*by, along]).groupBy(*by, "a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    r = F.nanvl("r", F.lit(None).cast("double"))
    return found.withColumn("r", r).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def cross_correlation(curves: DataFrame, lap: str, keys: list[str], n: int, first: int, last: int, crop: bool = False) -> DataFrame:
    """Population cross-correlation of all lap pairs (a < b) at shifts ``first`` to ``last``, wrapped round ``n`` bins; ``crop`` leaves the wrapped part out."""
    a = curves.select(*keys, "bin", F.col(lap).alias("a"), F.col("value").alias("x"))
    b = curves.select(*keys, F.col(lap).alias("b"), F.col("value").alias("y"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lag"), F.col("bin").alias("_b")).withColumn("bin", F.pmod(F.col("_b") - F.col("lag"), F.lit(n)).cast("int"))
    if crop:
        b = b.where((F.col("_b") - F.col("lag") >= 0) & (F.col("_b") - F.col("lag") < n))
    return a.join(b, [*keys, "bin"]).where("a < b").groupBy("a", "b", "lag").agg(F.corr("x", "y").alias("r"))


def drift(xcorr: DataFrame, least_r: float) -> DataFrame:
    """For each lap pair the lag of greatest correlation, where that is at least ``least_r``."""
    best = xcorr.groupBy("a", "b").agg(F.max("r").alias("r"), F.min_by("lag", F.struct(-F.col("r"), F.abs("lag"), "lag")).alias("lag"))
    return best.where(F.col("r") >= least_r)


def template_correlation(curves: DataFrame, lap: str, keys: list[str], last: int) -> DataFrame:
    """r of each lap's population with the mean of the last ``last`` laps, itself left out of it."""
    laps = curves.select(lap).distinct().withColumn("_o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(lap)))).withColumn("_t", F.col("_o") <= last)
    rows = curves.join(F.broadcast(laps), lap)
    w = Window.partitionBy(*keys, "bin")
    s, n = F.sum(F.when(F.col("_t"), F.col("value"))).over(w), F.count(F.when(F.col("_t"), F.col("value"))).over(w)
    own = F.when(F.col("_t"), 1).otherwise(0)
    rows = rows.withColumn("_m", ratio(F.coalesce(s, F.lit(0.0)) - own * F.col("value"), (n - own).cast("double")))
    return rows.groupBy(lap).agg(F.corr("value", "_m").alias("r"))
