"""Signal processing: relative fluorescence, spikes, transients, velocity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .intervals import hysteresis
from .rolling import LAGGED, by_traces, chained, gaussian_rolling, rolling, slider, smoother


def quantile_dfof(df: DataFrame, keys: list[str], q: float = 0.08, window: int = 300, sigma: float = 5, least: float = 0.2) -> DataFrame:
    """(F - B) / B over a rolling quantile of the smoothed trace."""
    if window > LAGGED:
        out = by_traces(df, keys, "frame", {"baseline": ("value", chained(smoother(window, sigma), slider("quantile", window, int(least * window), q)))})
    else:
        out = gaussian_rolling(df, "value", window, sigma, "_s", keys)
        out = rolling(out, "quantile", "_s", window, "baseline", keys, int(least * window), q).drop("_s")
    return out.withColumn("dfof", ratio(F.col("value") - F.col("baseline"), F.col("baseline")))


def jia_dfof(df: DataFrame, keys: list[str], t1: int = 90, t2: int = 1800, slow: int | None = None, least: float = 0.2) -> DataFrame:
    """Baseline: rolling minimum of a rolling mean; with ``slow``, the rolling median of the result is taken off."""
    if min(t1, t2) > LAGGED:
        out = by_traces(df, keys, "frame", {"baseline": ("value", chained(slider("mean", t1, int(least * t1)), slider("min", t2, int(least * t2))))})
    else:
        out = rolling(df, "mean", "value", t1, "_m", keys, int(least * t1))
        out = rolling(out, "min", "_m", t2, "baseline", keys, int(least * t2)).drop("_m")
    out = out.withColumn("dfof", ratio(F.col("value") - F.col("baseline"), F.col("baseline")))
    if slow:
        out = rolling(out, "median", "dfof", slow, "_t", keys).withColumn("dfof", F.col("dfof") - F.col("_t")).drop("_t")
    return out


def maxmin_dfof(df: DataFrame, keys: list[str], window: int = 1800, sigma: float = 90, value: str = "value", name: str = "dfof") -> DataFrame:
    """Baseline: rolling maximum of the rolling minimum of the smoothed trace."""
    out = maxmin_baseline(df, keys, window, sigma, value, "baseline")
    return out.withColumn(name, ratio(F.col(value) - F.col("baseline"), F.col("baseline")))


def maxmin_baseline(df: DataFrame, keys: list[str], window: int, sigma: float, value: str, name: str) -> DataFrame:
    return maxmin_baselines(df, keys, window, sigma, {name: value})


def maxmin_baselines(df: DataFrame, keys: list[str], window: int, sigma: float, values: dict[str, str]) -> DataFrame:
    """Add the rolling maximum of the rolling minimum of smoothed traces, of several columns by name; wide windows in one pass over each trace."""
    if window > LAGGED:
        steps = chained(smoother(window, sigma), slider("min", window), slider("max", window))
        return by_traces(df, keys, "frame", {name: (value, steps) for name, value in values.items()})
    out = df
    for name, value in values.items():
        out = gaussian_rolling(out, value, window, sigma, "_s", keys)
        out = rolling(out, "min", "_s", window, "_n", keys)
        out = rolling(out, "max", "_n", window, name, keys).drop("_s", "_n")
    return out


def neuropil_dfof(df: DataFrame, keys: list[str], window: int = 600, sigma: float = 10) -> DataFrame:
    """((F - N) - B(F - N)) / (B(F - N) + B(N)) of columns ``raw`` and ``npil``; B as in ``maxmin_baseline``."""
    out = df.withColumn("_d", F.col("raw") - F.col("npil"))
    out = maxmin_baselines(out, keys, window, sigma, {"_bd": "_d", "_bn": "npil"})
    return out.withColumn("dfof", ratio(F.col("_d") - F.col("_bd"), F.col("_bd") + F.col("_bn"))).drop("_d", "_bd", "_bn")


def mad_filter(df: DataFrame, column: str, name: str, keys: list[str], n_mad: float = 3.0) -> DataFrame:
    """Values up to ``n_mad`` median absolute deviations become 0."""
    middle = df.groupBy(*keys).agg(F.percentile(column, F.lit(0.5)).alias("_m"))
    apart = df.join(middle, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(column) - F.col("_m")), F.lit(0.5)).alias("_mad"))
    return df.join(apart, keys).withColumn(name, F.when(F.col(column) > n_mad * F.col("_mad"), F.col(column)).otherwise(0.0)).drop("_mad")


def transients(df: DataFrame, column: str, keys: list[str], fs: float, on: float = 2.0, off: float = 0.5, shortest: float = 0.1) -> DataFrame:
    """Hysteresis events of a trace in units of its own deviation, longer than ``shortest`` seconds."""
    sigma = F.stddev_pop(column).over(Window.partitionBy(*keys))
    scaled = df.withColumn("sigma", sigma).withColumn("_z", F.col(column) / F.nullif(F.col("sigma"), F.lit(0.0)))
    found = hysteresis(scaled, "_z", on, off, keys)
    return found.withColumn("duration", (F.col("offset") - F.col("onset")) / F.lit(fs)).where(F.col("duration") > shortest)


def event_histogram(events: DataFrame, sigma_bins: int = 7, time_bins: int = 20) -> DataFrame:
    """How many events reach each bin of amplitude (2 a unit, from 2) and of duration (4 a second): suffix counts."""
    a = F.least(F.floor(2 * F.col("amplitude")) - 4, F.lit(sigma_bins - 1)).cast("int")
    d = F.least(F.floor(4 * F.col("duration")), F.lit(time_bins - 1)).cast("int")
    cells = events.select(a.alias("a"), d.alias("d")).where("a >= 0 and d >= 0").groupBy("a", "d").agg(F.count(F.lit(1)).alias("n"))
    grid = events.sparkSession.range(sigma_bins).select(F.col("id").cast("int").alias("a")).join(events.sparkSession.range(time_bins).select(F.col("id").cast("int").alias("d")))
    full = grid.join(F.broadcast(cells), ["a", "d"], "left").na.fill(0, ["n"])
    by_d = full.withColumn("n", F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("d"))))
    return by_d.withColumn("n", F.sum("n").over(Window.partitionBy("d").orderBy(F.desc("a"))).cast("long"))


def oasis_ar1(df: DataFrame, keys: list[str], g: float, name: str = "spikes", order: str = "frame", value: str = "value") -> DataFrame:
    """Non-negative deconvolution by a first-order decay ``g``: pools of adjacent frames are merged until no spike is negative.

    After the published active-set method (Friedrich, Zhou and Paninski 2017); sequential, hence one trace at a time.
    """

    return by_traces(df, keys, order, {name: (value, _pools(g))})


def _pools(g: float):
    """Spikes of one trace, for ``oasis_ar1``."""

    def solve(x: np.ndarray) -> np.ndarray:
        y = np.nan_to_num(x)
        powers = (g ** np.arange(len(y) + 1)).tolist()
        pools: list[list] = []  # value, weight, start, length
        for t, v in enumerate(y.tolist()):
            pools.append([v, 1.0, t, 1])
            while len(pools) > 1 and pools[-1][0] < pools[-2][0] * powers[pools[-2][3]]:
                v2, w2, _, l2 = pools.pop()
                v1, w1, s1, l1 = pools[-1]
                decay = powers[l1]
                pools[-1] = [(w1 * v1 + decay * w2 * v2) / (w1 + decay**2 * w2), w1 + decay**2 * w2, s1, l1 + l2]
        calcium = np.concatenate([max(v, 0.0) * np.array(powers[:n]) for v, _, _, n in pools])
        spikes = np.zeros(len(y))
        spikes[1:] = calcium[1:] - g * calcium[:-1]
        return np.where(spikes > 1e-12, spikes, 0.0)

    return solve


def _over_deviations(n_mad: float):
    """Values of one trace over ``n_mad`` median deviations, others as 0: ``mad_filter`` where the trace is."""

    def keep(x: np.ndarray) -> np.ndarray:
        return np.where(x > n_mad * np.median(np.abs(x - np.median(x))), x, 0.0)

    return keep


def velocity(df: DataFrame, keys: list[str], order: str = "frame", position: str = "position", jump: float = 0.2) -> DataFrame:
    """Frame-to-frame change of position; a change over ``jump`` (a new lap) repeats the one before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = df.withColumn("_d", F.col(position) - F.lag(position).over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("velocity", F.coalesce(F.last(F.when(F.abs("_d") <= jump, F.col("_d")), True).over(upto), F.lit(0.0))).drop("_d")


def smoothed_velocity(df: DataFrame, keys: list[str], interval: float, sigma: float = 0.1, track: float | None = None, order: str = "frame", whole: bool = False) -> DataFrame:
    """``velocity`` per second, smoothed with a Gaussian of 8 sigma frames, zeros beyond the ends.

    ``interval`` is a frame in seconds and ``sigma`` seconds; sigma becomes frames by rounding, or upwards with ``whole``. With ``track`` (mm), changes
    of position become cm per second; without it velocities are taken as they are.
    """
    from .spatial import smooth_same

    frames = max(1, math.ceil(sigma / interval - 1e-9) if whole else round(sigma / interval))
    speed = F.col("velocity") if track is None else F.col("velocity") * (track / 10 / interval)
    # the smoothing reads a column of its own name
    rows = df.withColumnsRenamed({"value": "_value"}).withColumn("value", F.coalesce(speed, F.lit(0.0)))
    return smooth_same(rows, keys, float(frames), order=(order,)).drop("value", "velocity").withColumnsRenamed({"smoothed": "velocity", "_value": "value"})


def ar_coefficients(df: DataFrame, keys: list[str], value: str = "value", order: str = "frame") -> DataFrame:
    """Yule-Walker coefficients of orders 1 and 2 in closed form, from autocovariances at lags 0 to 2."""
    w = Window.partitionBy(*keys).orderBy(order)
    centred_ = df.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    lagged = centred_.select(*keys, "_x", F.lag("_x", 1).over(w).alias("_1"), F.lag("_x", 2).over(w).alias("_2"))
    cov = lagged.groupBy(*keys).agg(F.avg(F.col("_x") * F.col("_x")).alias("c0"), (F.sum(F.col("_x") * F.col("_1")) / F.count("_x")).alias("c1"), (F.sum(F.col("_x") * F.col("_2")) / F.count("_x")).alias("c2"))
    r1, r2 = ratio(F.col("c1"), F.col("c0")), ratio(F.col("c2"), F.col("c0"))
    return cov.select(*keys, r1.alias("ar1"), ratio(r1 * (1 - r2), 1 - r1 * r1).alias("ar2_1"), ratio(r2 - r1 * r1, 1 - r1 * r1).alias("ar2_2"))


def duration_thresholds(positive: DataFrame, negative: DataFrame, p: float, per_second: float = 4.0) -> DataFrame:
    """Per amplitude bin ``a``, the shortest duration (seconds) at which false positives fall below ``p``.

    The rate of false positives is negative-going over positive-going events (``event_histogram`` of each), made
    monotone by its running minimum and interpolated between bins; null where it never falls so low.
    """
    both = positive.select("a", "d", F.col("n").alias("up")).join(negative.select("a", "d", F.col("n").alias("down")), ["a", "d"])
    w = Window.partitionBy("a").orderBy("d")
    rate = both.withColumn("_r", F.least(F.coalesce(ratio(F.col("down"), F.col("up")), F.lit(1.0)), F.lit(1.0)))
    rate = rate.withColumn("_r", F.min("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.lag("_r").over(w))
    low = F.col("_r") < p
    at = F.when(low & F.col("_b").isNull(), F.col("d").cast("double")).when(low, F.col("d") - 1 + (F.col("_b") - p) / F.nullif(F.col("_b") - F.col("_r"), F.lit(0.0)))
    return rate.groupBy("a").agg((F.min(at) / F.lit(per_second)).alias("duration"))


def downsampled(df: DataFrame, keys: list[str], factor: int, value: str = "value", order: str = "frame") -> DataFrame:
    """Traces at 1 / ``factor`` of their rate by leaving out high frequencies, cut to a multiple of ``factor`` first."""

    def resample(pdf):
        import pandas as pd

        x = pdf.sort_values(order)[value].to_numpy(float)
        n = len(x) // factor * factor
        m = n // factor
        f = np.fft.rfft(x[:n])[: m // 2 + 1]
        y = np.fft.irfft(f, m) / factor if m else np.zeros(0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * m for k in keys}, order: np.arange(m), value: y})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return df.groupBy(*keys).applyInPandas(resample, f"{kinds}, `{value}` double")


def resampled(df: DataFrame, keys: list[str], num: int, fs: float, max_truncation: float | None = None, truncate_output: bool = False, value: str = "value", order: str = "frame") -> DataFrame:
    """Traces of ``num`` samples by the Fourier method, fewer than they had; keys, order (from 0), value.

    With ``max_truncation`` (seconds), a trace is first cut to a multiple of the greatest power of two of samples that span at most that
    long, which transforms fast; ``truncate_output`` cuts the result by the same rule at its own rate. A trace shorter than ``num`` is an error.
    """

    def cut(length: int, rate: float) -> int:
        power = 1 << int(np.log2(rate * max_truncation))
        if power < 2:
            raise ValueError("the truncation must span two samples at least")
        return length // power * power

    def resample(pdf):
        import pandas as pd

        x = pdf.sort_values(order)[value].to_numpy(float)
        length, m = len(x), num
        if num > length:
            raise ValueError("only fewer samples are supported")
        if max_truncation is not None:
            x = x[: cut(length, fs)]
            m = cut(num, fs * num / length) if truncate_output else num
        f = np.fft.rfft(x)[: m // 2 + 1].copy()
        if m % 2 == 0 and m < len(x):
            f[m // 2] = 2 * f[m // 2].real  # both halves of the highest frequency fall together
        y = np.fft.irfft(f, m) * m / len(x) if m else np.zeros(0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * m for k in keys}, order: np.arange(m), value: y})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return df.groupBy(*keys).applyInPandas(resample, f"{kinds}, `{value}` double")


def oasis_ar2(df: DataFrame, keys: list[str], decay: float, rise: float, name: str = "spikes", order: str = "frame", value: str = "value", rounds: int = 400) -> DataFrame:
    """Non-negative deconvolution by a kernel of two time constants (``decay`` > ``rise``, as factors a frame).

    Projected gradient with momentum on the least-squares problem, one trace at a time; each step filters the
    trace forwards and backwards.
    """

    def solve(pdf):
        pdf = pdf.sort_values(order)
        y = np.nan_to_num(pdf[value].to_numpy(float))
        n = len(y)
        kernel = (decay ** np.arange(1, n + 1) - rise ** np.arange(1, n + 1)) / (decay - rise)
        kernel = kernel[: max(1, int(np.searchsorted(-kernel[int(kernel.argmax()) :], -1e-6)) + int(kernel.argmax()))]
        size = 1 << (n + len(kernel) - 1).bit_length()
        k = np.fft.rfft(kernel, size)
        step = 1 / max(np.abs(k).max() ** 2, 1e-12)
        s = z = np.zeros(n)
        t = 1.0
        for _ in range(rounds):
            r = np.fft.irfft(np.fft.rfft(z, size) * k, size)[:n] - y
            grad = np.fft.irfft(np.fft.rfft(r, size) * np.conj(k), size)[:n]
            new = np.maximum(z - step * grad, 0.0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, s, t = new + (t - 1) / t2 * (new - s), new, t2
        pdf[name] = s
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name) + f", `{name}` double"
    return df.groupBy(*keys).applyInPandas(solve, schema)


def noise(df: DataFrame, column: str, keys: list[str], exclude: DataFrame | None = None, order: str = "frame") -> DataFrame:
    """Standard deviation of each trace (``sigma``), without the frames of the events in ``exclude`` if given."""
    from .intervals import frames_in

    rows = df if exclude is None else frames_in(df, exclude, keys, order, inside=False)
    return rows.groupBy(*keys).agg(F.stddev_pop(column).alias("sigma"))


def both_polarities(df: DataFrame, column: str, keys: list[str], fs: float, sigma: DataFrame | None = None) -> DataFrame:
    """Hysteresis events of traces in units of their noise, upwards and downwards: keys, polarity, onset, offset, amplitude, peak, duration.

    Sessions are keys like regions: the events of all of them come from one plan.
    """
    scaled = df.join(noise(df, column, keys) if sigma is None else sigma, keys)
    z = F.col(column) / F.nullif(F.col("sigma"), F.lit(0.0))
    turned = scaled.withColumn("polarity", F.explode(F.array(F.lit("positive"), F.lit("negative")))).withColumn("_z", F.when(F.col("polarity") == "positive", z).otherwise(-z))
    found = hysteresis(turned, "_z", 2.0, 0.5, [*keys, "polarity"])
    return found.withColumn("duration", (F.col("offset") - F.col("onset")) / F.lit(fs))


def pooled_histograms(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``event_histogram`` of upward and of downward events of all sessions together."""
    return event_histogram(events.where("polarity = 'positive'")), event_histogram(events.where("polarity = 'negative'"))


def identified(events: DataFrame, thresholds: DataFrame, shortest: float = 0.1, sigma_bins: int = 7) -> DataFrame:
    """Events longer than ``shortest`` and than the threshold of their amplitude's bin (``duration_thresholds``); none where that is missing."""
    a = F.least(F.floor(2 * F.col("amplitude")) - 4, F.lit(sigma_bins - 1)).cast("int")
    # one row for each amplitude bin
    met = events.withColumn("a", a).join(F.broadcast(thresholds.select("a", F.col("duration").alias("_least"))), "a")
    return met.where((F.col("duration") > F.col("_least")) & (F.col("duration") > shortest)).drop("a", "_least")


def custom_dfof(df: DataFrame, baseline, smooth=None, value: str = "value") -> DataFrame:
    """(F - B) / B with a baseline of the user's: ``baseline`` maps a DataFrame to one with a column ``baseline``, ``smooth`` one
    with a smoothed ``value`` that the baseline is taken of.
    """
    base = baseline(smooth(df) if smooth else df)
    keys = [c for c in df.columns if c != value]
    out = df.join(base.select(*keys, "baseline"), keys) if smooth else base
    return out.withColumn("dfof", ratio(F.col(value) - F.col("baseline"), F.col("baseline")))


def neuropil_dfof_constant(df: DataFrame, keys: list[str], window: int = 600, sigma: float = 10) -> DataFrame:
    """``neuropil_dfof`` over one denominator for each trace: the median of its baselines."""
    out = df.withColumn("_d", F.col("raw") - F.col("npil"))
    out = maxmin_baselines(out, keys, window, sigma, {"_bd": "_d", "_bn": "npil"})
    middle = out.groupBy(*keys).agg(F.percentile(F.col("_bd") + F.col("_bn"), F.lit(0.5)).alias("_m"))
    return out.join(middle, keys).withColumn("dfof", ratio(F.col("_d") - F.col("_bd"), F.col("_m"))).drop("_d", "_bd", "_bn", "_m")


def spikes_ar1(df: DataFrame, keys: list[str], tau: float = 0.7, fs: float = 10.0, n_mad: float | None = 3.0, value: str = "value", binary: bool = False) -> DataFrame:
    """Deconvolved spikes of a decay of ``tau`` seconds at ``fs`` frames a second, without those under ``n_mad`` median deviations."""
    steps = [_pools(float(np.exp(-1 / (tau * fs))))] + ([] if n_mad is None else [_over_deviations(n_mad)])
    found = by_traces(df, keys, "frame", {"spikes": (value, chained(*steps))})
    return found.withColumn("spikes", (F.col("spikes") > 0).cast("double")) if binary else found


def reconvolved(df: DataFrame, keys: list[str], decay: float = 0.4, rise: float = 0.06, dt: float = 1e-3, spikes: str = "spikes", name: str = "calcium", order: str = "frame") -> DataFrame:
    """Standardised calcium traces of spikes: the second-order recursion c[i] = s[i] + g1 c[i - 1] + g2 c[i - 2], from the third frame on.

    One trace is one array, folded where it is.
    """
    a, b = float(np.exp(-dt / decay)), float(np.exp(-dt / rise))
    got = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(spikes).cast("double"), F.lit(0.0)).alias("v")))).alias("_s"))

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for trace in pdf["_v"]:
                c = np.array(trace, float)
                for i in range(2, len(c)):
                    c[i] += (a + b) * c[i - 1] - a * b * c[i - 2]
                sd = c.std() if len(c) else 0.0
                out.append(((c - c.mean()) / sd).tolist() if sd > 0 else [None] * len(c))
            pdf[name] = pd.Series(out, dtype=object)
            yield pdf[[*keys, "_o", name]]

    arrays = got.select(*keys, F.transform("_s", lambda x: x[order]).alias("_o"), F.transform("_s", lambda x: x["v"]).alias("_v"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    made = arrays.mapInPandas(solve, f"{kinds}, _o array<{df.schema[order].dataType.simpleString()}>, `{name}` array<double>")
    return made.select(*keys, F.explode(F.arrays_zip(F.col("_o").alias(order), F.col(name))).alias("_x")).select(*keys, F.col(f"_x.{order}").alias(order), F.col(f"_x.{name}").alias(name))


def each_safely(df: DataFrame, keys: list[str], compute, schema: str, errors: str = "raise") -> DataFrame:
    """``compute`` (pandas frame to pandas frame of ``schema``) on each group; a group that fails is left out (``ignore``),
    gives a row with its keys and the message in ``error`` (``warn``), or ends the job (``raise``).
    """
    if errors not in ("raise", "warn", "ignore"):
        raise ValueError(errors)

    def safe(pdf):
        import pandas as pd

        try:
            out = compute(pdf)
            return out.assign(error=pd.Series([""] * len(out), index=out.index, dtype=object))
        except Exception as e:
            if errors == "raise":
                raise
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "error": [f"{type(e).__name__}: {e}"]}) if errors == "warn" else pd.DataFrame()

    from pyspark.sql.types import StringType, StructType

    kind = StructType.fromDDL(schema).add("error", StringType())
    names = [f.name for f in kind.fields]
    found = df.groupBy(*keys).applyInPandas(lambda pdf: safe(pdf).reindex(columns=names).astype({"error": object}), kind)
    return found.withColumn("error", F.nullif(F.col("error"), F.lit("")))
