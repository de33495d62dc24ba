"""Simulated place cells: rasters, plasticity kernel and spikes, as column expressions with a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def plasticity_kernel(t: Column, before: float = 1.31, after: float = 0.69) -> Column:
    """Weight of a synapse active ``t`` seconds after (negative: before) a plateau."""
    return F.when(t < 0, F.exp(t / F.lit(before))).otherwise(F.exp(-t / F.lit(after)))


def rates(cells: DataFrame, n_bins: int, width: float = 5.0, peak: float = 10.0) -> DataFrame:
    """Gaussian rate by bin round a circular track for cells (roi, centre)."""
    rows = cells.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    away = F.abs(F.col("bin") - F.col("centre"))
    away = F.least(away, n_bins - away)
    return rows.withColumn("rate", F.lit(peak) * F.exp(-away * away / F.lit(2 * width * width)))


def spikes(rates_: DataFrame, n_laps: int, dt: float, seed: int = 11) -> DataFrame:
    """Spikes (0 or 1) by lap and bin, with probability rate x dt; drawn from a hash, so that each run agrees."""
    rows = rates_.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(n_laps - 1))))
    return rows.withColumn("spike", _spike(F.col("lap"), dt, seed))


def _spike(lap: Column, dt: float, seed: int) -> Column:
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("roi"), lap, F.col("bin")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (draw < 1 - F.exp(-F.col("rate") * F.lit(dt))).cast("int")


def spike_counts(rates_: DataFrame, n_laps: int, dt: float, seed: int = 11) -> DataFrame:
    """(roi, bin, spikes): ``spikes`` added up over the laps where each rate is, one row for each row of ``rates_``."""
    each = lambda lap: _spike(lap, dt, seed).cast("long")
    if n_laps <= 64:  # written out, so that it is compiled
        total = sum((each(F.lit(k)) for k in range(1, n_laps)), each(F.lit(0)))
    else:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(n_laps - 1)), F.lit(0).cast("long"), lambda n, lap: n + each(lap))
    return rates_.select("roi", "bin", total.alias("spikes"))


def drifting_fields(spark: SparkSession, cells: int, n_laps: int, n_bins: int, step: float = 0.0, first_lap: int = 0) -> DataFrame:
    """Rasters (roi, lap, bin, value): fields that appear at ``first_lap`` and move ``step`` bins a lap."""
    grid = spark.range(cells).select(F.col("id").alias("roi"), F.explode(F.sequence(F.lit(0), F.lit(n_laps - 1))).alias("lap")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    centre = F.pmod(F.col("roi") * F.lit(n_bins * (math.sqrt(5) - 1) / 2) + F.col("lap") * F.lit(step), F.lit(float(n_bins)))
    away = F.abs(F.col("bin") - centre)
    away = F.least(away, n_bins - away)
    return grid.withColumn("value", F.when(F.col("lap") >= first_lap, F.exp(-away * away / 18.0)).otherwise(0.0))


def walk(spark: SparkSession, n: int, velocity: float, track: float, dt: float, pause: float | None = None, start: float = 0.0) -> DataFrame:
    """An animal at constant velocity: frame, t, position, trial. Round the track without ``pause``.

    With it, each run to the track's end is followed by ``pause`` seconds without a position; the next trial starts at 0.
    """
    rows = spark.range(n).select(F.col("id").cast("int").alias("frame"), (F.col("id") * F.lit(dt)).alias("t"))
    step = velocity * dt
    if pause is None:
        place = F.col("frame") * F.lit(step) + F.lit(start)
        return rows.select("frame", "t", F.pmod(place, F.lit(float(track))).alias("position"), F.floor(place / F.lit(float(track))).cast("int").alias("trial"))
    first, moving, still = math.floor((track - start) / step + 1e-9) + 1, math.floor(track / step + 1e-9) + 1, math.ceil(pause / dt - 1e-9)
    # frames before the first pause, then rounds of a pause and a run
    later = F.col("frame") - first
    inside, turn = F.pmod(later, F.lit(still + moving)), F.floor(later / F.lit(still + moving))
    position = F.when(later < 0, F.lit(start) + F.col("frame") * F.lit(step)).when(inside >= still, (inside - still) * F.lit(step))
    trial = F.when(later < 0, 0).otherwise(turn + (inside >= still).cast("int"))
    return rows.select("frame", "t", position.alias("position"), trial.cast("int").alias("trial"))


def input_rates(walked: DataFrame, inputs: DataFrame, width: float, peak: float, track: float) -> DataFrame:
    """Firing rates of an ensemble of inputs (input, centre) along a walk: frame, input, rate; Gaussian round the track, 0 in pauses."""
    rows = walked.join(F.broadcast(inputs)) if inputs.count() <= 10_000 else walked.crossJoin(inputs)
    away = F.abs(F.col("position") - F.col("centre"))
    away = F.least(away, F.lit(float(track)) - away)
    return rows.select("frame", "input", F.coalesce(F.lit(float(peak)) * F.exp(-away * away / F.lit(2.0 * width * width)), F.lit(0.0)).alias("rate"))


def weights_after(inputs: DataFrame, plateau: float, velocity: float, prior: float = -10.0) -> DataFrame:
    """Weights of the inputs after a plateau at a position: the kernel of the time from the plateau to each centre, standardised."""
    raw = F.lit(float(prior)) + plasticity_kernel((F.col("centre") - F.lit(plateau)) / F.lit(float(velocity)))
    rows = inputs.withColumn("w", raw)
    stats = rows.agg(F.avg("w").alias("_m"), F.stddev_pop("w").alias("_s"))
    return rows.join(F.broadcast(stats)).select("input", "centre", ((F.col("w") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).alias("w"))


def output_rate(rates_: DataFrame, weights: DataFrame, highest: float = 30.0) -> DataFrame:
    """Rate of the neuron that the inputs drive: exponential of the weighted sum, scaled so that the greatest current gives ``highest``."""
    current = rates_.join(weights.select("input", "w"), "input").groupBy("frame").agg(F.sum(F.col("w") * F.col("rate")).alias("current"))
    top = current.agg(F.max("current").alias("_m"))
    return current.join(F.broadcast(top)).select("frame", "current", F.exp(F.col("current") * F.lit(math.log(highest)) / F.nullif(F.col("_m"), F.lit(0.0))).alias("rate"))


def subsampled(calcium: DataFrame, snr: float, keys: list[str], fs: float = 10.0, dt: float = 1e-3, value: str = "calcium", seed: int = 5) -> DataFrame:
    """Every k-th sample, less the trace's least value, with Gaussian noise of deviation 1 / ``snr``."""
    skip = int(1 / (fs * dt))
    low = F.min(value).over(Window.partitionBy(*keys))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys, "frame"), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    drawn = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))
    rows = calcium.withColumn("_low", low).where(F.pmod("frame", F.lit(skip)) == 0)
    return rows.select(*keys, (F.col("frame") / skip).cast("int").alias("frame"), (F.col(value) - F.col("_low") + drawn / F.lit(float(snr))).alias(value))


def tuning_inputs(samples: DataFrame, track: float) -> DataFrame:
    """Samples that have a position, with the position as a share of the track, as tuning expects it."""
    return samples.where(F.col("position").isNotNull() & ~F.isnan("position")).withColumn("position", F.col("position") / F.lit(float(track)))
