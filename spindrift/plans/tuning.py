"""Composed tuning: smoothed and normalised curves, event tuning, fields with all their limits, drift of the population."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators import spatial
from ..operators.intervals import as_of
from ..operators.rolling import interpolated


def spatial_tuning(df: DataFrame, keys: list[str], n: int, sigma: float | None = None, normalize: bool = False) -> DataFrame:
    """Mean by keys (a lap among them, if wanted) and bin, smoothed round the track; missing bins count as 0 there.

    ``normalize`` divides each curve by its greatest value.
    """
    curve = spatial.raster(df, keys, n, 0.0 if sigma else None)
    if sigma:
        curve = spatial.smooth_wrapped(curve, keys, sigma).withColumnRenamed("smoothed", "value")
    if normalize:
        curve = curve.withColumn("value", ratio(F.col("value"), F.max("value").over(Window.partitionBy(*keys))))
    return curve


def simple_tuning(df: DataFrame, keys: list[str], n: int, sigma: float | None = None, circular: bool = False) -> DataFrame:
    """Pooled curve with missing bins interpolated from both sides, smoothed with a kernel of 8 sigma points, and missing again after that.

    Linear tracks see zeros beyond their ends; on circular ones the curve goes on with itself.
    """
    raw = spatial.raster(df, keys, n)
    if sigma is None:
        return raw
    curve = interpolated(raw.withColumn("_gap", F.col("value").isNull()), "value", "value", keys, "bin")
    again = F.when(~F.col("_gap"), F.col("smoothed"))
    if not circular:
        return spatial.smooth_same(curve, keys, sigma).withColumn("value", again).drop("smoothed", "_gap")
    thrice = curve.withColumn("_turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("bin", F.col("bin") + F.col("_turn") * n)
    smooth = spatial.smooth_same(thrice, keys, sigma).where("_turn = 0")
    return smooth.withColumn("value", again).drop("_turn", "smoothed", "_gap")


def event_tuning(events: DataFrame, positions: DataFrame, rois: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Events by bin of the position right before each onset (column ``t``), the same counts for each region of ``rois``."""
    placed = as_of(events.select(*keys, "t"), positions.select(*keys, "t", "position"), "position", keys)
    counts = placed.groupBy(*keys, spatial.bin_floor(F.col("position"), n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = rois.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spine.join(counts, [*keys, "bin"], "left").na.fill(0, ["n"])


def velocity_map(frames: DataFrame, keys: list[str], lap: str, n: int) -> DataFrame:
    """Mean velocity by lap and bin of the frames at hand (columns position, velocity); bins without frames are missing."""
    return spatial.raster(frames.withColumnRenamed("velocity", "value"), [*keys, lap], n)


def plateau_velocity(fields: DataFrame, velocity: DataFrame, keys: list[str], lap: str, laps_before: dict[int, int], name: str = "plateau_velocity") -> DataFrame:
    """Mean velocity over each field's bins (both ends included) in its first lap; ``laps_before`` says how many laps lie before each block.

    Fields have block, first_lap (counted inside the block), start_bin and stop_bin.
    """
    before = F.create_map(*(F.lit(x) for k, v in laps_before.items() for x in (k, v)))
    at = fields.withColumn(lap, (F.col("first_lap") + F.element_at(before, F.col("block"))).cast(velocity.schema[lap].dataType))
    bins = at.withColumn("bin", F.explode(F.sequence("start_bin", "stop_bin")))
    met = bins.join(velocity.select(*keys, lap, "bin", F.col("value").alias("_v")), [*keys, lap, "bin"], "left")
    return met.groupBy(*fields.columns).agg(F.avg("_v").alias(name))


def place_fields(df: DataFrame, keys: list[str], lap: str, n_bins: int = 100, n_shuffles: int = 100, p: float = 0.01, sigma: float | None = 3, min_active: float = 3, narrowest: float = 0.05, widest: float = 0.8, circular: bool = True) -> DataFrame:
    """Fields by the shuffle test on smoothed curves: widths are shares of the track, ``min_active`` below 1 a share of the laps.

    Blocks and contexts are keys like any other: all are tested in one plan.
    """
    smooth = lambda curves, by: curves if not sigma else (spatial.smooth_wrapped(curves, by, sigma).withColumnRenamed("smoothed", "value"))
    threshold = spatial.null_threshold(df, keys, lap, n_bins, n_shuffles, p, sigma)
    curve = smooth(spatial.tuning(df, keys, n_bins), keys)
    fields = spatial.fields(df, curve.join(threshold, [*keys, "bin"]), keys, lap, n_bins, int(round(narrowest * n_bins)), int(round(widest * n_bins)), circular)
    laps = df.groupBy(*keys).agg(F.count_distinct(lap).alias("_laps"))
    least = F.ceil(F.lit(float(min_active)) * F.col("_laps")) if 0 < min_active < 1 else F.lit(min_active)
    return fields.join(laps, keys).where(F.col("active_laps") >= least).drop("_laps")


def drift_scores(xcorr: DataFrame, min_corr: float = 0.25, min_frac: float = 0.33, by: list[str] | None = None) -> DataFrame:
    """Median displacement of each lap against all others: lap, valid, drift.

    ``xcorr`` has a < b, lag and r. The displacement of a pair is the centre of mass of its correlations over the
    lags. A lap counts if more than ``min_frac`` of the others exceed ``min_corr`` with it at some lag; pairs with a lap
    that doesn't are left out.
    """
    by = by or []
    pairs = xcorr.groupBy(*by, "a", "b").agg(F.max("r").alias("best"), ratio(F.sum(F.col("lag") * F.col("r")), F.sum("r")).alias("moved"))
    both = pairs.unionByName(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "best", "moved"))
    # a lap correlates with itself: one more in both counts
    share = both.groupBy(*by, "a").agg(((F.count(F.when(F.col("best") > min_corr, 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("_share"))
    valid = share.select(*by, "a", (F.col("_share") > min_frac).alias("valid"))
    good = valid.where("valid").select(*by, "a")
    kept = both.join(good, [*by, "a"], "left_semi").join(good.withColumnRenamed("a", "b"), [*by, "b"], "left_semi")
    own = good.select(*by, "a", F.lit(0.0).alias("moved"))
    drift = kept.select(*by, "a", "moved").unionByName(own).groupBy(*by, "a").agg(F.percentile("moved", F.lit(0.5)).alias("drift"))
    return valid.join(drift, [*by, "a"], "left").withColumnRenamed("a", "lap")
