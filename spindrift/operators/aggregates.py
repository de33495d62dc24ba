"""Summary features of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def moments(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Mean, population deviation and variance, extremes, median, quartile range, skewness and excess kurtosis."""
    q = lambda p: F.percentile(column, F.lit(p))
    return df.groupBy(*keys).agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.var_pop(column).alias("var"), F.max(column).alias("max"), F.min(column).alias("min"), q(0.5).alias("median"),
        (q(0.75) - q(0.25)).alias("iqr"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis"),
    )


def means(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Geometric and harmonic mean; null if any value is not positive."""
    bad = F.min(column) <= 0
    return df.groupBy(*keys).agg(F.when(~bad, F.exp(F.avg(F.when(F.col(column) > 0, F.log(column))))).alias("gmean"), F.when(~bad, F.count(column) / F.sum(F.when(F.col(column) > 0, 1 / F.col(column)))).alias("hmean"))


def central_moment(df: DataFrame, column: str, order: int, keys: list[str]) -> DataFrame:
    """Mean of (x - mean) to the power ``order``."""
    centred = df.withColumn("_x", F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))
    return centred.groupBy(*keys).agg(F.avg(F.pow("_x", F.lit(order))).alias("moment"))


def cumulants(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Unbiased k-statistics 1 to 4 from central power sums."""
    x = df.withColumn("_x", F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))
    sums = x.groupBy(*keys).agg(F.count(column).cast("double").alias("n"), F.avg(column).alias("k1"), *(F.sum(F.pow("_x", F.lit(p))).alias(f"s{p}") for p in (2, 3, 4)))
    n = F.col("n")
    m2, m3, m4 = F.col("s2") / n, F.col("s3") / n, F.col("s4") / n
    k4 = n * n * ((n + 1) * m4 - 3 * (n - 1) * m2 * m2) / F.nullif((n - 1) * (n - 2) * (n - 3), F.lit(0.0))
    return sums.select(*keys, "k1", ratio(F.col("s2"), n - 1).alias("k2"), (n * n * m3 / F.nullif((n - 1) * (n - 2), F.lit(0.0))).alias("k3"), k4.alias("k4"))


def complete_frames(df: DataFrame, together: list[str], frame: str, value: str = "value") -> DataFrame:
    """Rows of the frames in which no region of ``together`` (an experiment's keys) misses its value; NaN is missing too."""
    missing = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    gaps = df.where(missing).select(*together, frame).distinct()
    return df.join(gaps, [*together, frame], "left_anti")


def histogram(df: DataFrame, column: str, lower: float, upper: float, nbins: int, keys: list[str]) -> DataFrame:
    """Counts in equal bins of [lower, upper], the last closed; bins without values count 0."""
    width = (upper - lower) / nbins
    inside = df.where((F.col(column) >= lower) & (F.col(column) <= upper))
    counted = inside.withColumn("bin", F.least(F.floor((F.col(column) - F.lit(lower)) / F.lit(width)), F.lit(nbins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    return spine.join(counted, [*keys, "bin"], "left").na.fill(0, ["n"])


def curve_features(curves: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Of non-negative curves by ``bin``: entropy (nats) of the shares, bin of the peak, scaled median deviation."""
    w = Window.partitionBy(*keys)
    v = F.coalesce(value, F.lit(0.0))
    rows = curves.withColumn("_v", v)
    rows = rows.withColumn("_t", F.sum("_v").over(w)).withColumn("_m", F.percentile("_v", F.lit(0.5)).over(w))
    p = ratio(F.col("_v"), F.col("_t"))
    return rows.groupBy(*keys).agg(
        (-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"), F.min_by("bin", F.struct(-F.col("_v"), "bin")).alias("peak"), (1.4826 * F.percentile(F.abs(F.col("_v") - F.col("_m")), F.lit(0.5))).alias("mad")
    )


def trend(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Least-squares line and r squared."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
