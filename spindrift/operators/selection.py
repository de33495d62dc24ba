"""Choosing regions, trials and frames by what other operators found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Filter
from .intervals import around, frames_in


def responsive(points: DataFrame, triggers: DataFrame, pre: float, post: float, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Keys whose mean value after triggers exceeds that before by over ``threshold``; time 0 counts on both sides."""
    near = around(points, triggers, pre, post, keys)
    each = near.groupBy(*keys, "trigger").agg(F.avg(F.when(F.col("rel") <= 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("rel") >= 0, F.col("value"))).alias("b"))
    return each.groupBy(*keys).agg(F.avg(F.col("b") - F.col("a")).alias("response")).where(F.col("response") > threshold)


def with_field(signals: DataFrame, fields: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """Signals of regions that have a place field, or of those that have none."""
    return signals.join(fields.select(*keys).distinct(), keys, "left_semi" if inside else "left_anti")


def field_between(fields: DataFrame, column: str, low: float | None, high: float | None, n: int) -> DataFrame:
    """Fields whose start or stop bin lies strictly between two positions (shares of the track of ``n`` bins)."""
    at = lambda p: int(p * (n - 1) + 1e-9)
    out = fields
    if low is not None:
        out = out.where(F.col(column) > at(low))
    return out if high is None else out.where(F.col(column) < at(high))


def trials_during(onsets: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Trials (rows with ``onset``) that begin inside any event [onset, offset) of their keys."""
    frames = events.where("onset < offset").select(*keys, F.explode(F.sequence("onset", F.col("offset") - 1)).alias("onset")).distinct()
    return onsets.join(frames, [*keys, "onset"], "left_semi")


def aligned(*results: DataFrame, keys: list[str]) -> DataFrame:
    """Results one below the other with all columns of any, without rows that have nothing but keys."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    known = lambda c, t: F.col(c).isNotNull() & ~F.isnan(c) if t in ("double", "float") else F.col(c).isNotNull()
    return out.where(reduce(lambda a, b: a | b, (known(c, t) for c, t in out.dtypes if c not in keys)))


def classified(features: DataFrame, model, columns: list[str], keys: list[str]) -> DataFrame:
    """Keys that a fitted ``pyspark.ml`` model over standardised features calls positive; missing features are 0."""
    return model.transform(features.na.fill(0.0, columns)).where(F.col("prediction") > 0).select(*keys)


def fit_classifier(features: DataFrame, label: str, columns: list[str]):
    """A logistic model over standardised features, for ``classified``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label)]
    return Pipeline(stages=steps).fit(features.na.fill(0.0, columns))


def ranked_by_centroid(curves: DataFrame, keys: list[str], by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Keys in order of their curve's centre of mass by bin, counted from 0 by ``place`` within ``by`` (sessions, say); without one come last.

    A curve is one row before the ranking; a session's regions are ranked together.
    """
    at = curves.groupBy(*keys).agg((F.sum(F.col("bin") * F.col(value)) / F.nullif(F.sum(value), F.lit(0.0))).alias("centroid"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("centroid").asc_nulls_last(), *keys)
    return at.withColumn("place", F.row_number().over(w) - 1)


class FieldEdge:
    """The start or stop of a place field, for conditions as they are written: ``(0.2 < start) & (start < 0.5)``.

    Positions are shares of the track of ``n`` bins; comparing gives a filter over rows with the edge's column.
    """

    def __init__(self, column: str, n: int):
        self.column, self.n = column, n

    def _bin(self, position: float) -> int:
        return int(position * (self.n - 1) + 1e-9)

    def __gt__(self, position: float) -> Filter:
        return Filter(F.col(self.column) > self._bin(position))

    def __lt__(self, position: float) -> Filter:
        return Filter(F.col(self.column) < self._bin(position))

    def __ge__(self, position: float) -> Filter:
        return Filter(F.col(self.column) >= self._bin(position))

    def __le__(self, position: float) -> Filter:
        return Filter(F.col(self.column) <= self._bin(position))


def in_reward(frames: DataFrame, intervals: DataFrame, keys: list[str], inside: bool = True, name: str = "reward") -> DataFrame:
    """Frames inside (or outside) the intervals (keys, name, onset, offset) called ``reward``."""
    return frames_in(frames, intervals.where(F.col("name") == name), keys, "frame", inside=inside)


def ranked_by_peak(curves: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys in order of the bin of their greatest value, the order counted from 0 by ``place``."""
    peaks = curves.groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col(value), "bin")).alias("peak"))
    counts = peaks.groupBy("peak").agg(F.count(F.lit(1)).alias("n"))
    # few rows: one for each bin
    before = counts.withColumn("_b", F.coalesce(F.sum("n").over(Window.orderBy("peak").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("peak").orderBy(*keys)) - 1
    return peaks.withColumn("_i", inside).join(F.broadcast(before), "peak").select(*keys, "peak", (F.col("_i") + F.col("_b")).alias("place"))
