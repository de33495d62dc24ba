"""Readers of files that other programs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metadata of regions or trials; types are given, not guessed. A row that doesn't fit them is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Imaging parameters: file, frame_period, imaging_system."""
    return spark.read.json(path, schema="frame_period double, imaging_system string", multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def frame_period_xml(spark: SparkSession, path: str, row_tag: str = "Frame", planes: int = 1, both_ways: bool = False) -> DataFrame:
    """Frame period by file, from the absolute times of the first two frames of an XML description.

    A volume of several planes takes the mean of its first two steps; scanned both ways, a plane comes back after twice that.
    """
    frames = spark.read.format("xml").option("rowTag", row_tag).schema("_absoluteTime double, _index int").load(path).withColumn("file", F.col("_metadata.file_path"))
    first = frames.groupBy("file").agg(F.sort_array(F.collect_list("_absoluteTime")).alias("t"))
    steps = (F.get("t", F.lit(2)) - F.get("t", F.lit(0))) / 2 if planes > 1 else F.get("t", F.lit(1)) - F.get("t", F.lit(0))
    return first.select("file", F.round(steps * (2 if both_ways else 1), 6).alias("frame_period"))


def imaging_times(spark: SparkSession, trials: DataFrame) -> DataFrame:
    """(key columns, frame, t) of trials with n_frames and frame_period."""
    rows = trials.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)))
    return rows.withColumn("t", F.col("frame") * F.col("frame_period")).drop("n_frames", "frame_period")


def lfp_from_imaging_start(lfp: DataFrame, keys: list[str], channel: str = "adc", level: float = 1.0) -> DataFrame:
    """Samples from the first one at which the sync channel exceeds ``level``, with time counted from there."""
    start = lfp.where(F.col(channel) > level).groupBy(*keys).agg(F.min("t").alias("_0"))
    return lfp.join(start, keys).where(F.col("t") >= F.col("_0")).withColumn("t", F.col("t") - F.col("_0")).drop("_0")


def accepted_cells(signals: DataFrame, cells: DataFrame, bad_frames: DataFrame | None = None) -> DataFrame:
    """Signals of accepted cells; zeros, and frames known as bad, are missing."""
    out = signals.join(cells.where("accepted").select("roi"), "roi", "left_semi").withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))
    if bad_frames is None:
        return out
    bad = bad_frames.select("frame").distinct().withColumn("_bad", F.lit(True))
    return out.join(bad, "frame", "left").withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")
