"""Pixels of regions and frames of movies, as rows (roi, y, x, weight) and (frame, y, x, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binarised(pixels: DataFrame, keys: list[str], part: float = 0.05) -> DataFrame:
    """Pixels over ``part`` of their mask's greatest weight."""
    top = F.max("weight").over(Window.partitionBy(*keys))
    return pixels.withColumn("_t", top).where(F.col("weight") > part * F.col("_t")).drop("_t")


def centroids(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean position of each mask, and its name; names that collide get a number."""
    c = pixels.groupBy(*keys).agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    name = F.format_string("%04d-%04d", F.floor("y").cast("int"), F.floor("x").cast("int"))
    named = c.withColumn("_n", name).withColumn("_i", F.row_number().over(Window.partitionBy("_n").orderBy(*keys)))
    return named.withColumn("name", F.when(F.col("_i") == 1, F.col("_n")).otherwise(F.concat_ws("-", "_n", (F.col("_i") - 1).cast("string")))).drop("_n", "_i")


def filled_in_time(movie: DataFrame, value: str = "value") -> DataFrame:
    """Missing values of each pixel become its last known one, or its first where there is none before."""
    w = Window.partitionBy("y", "x").orderBy("frame")
    past, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # where nothing is known before, the next known value is the pixel's first; a frame from each row to the end would be read anew for each row
    return movie.withColumn(value, F.coalesce(F.last(value, True).over(past), F.first(value, True).over(whole)))


def time_average(movie: DataFrame, value: str = "value") -> DataFrame:
    """Mean image."""
    return movie.groupBy("y", "x").agg(F.avg(value).alias(value))


def live_lines(movie: DataFrame, axis: str, least: float = 1e-10, value: str = "value") -> DataFrame:
    """Rows or columns (``axis`` y or x) whose values vary, for cropping."""
    return movie.groupBy(axis).agg(F.var_pop(value).alias("variance")).where(F.col("variance") > least).select(axis)


def bright(masks_mean: DataFrame, image: DataFrame, q: float = 0.99) -> DataFrame:
    """Masks (roi, value) whose mean exceeds a quantile of the mean image."""
    limit = image.agg(F.percentile("value", F.lit(q)).alias("_q"))
    return masks_mean.join(F.broadcast(limit)).where(F.col("value") > F.col("_q")).drop("_q")  # one row


def nearby(centres: DataFrame, dx: float, dy: float, keys: list[str]) -> DataFrame:
    """Pairs (a < b) of regions at most ``dx`` and ``dy`` apart; a grid of that size makes it a join on equality."""
    cell = lambda c, d: F.floor(F.col(c) / F.lit(float(d)))
    a = centres.select(*keys, F.col("roi").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(cell("x", dx) - 1, cell("x", dx) + 1)).alias("_cx"), cell("y", dy).alias("_y")).withColumn("_cy", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)))
    b = centres.select(*keys, F.col("roi").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x", dx).alias("_cx"), cell("y", dy).alias("_cy"))
    met = a.join(b, [*keys, "_cx", "_cy"])
    return met.where((F.col("a") < F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) <= dx) & (F.abs(F.col("ay") - F.col("by")) <= dy)).select(*keys, "a", "b")


def inside_bounds(pixels: DataFrame, sessions: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Pixels of the masks that keep a pixel inside the image in every session.

    ``sessions`` has (session, yy, yx, dy, xy, xx, dx): a pixel (y, x) lies at (yy y + yx x + dy, xy y + xx x + dx) there.
    """
    moved = pixels.join(sessions)
    y, x = F.col("yy") * F.col("y") + F.col("yx") * F.col("x") + F.col("dy"), F.col("xy") * F.col("y") + F.col("xx") * F.col("x") + F.col("dx")
    held = moved.groupBy(*keys, "session").agg(F.max((y >= 0) & (y < height) & (x >= 0) & (x < width)).alias("_in"))
    lost = held.where(~F.col("_in")).select(*keys).distinct()
    return pixels.join(lost, keys, "left_anti")
