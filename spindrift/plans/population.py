"""Composed plans: fields by block, plasticity statistics, drift of the population."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators import spatial


def first_lap_statistics(raster: DataFrame, keys: list[str], lap: str = "lap", onset_part: float = 0.05, hits: int = 1) -> DataFrame:
    """Per field: its first active lap, and centre, gain, width and shift of that lap against the later ones.

    Active is a lap whose greatest value is over ``onset_part`` of the raster's.
    """
    w = Window.partitionBy(*keys)
    rows = raster.withColumn("_top", F.max("value").over(w)).withColumn("_lap_top", F.max("value").over(Window.partitionBy(*keys, lap)))
    rows = rows.withColumn("first_lap", F.min(F.when(F.col("_lap_top") > onset_part * F.col("_top"), F.col(lap))).over(w)).where(F.col(lap) >= F.col("first_lap"))
    rows = rows.withColumn("_first", F.col(lap) == F.col("first_lap"))
    com = lambda cond: ratio(F.sum(F.when(cond, F.col("bin") * F.col("value"))), F.sum(F.when(cond, F.col("value"))))
    top = lambda cond: F.max(F.when(cond, F.col("value")))
    out = rows.groupBy(*keys, "first_lap").agg(com(F.col("_first")).alias("first_com"), com(~F.col("_first")).alias("later_com"), top(F.col("_first")).alias("first_peak"), top(~F.col("_first")).alias("later_peak"))
    return out.withColumn("shift", F.col("later_com") - F.col("first_com")).withColumn("gain", ratio(F.col("first_peak") - F.col("later_peak"), F.col("first_peak") + F.col("later_peak")))


def centred_raster(raster: DataFrame, centres: DataFrame, keys: list[str], n: int, half: int) -> DataFrame:
    """Bins relative to each field's centre, wrapped round, cut to ``half`` on either side."""
    rows = raster.join(centres.select(*keys, "centre"), keys)
    away = F.pmod(F.col("bin") - F.round("centre").cast("int") + n // 2, F.lit(n)) - n // 2
    return rows.withColumn("rel", away).where(F.abs("rel") <= half).drop("centre", "bin")


def padded_laps(raster: DataFrame, fields: DataFrame, keys: list[str], laps: int, along: str = "rel", lap: str = "lap") -> DataFrame:
    """(keys, step, along, value): ``laps`` laps of each field from its ``first_lap`` on, counted by ``step`` from 0; laps that a session lacks are 0.

    A value that is missing within a lap that is there stays null.
    """
    rows = raster.join(fields.select(*keys, "first_lap"), keys).withColumn("step", (F.col(lap) - F.col("first_lap")).cast("int")).where((F.col("step") >= 0) & (F.col("step") < laps))
    bins = raster.select(*keys, along).distinct()
    spine = fields.select(*keys).distinct().join(bins, keys).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))
    there = rows.select(*keys, "step").distinct().withColumn("_there", F.lit(True))
    met = spine.join(rows.select(*keys, "step", along, "value"), [*keys, "step", along], "left").join(there, [*keys, "step"], "left")
    return met.select(*keys, "step", along, F.when(F.col("_there").isNull(), F.lit(0.0)).otherwise(F.col("value")).alias("value"))


def field_masks(fields: DataFrame, keys: list[str], n: int, margin: int = 0, circular: bool = False) -> DataFrame:
    """(keys, start_bin, stop_bin, bin): the bins of each field from its start to before its stop, with ``margin`` more on either side.

    On a circular track the mask goes on round the end, and a field whose stop comes before its start lies across it; else it is cut at the ends.
    """
    stop = F.when(F.col("stop_bin") <= F.col("start_bin"), F.col("stop_bin") + n).otherwise(F.col("stop_bin")) if circular else F.col("stop_bin")
    a, b = F.col("start_bin") - margin, stop + margin - 1
    if not circular:
        a, b = F.greatest(a, F.lit(0)), F.least(b, F.lit(n - 1))
    rows = fields.withColumn("_a", a.cast("int")).withColumn("_b", F.least(b, F.col("_a") + n - 1).cast("int")).where("_a <= _b")
    return rows.select(*keys, "start_bin", "stop_bin", F.explode(F.transform(F.sequence("_a", "_b"), lambda b: F.pmod(b, F.lit(n)).cast("int"))).alias("bin"))


def block_tuning(raster: DataFrame, keys: list[str], block: str, first_laps: int | None = None, lap: str = "lap") -> DataFrame:
    """Mean curve of each block, of its first laps only if so many are given."""
    rows = raster
    if first_laps is not None:
        rows = rows.withColumn("_o", F.dense_rank().over(Window.partitionBy(*keys, block).orderBy(lap))).where(F.col("_o") <= first_laps)
    return rows.groupBy(*keys, block, "bin").agg(F.avg("value").alias("value"))


def block_place_fields(signals: DataFrame, keys: list[str], block: str, lap: str, n_bins: int, n_shuffles: int, p: float, **limits) -> DataFrame:
    """Place fields within each block, all blocks in one plan."""
    return spatial.place_fields(signals, [*keys, block], lap, n_bins, n_shuffles, p, **limits)
