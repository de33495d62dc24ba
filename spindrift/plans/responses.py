"""Responses round triggers: binned peri-event signals, responsiveness, named triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.intervals import around

#: Triggers by name: the behaviour variable and the edge of its intervals. Fixed values.
TRIGGERS = {
    "RunningStart": ("running", "onset"),
    "RunningStop": ("running", "offset"),
    "Reward": ("reward", "onset"),
    "Water": ("water", "onset"),
    "LED_on": ("led", "onset"),
    "LED_off": ("led", "offset"),
    "Licking": ("licking", "onset"),
}


def named_triggers(intervals: DataFrame, name: str, keys: list[str], variable: str = "name") -> DataFrame:
    """(keys, trigger) of a named trigger, from behaviour intervals (keys, variable, onset, offset); missing edges are none."""
    which, edge = TRIGGERS[name]
    return intervals.where((F.col(variable) == which) & F.col(edge).isNotNull()).select(*keys, F.col(edge).alias("trigger"))


def psth(points: DataFrame, triggers: DataFrame, pre: float, post: float, dt: float, keys: list[str], how: str = "sum", limit: int = 10) -> DataFrame:
    """Signal by time from each trigger: keys, trigger, step, rel, value, on a grid from ``-pre`` to ``post``.

    Bins of ``dt`` are counted from the first sample inside each trigger's window. An empty bin sums to 0; a missing
    mean is interpolated in time, up to ``limit`` bins after the last one known. Each grid time takes the nearest bin,
    the later of two as near. A trigger without samples has no rows.
    """
    near = around(points, triggers, pre, post, keys)
    one = [*keys, "trigger"]
    near = near.withColumn("_0", F.min("rel").over(Window.partitionBy(*one)))
    near = near.withColumn("_i", F.floor((F.col("rel") - F.col("_0")) / F.lit(float(dt))).cast("int"))
    made = F.sum("value") if how == "sum" else F.avg("value")
    bins = near.groupBy(*one, "_0", "_i").agg(made.alias("value"))
    ends = bins.groupBy(*one, "_0").agg(F.max("_i").alias("_n"))
    full = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), "_n"))).join(bins.drop("_0"), [*one, "_i"], "left")
    if how == "sum":
        full = full.withColumn("value", F.coalesce("value", F.lit(0.0)))
    else:
        w = Window.partitionBy(*one).orderBy("_i")
        back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        known = F.when(F.col("value").isNotNull(), F.struct("_i", "value"))
        full = full.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(on))
        step = F.col("_i") - F.col("_a._i")
        line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * step / (F.col("_b._i") - F.col("_a._i"))
        full = full.withColumn("value", F.coalesce("value", F.when(step <= limit, line)))
    steps = int(round((pre + post) / dt))
    grid = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("rel", F.lit(-float(pre)) + F.col("step") * F.lit(float(dt)))
    place = F.floor((F.col("rel") - F.col("_0")) / F.lit(float(dt)) + 0.5)
    grid = grid.withColumn("_i", F.greatest(F.lit(0), F.least(place, F.col("_n"))).cast("int"))
    return grid.join(full.select(*one, "_i", "value"), [*one, "_i"]).select(*one, "step", "rel", "value")


def responsiveness(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, over the binned responses of ``psth``: response (after less before) and contrast; time 0 counts on both sides."""
    near_zero = 1e-9
    each = responses.groupBy(*keys, "trigger").agg(F.avg(F.when(F.col("rel") <= near_zero, F.col("value"))).alias("_a"), F.avg(F.when(F.col("rel") >= -near_zero, F.col("value"))).alias("_b"))
    change = F.col("_b") - F.col("_a")
    return each.groupBy(*keys).agg(F.avg(change).alias("response"), F.avg(ratio(change, F.col("_a") + F.col("_b"))).alias("contrast"))
