"""Runs, events and hysteresis over ordered frames; joins of points and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, flag: Column, keys: list[str], order: str = "frame", circular: int | None = None) -> DataFrame:
    """Maximal runs of true as half-open (onset, offset), numbered from 0 by ``run``.

    With ``circular`` = n, a run that ends at n joins one that starts at 0; its offset is then less than
    its onset.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.select(*keys, order, F.coalesce(flag, F.lit(False)).alias("_on"))
    opened = (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int")
    numbered = marked.withColumn("_start", opened).withColumn("run", F.sum("_start").over(w) - 1).where("_on")
    out = numbered.groupBy(*keys, "run").agg(F.min(order).alias("onset"), (F.max(order) + 1).alias("offset"))
    if circular is None:
        return out.withColumn("run", F.col("run").cast("int"))
    whole = Window.partitionBy(*keys)
    head, tail = F.min(F.when(F.col("onset") == 0, F.col("offset"))).over(whole), F.max(F.when(F.col("offset") == circular, F.col("onset"))).over(whole)
    wrapped = head.isNotNull() & tail.isNotNull() & (tail > 0)
    out = out.withColumn("_head", head).withColumn("_wrap", wrapped)
    out = out.where(~(F.col("_wrap") & (F.col("onset") == 0)))
    out = out.withColumn("offset", F.when(F.col("_wrap") & (F.col("offset") == circular), F.col("_head")).otherwise(F.col("offset")))
    return out.withColumn("run", (F.row_number().over(Window.partitionBy(*keys).orderBy("onset")) - 1).cast("int")).select(*keys, "run", "onset", "offset")


def hysteresis(df: DataFrame, column: str, on: float, off: float, keys: list[str], order: str = "frame") -> DataFrame:
    """Events that start when a signal passes above ``on`` and last until it falls below ``off``.

    ``onset`` is the frame before the crossing (0 at least), ``offset`` the last frame not below ``off``;
    an event still open at the end is dropped. Also ``amplitude`` and its frame ``peak``.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col(column) > on, 1).when(F.col(column) < off, 0)
    state = df.withColumn("_s", F.coalesce(F.last(turn, True).over(upto), F.lit(0)))
    state = state.withColumn("_new", ((F.col("_s") == 1) & (F.coalesce(F.lag("_s").over(w), F.lit(0)) == 0)).cast("int"))
    state = state.withColumn("event", F.sum("_new").over(w)).withColumn("_last", F.max(order).over(Window.partitionBy(*keys)))
    events = state.where("_s = 1").groupBy(*keys, "event").agg(
        F.min(order).alias("first"), F.max(order).alias("offset"), F.max(column).alias("amplitude"), F.min_by(order, F.struct(-F.col(column), order)).alias("peak"), F.max("_last").alias("_last")
    )
    return events.where("offset < _last").select(*keys, F.greatest(F.col("first") - 1, F.lit(0)).alias("onset"), "offset", "amplitude", "peak")


def frames_in(df: DataFrame, events: DataFrame, keys: list[str], order: str = "frame", inside: bool = True) -> DataFrame:
    """Rows whose frame lies in any [onset, offset) of the same keys, or in none; an equi-join on frames."""
    frames = events.where("onset < offset").select(*keys, F.explode(F.sequence("onset", F.col("offset") - 1)).alias(order)).distinct()
    return df.join(frames, [*keys, order], "left_semi" if inside else "left_anti")


def around(points: DataFrame, triggers: DataFrame, pre: float, post: float, keys: list[str], t: str = "t") -> DataFrame:
    """Each trigger with the points of its keys whose time is in [trigger - pre, trigger + post].

    Both sides are dealt to time buckets as wide as the window; a trigger meets the two or three buckets it
    reaches, so the join is on equality and stays local.
    """
    width = float(pre + post) or 1.0
    bucket = lambda c: F.floor(c / F.lit(width))
    reach = triggers.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("trigger") - pre), bucket(F.col("trigger") + post))))
    near = points.withColumn("_bucket", bucket(F.col(t))).join(reach, [*keys, "_bucket"]).drop("_bucket")
    return near.where((F.col(t) >= F.col("trigger") - pre) & (F.col(t) <= F.col("trigger") + post)).withColumn("rel", F.col(t) - F.col("trigger"))


def as_of(left: DataFrame, right: DataFrame, value: str, keys: list[str], t: str = "t", strict: bool = True) -> DataFrame:
    """Add ``value`` of the latest row of ``right`` before each row of ``left`` (or at it, unless strict).

    One pass over the union of both, sorted by time inside the keys.
    """
    columns = [c for c in left.columns]
    a = left.select(*[F.col(c) for c in columns], F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1 if not strict else 0).alias("_side"))
    b = right.select(*[F.col(c) if c in (*keys, t) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns], F.struct(F.col(value).alias("v")).alias("_s"))
    a = a.select(*columns, F.lit(None).cast(b.schema["_s"].dataType).alias("_s"), "_side")
    b = b.select(*columns, "_s", F.lit(0 if not strict else 1).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.withColumn("_left", F.lit(True)).unionByName(b.withColumn("_left", F.lit(False)))
    return both.withColumn(value, F.last("_s", True).over(w)["v"]).where("_left").select(*columns, value)


def paired(messages: DataFrame, action: str, start: str, stop: str, keys: list[str], t: str = "t") -> DataFrame:
    """Start and stop messages as intervals; an end without a start, or a start without an end, is null."""
    w = Window.partitionBy(*keys).orderBy(t)
    seen = messages.withColumn("_next", F.lead(action).over(w)).withColumn("_t", F.lead(t).over(w)).withColumn("_prev", F.lag(action).over(w))
    opened = seen.where(F.col(action) == start).select(*keys, F.col(t).alias("onset"), F.when(F.col("_next") == stop, F.col("_t")).alias("offset"))
    loose = seen.where((F.col(action) == stop) & (F.col("_prev").isNull() | (F.col("_prev") == stop))).select(*keys, F.lit(None).cast("double").alias("onset"), F.col(t).alias("offset"))
    return opened.unionByName(loose)


def blocks(df: DataFrame, value: str, keys: list[str], order: str, name: str = "block") -> DataFrame:
    """Number runs of equal values from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & F.lag(order).over(w).isNotNull()
    return df.withColumn("_c", changed.cast("int")).withColumn(name, F.sum("_c").over(w).cast("int")).drop("_c")


def crossings(df: DataFrame, column: str, level: float, keys: list[str], order: str = "frame") -> DataFrame:
    """Frames right before a signal passes ``level`` in either direction."""
    w = Window.partitionBy(*keys).orderBy(order)
    above = F.col(column) >= level
    turned = df.withColumn("_n", F.lead(above).over(w)).withColumn("_a", above)
    return turned.where(F.col("_n").isNotNull() & (F.col("_n") != F.col("_a"))).select(*keys, order, F.col("_n").alias("rising"))


def laps_as_events(starts: DataFrame, keys: list[str], order: str, n_frames: str) -> DataFrame:
    """Laps as [onset, offset): each ends where the next starts, the last at ``n_frames``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return starts.select(*keys, (F.row_number().over(w) - 1).alias("lap"), F.col(order).alias("onset"), F.coalesce(F.lead(order).over(w), F.col(n_frames)).alias("offset"))


def expand(events: DataFrame, pre: int, post: int) -> DataFrame:
    """Events that start ``pre`` frames earlier (0 at least) and end ``post`` later."""
    return events.withColumn("onset", F.greatest(F.col("onset") - pre, F.lit(0))).withColumn("offset", F.col("offset") + post)


def impulses(events: DataFrame, frames: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """A signal that is 1 at onsets and 0 at all other frames of ``frames``."""
    hit = events.select(*keys, F.col("onset").alias(order)).distinct().withColumn("value", F.lit(1.0))
    return frames.select(*keys, order).join(hit, [*keys, order], "left").na.fill(0.0, ["value"])


def inter_trial(df: DataFrame, active: str, position: str, keys: list[str], lap: str, order: str = "frame", within: int = 30) -> DataFrame:
    """Adds ``iti``: no context is active, or the lap is young and its position's least value is still to come.

    The start of each lap up to the least position among its first ``within`` frames belongs to the pause.
    """
    w = Window.partitionBy(*keys, lap).orderBy(order)
    place = df.withColumn("_i", F.row_number().over(w) - 1)
    turn = F.min_by("_i", F.when(F.col("_i") < within, F.struct(position, "_i"))).over(Window.partitionBy(*keys, lap))
    return place.withColumn("_t", turn).withColumn("iti", ~F.coalesce(F.col(active), F.lit(False)) | (F.col("_i") < F.col("_t"))).drop("_i", "_t")


def real_time_frames(frames: DataFrame, events: DataFrame, pre: float, post: float, keys: list[str]) -> DataFrame:
    """Frames (keys, frame, t) from the first at or after onset - pre up to, but without, the last at or before offset + post."""
    e = events.withColumn("_a", F.col("onset") - pre).withColumn("_b", F.col("offset") + post).withColumn("_e", F.monotonically_increasing_id())
    # as wide as the median window, so that most events are in two buckets at most
    middle = e.where("_a <= _b").agg(F.percentile_approx(F.col("_b") - F.col("_a"), 0.5)).first()[0]
    width = max(float(middle or 0.0), 1e-3)
    bucket = lambda c: F.floor(c / F.lit(width))
    reach = e.where("_a <= _b").select(*keys, "_a", "_b", "_e", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_b")))).alias("_bucket"))
    near = frames.withColumn("_bucket", bucket(F.col("t"))).join(reach, [*keys, "_bucket"]).where("t >= _a and t <= _b")
    last = F.max("t").over(Window.partitionBy(*keys, "_e"))
    return near.withColumn("_last", last).where("t < _last").select(*frames.columns).distinct()


def masked_by_events(signals: DataFrame, events: DataFrame, keys: list[str], order: str = "frame", value: str = "value") -> DataFrame:
    """All rows; ``value`` is missing outside the events of the row's own keys (region, lap, ...)."""
    hit = events.where("onset < offset").select(*keys, F.explode(F.sequence("onset", F.col("offset") - 1)).alias(order)).distinct().withColumn("_in", F.lit(True))
    return signals.join(hit, [*keys, order], "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")


def frames_after(events: DataFrame, times: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Adds ``frame`` to events with ``onset``: one more than the number of frame times before it."""
    a = events.select(*events.columns, F.col("onset").alias("_t"), F.lit(0).alias("_side"))
    b = times.select(*(F.col(c) if c in keys else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns), F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"))
    # events come before a frame of the same time, so that only earlier frames count
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("frame", (F.sum("_side").over(w) + 1).cast("int"))
    return both.where("_side = 0").drop("_t", "_side")


def impulses_at_times(events: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """A signal over the frames of ``times`` (keys, frame, t) that is 1 at the frame after each onset."""
    hit = frames_after(events.select(*keys, "onset"), times, keys).select(*keys, "frame").distinct().withColumn("value", F.lit(1.0))
    return times.select(*keys, "frame").join(hit, [*keys, "frame"], "left").na.fill(0.0, ["value"])


def frames_to_times(events: DataFrame, period: float) -> DataFrame:
    """Events in frames as events in seconds."""
    return events.withColumn("onset", F.col("onset") * F.lit(float(period))).withColumn("offset", F.col("offset") * F.lit(float(period)))


def context_of_samples(df: DataFrame, contexts: DataFrame, keys: list[str], order: str = "frame", iti: str | None = None) -> DataFrame:
    """Adds ``context``: the name of the context interval [onset, offset) that covers the frame, the greatest of several; none in pauses."""
    inside = contexts.where("onset < offset").select(*keys, F.explode(F.sequence("onset", F.col("offset") - 1)).alias(order), "name")
    named = inside.groupBy(*keys, order).agg(F.max("name").alias("context"))
    out = df.join(named, [*keys, order], "left")
    return out.withColumn("context", F.when(~F.coalesce(F.col(iti), F.lit(False)), F.col("context"))) if iti else out


def context_of_laps(samples: DataFrame, keys: list[str], lap: str = "lap", order: str = "frame") -> DataFrame:
    """The context of each lap: that of its first sample that has one."""
    return samples.where("context is not null").groupBy(*keys, lap).agg(F.min_by("context", order).alias("context"))


def block_ranges(df: DataFrame, value: str, keys: list[str], order: str = "frame") -> DataFrame:
    """Half-open ranges of equal values: keys, block, value, start, stop.

    Rows without a value belong to the block before them; each block stops where the next one starts, the last
    one after the last row.
    """
    known = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    first = known.withColumn("_p", F.lag(value).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(value)))
    end = df.groupBy(*keys).agg((F.max(order) + 1).alias("_end"))
    out = first.join(end, keys).select(*keys, (F.row_number().over(w) - 1).alias("block"), F.col(value), F.col(order).alias("start"), F.coalesce(F.lead(order).over(w), "_end").alias("stop"))
    return out


def merged_blocks(df: DataFrame, value: str, keys: list[str], order: str = "lap") -> DataFrame:
    """Blocks of laps as they are walked through lap by lap: like ``block_ranges``, but a last lap of another value is no block of its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.col(order) == F.max(order).over(Window.partitionBy(*keys))
    kept = df.withColumn("_last", last & F.lag(order).over(w).isNotNull()).withColumn(value, F.when(~F.col("_last"), F.col(value))).drop("_last")
    return block_ranges(kept, value, keys, order)


def spatial_to_time(spatial: DataFrame, positions: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """Spatial events (keys, onset, offset as positions) as runs of frames strictly inside any of them.

    Few events to an experiment: each frame meets the events of its keys.
    """
    met = positions.join(spatial.select(*keys, F.col("onset").alias("_a"), F.col("offset").alias("_b")), keys, "left")
    inside = met.groupBy(*keys, order).agg(F.max((F.col("position") > F.col("_a")) & (F.col("position") < F.col("_b"))).alias("_in"))
    return runs(inside, F.col("_in"), keys, order)


def spatial_to_bins(spatial: DataFrame, n: int) -> DataFrame:
    """Positions of spatial events as bins of the ``n`` points from 0 to 1, ends included; a missing end stays missing."""
    at = lambda c: F.floor(F.col(c) * F.lit(float(n - 1)) + 1e-9).cast("int")
    return spatial.withColumn("onset", at("onset")).withColumn("offset", at("offset"))


def runs_as_positions(runs_: DataFrame, positions: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """Events in frames as spatial events: the positions at their onset and offset; an offset beyond the last frame is missing."""
    p = positions.select(*keys, F.col(order).alias("_f"), "position")
    a = runs_.join(p.withColumnRenamed("_f", "onset").withColumnRenamed("position", "_a"), [*keys, "onset"], "left")
    b = a.join(p.withColumnRenamed("_f", "offset").withColumnRenamed("position", "_b"), [*keys, "offset"], "left")
    return b.select(*keys, "run", F.col("_a").alias("onset"), F.col("_b").alias("offset"))
