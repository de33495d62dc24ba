"""Behaviour logs: one JSON message per line, with ``time`` in seconds; positions, laps, context, valve, tone and lick messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ACTION = "struct<id: string, pin: int, action: string>"
#: The messages that are read; others are ignored.
SCHEMA = f"time double, y double, lap int, position_controller struct<position: struct<dy: double, dt: double>, millis: double>, behavior_controller struct<context: {_ACTION}, valve: {_ACTION}, tone: {_ACTION}, lick: {_ACTION}>"

FIELDS = ["time", "y", "lap", "position_controller", "behavior_controller"]


def parsed(lines: DataFrame, key: str = "file", text: str = "value", errors: str = "skip") -> DataFrame:
    """Messages of log lines (key, text): key and columns of SCHEMA.

    A line that is no message, or has no time, is left out (``skip``; ``broken_lines`` lists those), kept in a column
    ``broken`` (``keep``), or ends the job (``raise``). What a log says about itself (``settings``) is no message.
    """
    rows = lines.where(F.length(F.trim(text)) > 0).select(key, F.from_json(text, f"{SCHEMA}, settings string").alias("m"), F.col(text).alias("_text"))
    rows = rows.where("m.settings is null").withColumn("m", F.col("m").dropFields("settings"))
    bad = F.col("m.time").isNull()
    if errors == "keep":
        return rows.select(key, "m.*", F.when(bad, F.col("_text")).alias("broken"))
    if errors == "raise":
        time = F.when(bad, F.raise_error(F.concat(F.lit("no message: "), F.col("_text"))).cast("double")).otherwise(F.col("m.time"))
        return rows.select(key, time.alias("time"), *(F.col(f"m.{c}").alias(c) for c in FIELDS if c != "time"))
    return rows.where(~bad).select(key, "m.*")


def read_log(spark: SparkSession, path: str, errors: str = "skip") -> DataFrame:
    """Parsed messages of all log files below ``path``: file and what ``parsed`` gives."""
    return parsed(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), "file", "value", errors)


def broken_lines(lines: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """(key, broken): the lines that ``parsed`` leaves out."""
    return parsed(lines, key, text, "keep").where("broken is not null").select(key, "broken")


def settings(lines: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """What a log says about itself: key, sync_pin, track_length, trial_length, reward_id, reward_pin, valves (pin to context)."""
    kind = "struct<sync_pin: int, track_length: double, trial_length: double, contexts: array<struct<id: string, valves: array<int>>>, reward: struct<id: string, pin: int>>"
    rows = lines.where(F.col(text).contains('"settings"')).select(key, F.from_json(text, f"settings {kind}")["settings"].alias("s")).where("s is not null")
    pins = F.flatten(F.transform(F.coalesce("s.contexts", F.array()), lambda c: F.transform(F.coalesce(c["valves"], F.array().cast("array<int>")), lambda v: F.struct(v.alias("pin"), c["id"].alias("id")))))
    return rows.select(key, "s.sync_pin", "s.track_length", "s.trial_length", F.col("s.reward.id").alias("reward_id"), F.col("s.reward.pin").alias("reward_pin"), F.map_from_entries(pins).alias("valves"))


def named_actions(found: DataFrame, about: DataFrame, key: str = "file") -> DataFrame:
    """Actions under all their names: a valve by the context that it belongs to (``pin_<n>`` if none), the reward's valve as
    ``water`` too, and the reward's context as ``reward`` too.

    ``found`` has key, kind, id, pin, t, action; ``about`` is ``settings``, one row per log.
    """
    rows = found.join(about.select(key, "reward_id", "reward_pin", "valves"), key, "left")
    of_pin = F.coalesce(F.element_at("valves", F.col("pin")), F.concat(F.lit("pin_"), F.col("pin").cast("string")))
    name = F.when(F.col("kind") == "valve", of_pin).when(F.col("kind") == "tone", F.concat(F.lit("tone_"), F.col("pin").cast("string"))).when(F.col("kind") == "lick", F.lit("licking")).otherwise(F.col("id"))
    more = F.when((F.col("kind") == "valve") & (F.col("pin") == F.col("reward_pin")), F.lit("water")).when((F.col("kind") == "context") & (F.col("id") == F.col("reward_id")) & (F.col("id") != "reward"), F.lit("reward"))
    return rows.withColumn("name", F.explode(F.array_compact(F.array(name, more)))).select(key, "name", "t", "action")


def every_action(messages: DataFrame, key: str = "file") -> DataFrame:
    """Start and stop messages of all kinds: key, kind, id, pin, t, action; one pass over the messages."""

    def one(kind: str):
        m = F.col(f"behavior_controller.{kind}")
        action = F.when(m["action"].isin("start", "open"), "start").when(m["action"].isin("stop", "close"), "stop")
        return F.when(action.isNotNull(), F.struct(F.lit(kind).alias("kind"), m["id"].alias("id"), m["pin"].alias("pin"), action.alias("action")))

    found = messages.select(key, F.col("time").alias("t"), F.explode(F.array_compact(F.array(*(one(k) for k in ("context", "valve", "tone", "lick"))))).alias("x"))
    return found.select(key, "x.kind", "x.id", "x.pin", "t", "x.action")


def sync_offset(intervals: DataFrame, key: str = "file", backup: str = "AOD_sync_pin", pin: str = "sync_pin") -> DataFrame:
    """(key, zero): the time at which imaging started, from intervals (key, name, onset, offset).

    The first interval of ``backup`` ends there; without one, the first of ``pin`` starts there, or 0.1 s before its
    end if the start is missing; 0 if nothing is known.
    """
    first = lambda n: F.min_by(F.struct("onset", "offset"), F.when(F.col("name") == n, F.coalesce("onset", "offset")))
    got = intervals.groupBy(key).agg(first(backup).alias("_a"), first(pin).alias("_p"))
    return got.select(key, F.coalesce(F.col("_a.offset"), F.col("_p.onset"), F.col("_p.offset") - 0.1, F.lit(0.0)).alias("zero"))


def synchronised(rows: DataFrame, zero: DataFrame, columns: list[str], key: str = "file") -> DataFrame:
    """``rows`` with the times in ``columns`` counted from their log's zero."""
    return rows.join(zero, key, "left").withColumns({c: F.col(c) - F.coalesce("zero", F.lit(0.0)) for c in columns}).drop("zero")


def updates(messages: DataFrame, key: str = "file") -> DataFrame:
    """Position updates: key, t, dy, dt, millis."""
    p = F.col("position_controller.position")
    return messages.where("position_controller is not null").select(key, F.col("time").alias("t"), p["dy"].alias("dy"), p["dt"].alias("dt"), F.col("position_controller.millis").alias("millis"))


def whole_updates(found: DataFrame, key: str = "file", order: str = "millis") -> DataFrame:
    """Updates without gaps: a movement without a time is added to the next update that has one, and goes.

    Updates without a time at the end have nothing to be added to, and go too.
    """
    w = Window.partitionBy(key).orderBy(order)
    group = F.sum(F.when(F.col("t").isNotNull(), 1).otherwise(0)).over(w) - F.when(F.col("t").isNotNull(), 1).otherwise(0)
    return found.withColumn("_g", group).groupBy(key, "_g").agg(F.max("t").alias("t"), F.sum("dy").alias("dy"), F.max(F.when(F.col("t").isNotNull(), F.col("dt"))).alias("dt"), F.max(F.when(F.col("t").isNotNull(), F.col(order))).alias(order)).where("t is not null").drop("_g")


def filled_positions(samples: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """Positions with a sample put in where an update began later than the one before it ended: it has the next position.

    An update covers the time from t - dt / 100 to t.
    """
    from ..operators.intervals import as_of

    w = Window.partitionBy(key).orderBy("t")
    begins = found.select(key, "t", (F.col("t") - F.col("dt") * 0.01).alias("_b")).withColumn("_p", F.lag("t").over(w)).where("_p < _b").select(key, F.col("_b").alias("t"))
    # the next sample is the latest one before, seen in reversed time
    back = as_of(begins.withColumn("t", -F.col("t")), samples.select(key, (-F.col("t")).alias("t"), "position"), "position", [key])
    return samples.select(key, "t", "position").unionByName(back.where("position is not null").select(key, (-F.col("t")).alias("t"), "position"))


def repaired_by_length(intervals: DataFrame, keys: list[str], total: float, fixed: float | None = None) -> DataFrame:
    """Intervals with a missing end set from the other by the mean length of those of the same keys (or ``fixed``), where that stays inside the log."""
    mean = F.lit(fixed) if fixed is not None else F.avg(F.col("offset") - F.col("onset")).over(Window.partitionBy(*keys))
    rows = intervals.withColumn("_m", mean)
    offset = F.when(F.col("offset").isNull() & (F.col("onset") + F.col("_m") < total), F.col("onset") + F.col("_m")).otherwise(F.col("offset"))
    onset = F.when(F.col("onset").isNull() & (F.col("offset") - F.col("_m") > 0), F.col("offset") - F.col("_m")).otherwise(F.col("onset"))
    return rows.withColumn("_o", onset).withColumn("offset", offset).withColumn("onset", F.col("_o")).drop("_o", "_m")


def repaired_by_position(intervals: DataFrame, samples: DataFrame, centre: float, radius: float, keys: list[str]) -> DataFrame:
    """Intervals whose missing offset is the first time after the onset at which the animal is over ``radius`` (a share of the track)
    away from ``centre``, and whose missing onset is the last such time before the offset.
    """
    away = F.abs(F.col("position") - centre)
    out = samples.where(F.least(away, 1 - away) > radius).select(*keys, "t")
    w = Window.partitionBy(*keys).orderBy("t", "_side")
    ends = intervals.withColumn("_id", F.monotonically_increasing_id())
    marks = ends.select(*keys, F.coalesce("onset", "offset").alias("t"), "onset", "offset").withColumn("_side", F.lit(1))
    other = out.select(*keys, "t", F.lit(None).cast("double").alias("onset"), F.lit(None).cast("double").alias("offset"), F.lit(0).alias("_side"))
    both = marks.unionByName(other).withColumn("_out", F.when(F.col("_side") == 0, F.col("t")))
    both = both.withColumn("_before", F.last("_out", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_out", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return both.where("_side = 1").select(*keys, F.coalesce("onset", "_before").alias("onset"), F.coalesce("offset", "_after").alias("offset"))


def discretised(positions_: DataFrame, movement: DataFrame, intervals: DataFrame, dt: float, total: float, keys: list[str], names: list[str], sigma: float | None = None, discard_pre: float = 0.0, discard_post: float = 0.0, first_lap: bool = False) -> DataFrame:
    """Behaviour by frame of ``dt`` seconds, in one plan: keys, frame, t, position, velocity, lap, and one flag for each of ``names``.

    Position is held from its latest sample, velocity is the movement (t, dy) of each frame over ``dt``, smoothed with a
    kernel of 8 ``sigma`` frames, flags say whether an interval covers the frame. Frames of the first
    ``discard_pre`` and last ``discard_post`` seconds are left out, with ``first_lap`` all before lap 1.
    """
    from ..operators.spatial import smooth_same

    n = int(total / dt)
    grid = positions_.select(*keys).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("frame") * F.lit(dt))
    out = hold(positions_.select(*keys, "t", F.col("position").alias("value")), grid, keys).withColumnRenamed("value", "position")
    moved = movement.where("t >= 0").groupBy(*keys, F.floor(F.col("t") / F.lit(dt)).cast("int").alias("frame")).agg((F.sum("dy") / F.lit(dt)).alias("value"))
    speed = grid.select(*keys, "frame").join(moved, [*keys, "frame"], "left").na.fill(0.0, ["value"])
    if sigma:
        speed = smooth_same(speed, keys, sigma, order=("frame",)).drop("value").withColumnRenamed("smoothed", "value")
    out = out.join(speed.withColumnRenamed("value", "velocity"), [*keys, "frame"])
    flags = interval_frames(intervals.where(F.col("name").isin(names)), dt, total, [*keys, "name"]).groupBy(*keys, "frame").pivot("name", names).agg(F.lit(True))
    out = laps(out.join(flags, [*keys, "frame"], "left").na.fill(False, names), keys)
    out = out.where((F.col("t") >= discard_pre) & (F.col("t") < total - discard_post))
    return out.where("lap > 0") if first_lap else out


def positions(messages: DataFrame, track: float, key: str = "file") -> DataFrame:
    """Positions as a share of the track, from time 0 on; a file whose first position is later starts with it at 0."""
    found = messages.where("y is not null and time >= 0").select(key, F.col("time").alias("t"), F.pmod(F.col("y") / F.lit(track), F.lit(1.0)).alias("position"))
    first = found.groupBy(key).agg(F.min("t").alias("t"), F.min_by("position", "t").alias("position")).where("t > 0")
    return found.unionByName(first.select(key, F.lit(0.0).alias("t"), "position"))


def actions(messages: DataFrame, kind: str, key: str = "file") -> DataFrame:
    """Start and stop messages of one kind: key, name, t, action (``open`` and ``close`` count as start and stop)."""
    m = F.col(f"behavior_controller.{kind}")
    name = F.coalesce(m["id"], m["pin"].cast("string"), F.lit(kind))
    action = F.when(m["action"].isin("start", "open"), "start").when(m["action"].isin("stop", "close"), "stop")
    return messages.where(m.isNotNull()).select(key, name.alias("name"), F.col("time").alias("t"), action.alias("action")).where("action is not null")


def velocity(messages: DataFrame, dt: float, key: str = "file", sigma: float | None = None) -> DataFrame:
    """Movement per second in bins of ``dt`` seconds, 0 where no update came; with ``sigma`` (seconds), smoothed over as many whole frames as cover it."""
    from ..operators.signals import smoothed_velocity

    d = messages.where("position_controller is not null").select(key, F.floor(F.col("time") / F.lit(dt)).cast("int").alias("frame"), F.col("position_controller.position.dy").alias("dy"))
    sums = d.groupBy(key, "frame").agg(F.sum("dy").alias("dy"))
    spine = sums.groupBy(key).agg(F.max("frame").alias("m")).select(key, F.explode(F.sequence(F.lit(0), "m")).alias("frame"))
    found = spine.join(sums, [key, "frame"], "left").select(key, "frame", (F.coalesce("dy", F.lit(0.0)) / F.lit(dt)).alias("velocity"))
    return found if sigma is None else smoothed_velocity(found, [key], dt, sigma, whole=True)


def shuffled_cues(intervals: DataFrame, keys: list[str], total: float, seed: int = 0) -> DataFrame:
    """Cues dealt anew: the intervals of each group keep their lengths and their order is drawn by hash, and the gaps between them likewise.

    Starts and ends stay inside [0, total], no two cues overlap. Cues that miss an end go; a group's cues must not overlap to begin with.
    """
    w = Window.partitionBy(*keys)
    rows = intervals.where("onset is not null and offset is not null").withColumn("_i", F.row_number().over(w.orderBy("onset", "offset"))).withColumn("_n", F.count(F.lit(1)).over(w))
    before = F.coalesce(F.lag("offset").over(w.orderBy("_i")), F.lit(0.0))
    rows = rows.withColumn("_gap", F.col("onset") - before).withColumn("_long", F.col("offset") - F.col("onset")).withColumn("_end", F.lit(float(total)) - F.max("offset").over(w))
    # n + 1 gaps stand before, between and behind n cues; the last one is dealt with the others
    gaps = rows.select(*keys, "_i", "_gap").unionByName(rows.where("_i = _n").select(*keys, (F.col("_i") + 1).alias("_i"), F.col("_end").alias("_gap")))
    drawn = lambda what: F.row_number().over(w.orderBy(F.xxhash64(F.lit(f"{seed} {what}"), *keys, "_i"), "_i"))
    gaps = gaps.withColumn("_to", drawn("gap")).select(*keys, F.col("_to").alias("_i"), "_gap")
    cues = rows.withColumn("_to", drawn("cue")).drop("_i", "_gap", "_n", "_end", "onset", "offset").withColumnRenamed("_to", "_i")
    upto = w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    met = cues.join(gaps, [*keys, "_i"]).withColumn("offset", F.sum(F.col("_gap") + F.col("_long")).over(upto)).withColumn("onset", F.col("offset") - F.col("_long"))
    return met.select(*intervals.columns)


def interval_frames(intervals: DataFrame, dt: float, total: float, keys: list[str]) -> DataFrame:
    """Frames that intervals (onset, offset) cover, both ends' frames included; a missing end is the log's."""
    last = int(total / dt) - 1
    a, b = F.floor(F.coalesce("onset", F.lit(0.0)) / F.lit(dt)).cast("int"), F.floor(F.coalesce("offset", F.lit(total)) / F.lit(dt)).cast("int")
    rows = intervals.select(*keys, F.greatest(a, F.lit(0)).alias("a"), F.least(b, F.lit(last)).alias("b")).where("a <= b")
    return rows.select(*keys, F.explode(F.sequence("a", "b")).alias("frame")).distinct()


def hold(samples: DataFrame, grid: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Zero-order hold: the latest sample at or before each grid time; the last one where there is none before."""
    from ..operators.intervals import as_of

    out = as_of(grid, samples, value, keys, strict=False)
    last = samples.groupBy(*keys).agg(F.max_by(value, "t").alias("_last"))
    return out.join(last, keys, "left").withColumn(value, F.coalesce(value, "_last")).drop("_last")


def laps(samples: DataFrame, keys: list[str], drop: float = 0.75, before: bool = False) -> DataFrame:
    """Adds ``lap``: a fall of position by over ``drop`` from a sample to the next starts a new one.

    ``before``: the sample right before the fall is the new lap's first.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    step = (F.lead("position").over(w) - F.col("position")) if before else (F.col("position") - F.lag("position").over(w))
    fell = (step < -drop).cast("int")
    return samples.withColumn("_f", F.coalesce(fell, F.lit(0))).withColumn("lap", F.sum("_f").over(w).cast("int")).drop("_f")
