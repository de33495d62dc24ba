"""A store of signals and results as partitioned Parquet, with an overwrite policy and a cache by parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged

KEYS = ["channel", "label", "signal_type"]


def _as_value(df: DataFrame, column: str) -> DataFrame:
    return df if column not in df.columns else df.drop("value").withColumnRenamed(column, "value")


class Exists(ValueError):
    """Raised instead of overwriting."""


class Store:
    """Signals below one path, partitioned by channel, label and type."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, channel: str, label: str, signal_type: str) -> str:
        return f"{self.path}/signals/channel={channel}/label={label}/signal_type={signal_type}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, signals: DataFrame, channel: str, label: str, signal_type: str, overwrite: bool = False) -> None:
        """Save one type of signals; refuses to replace what is there unless ``overwrite``."""
        at = self._at(channel, label, signal_type)
        if self._exists(at) and not overwrite:
            raise Exists(at)
        signals.write.mode("overwrite").parquet(at)

    def read(self, channel: str, label: str, signal_type: str, max_frame: int | None = None) -> DataFrame:
        out = self.spark.read.parquet(self._at(channel, label, signal_type))
        return out if max_frame is None else out.where(F.col("frame") < max_frame)

    def calculate(self, strategy: Callable[[DataFrame], DataFrame], source: tuple[str, str, str], to_type: str, overwrite: bool = False) -> DataFrame:
        """Apply an operator to stored signals and save the result as another type."""
        self.write(strategy(self.read(*source)), source[0], source[1], to_type, overwrite)
        return self.read(source[0], source[1], to_type)

    def cached(self, name: str, params: dict, compute: Callable[[], DataFrame], load: bool = True) -> DataFrame:
        """The saved result of these parameters, computed and saved if there is none."""
        key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()
        at = f"{self.path}/cache/{name}/{key}"
        if not (load and self._exists(f"{at}/_SUCCESS")):
            compute().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def split(self, source: tuple[str, str, str], rois: DataFrame, to_label: str, rest: bool = False, overwrite: bool = False) -> DataFrame:
        """Move the signals of ``rois`` (or of all others) to a new label."""
        chosen = self.read(*source).join(rois.select("roi"), "roi", "left_anti" if rest else "left_semi")
        self.write(chosen, source[0], to_label, source[2], overwrite)
        return self.read(source[0], to_label, source[2])

    def move(self, label: str, rois: DataFrame, to_label: str, kinds: list[tuple[str, str]], rest: bool = False, overwrite: bool = False, dry_run: bool = False) -> list[tuple[str, str]]:
        """Move ``rois`` (or all others) of a label, in all its (channel, type) ``kinds`` that exist, to a new label; which ones are moved.

        The new label is written and checked first, then the old one is put in place without them.
        """
        found = [(c, t) for c, t in kinds if self._exists(self._at(c, label, t))]
        if not overwrite and (there := [k for k in found if self._exists(self._at(k[0], to_label, k[1]))]):
            raise Exists(self._at(there[0][0], to_label, there[0][1]))
        if dry_run:
            return found
        for channel, kind in found:
            whole = self.read(channel, label, kind)
            self.write(whole.join(rois.select("roi"), "roi", "left_anti" if rest else "left_semi"), channel, to_label, kind, True)
            stay = staged(whole.join(rois.select("roi"), "roi", "left_semi" if rest else "left_anti"), "stay")
            self.write(stay, channel, label, kind, True)
        return found

    def calculate_dfof(self, strategy: Callable[[DataFrame], DataFrame], label: str, channel: str = "Ch2", source: str = "raw", overwrite: bool = False) -> DataFrame:
        """dF/F of stored raw signals, saved as type ``dfof``; the strategy's column ``dfof`` becomes the value."""
        return self.calculate(lambda df: _as_value(strategy(df), "dfof"), (channel, label, source), "dfof", overwrite)

    def infer_spikes(self, strategy: Callable[[DataFrame], DataFrame], label: str, channel: str = "Ch2", source: str = "dfof", overwrite: bool = False) -> DataFrame:
        """Spikes of stored dF/F, saved as type ``spikes``; the strategy's column ``spikes`` becomes the value."""
        return self.calculate(lambda df: _as_value(strategy(df), "spikes"), (channel, label, source), "spikes", overwrite)

    def write_events(self, events: DataFrame, label: str, event_type: str, channel: str, overwrite: bool = False) -> None:
        """Save one type of events (with onset and offset)."""
        at = f"{self.path}/events/label={label}/event_type={event_type}/channel={channel}"
        if self._exists(at) and not overwrite:
            raise Exists(at)
        events.write.mode("overwrite").parquet(at)

    def events(self, event_type: str, signal_type: str = "imaging", label: str = "suite2p", channel: str = "Ch2", times: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
        """Events by where they come from: stored ones of ``imaging`` or ``lfp``, or runs of a stored ``behavior`` variable.

        With ``times`` (keys, frame, t) onsets and offsets are given in seconds.
        """
        if signal_type == "behavior":
            from ..operators.intervals import runs

            rows = self.behaviour(event_type)
            found = runs(rows, F.coalesce(F.col("value") > 0, F.lit(False)), keys or [], "frame") if keys else runs(rows.withColumn("_one", F.lit(0)), F.col("value") > 0, ["_one"], "frame").drop("_one")
        elif signal_type in ("imaging", "lfp"):
            found = self.spark.read.parquet(f"{self.path}/events/label={label}/event_type={event_type}/channel={channel}")
        else:
            raise ValueError(f"events come from imaging, lfp or behavior, not {signal_type}")
        if times is None:
            return found
        on = lambda c: times.select(*(keys or []), F.col("frame").alias(c), F.col("t").alias(f"_{c}"))
        placed = found.join(on("onset"), [*(keys or []), "onset"], "left").join(on("offset"), [*(keys or []), "offset"], "left")
        return placed.withColumn("onset", F.col("_onset")).withColumn("offset", F.col("_offset")).drop("_onset", "_offset")

    def write_behaviour(self, frames: DataFrame, overwrite: bool = False) -> None:
        """Save behaviour by frame, one column to a variable."""
        at = f"{self.path}/behaviour"
        if self._exists(at) and not overwrite:
            raise Exists(at)
        frames.write.mode("overwrite").parquet(at)

    def behaviour(self, variable: str) -> DataFrame:
        """One behaviour variable as a signal: frame (and other keys), value."""
        return behaviour_signal(self.spark.read.parquet(f"{self.path}/behaviour"), variable)

    def lfp(self, label: str, channel: str) -> DataFrame:
        """Field potentials of one label and channel."""
        return self.read(channel, label, "lfp")

    def signals(self, source: str, label: str, channel: str = "Ch2", signal_type: str = "dfof", metadata: DataFrame | None = None, zscore: bool = False, max_frame: int | None = None, times: DataFrame | None = None) -> DataFrame:
        """Signals by where they come from (imaging, lfp or behavior), with metadata of regions joined and values standardised if wanted.

        ``times`` (frame, t) adds the time of each frame; ``max_frame`` leaves later frames out.
        """
        if source == "behavior":
            out = self.behaviour(label)
        elif source in ("imaging", "lfp"):
            out = self.lfp(label, channel) if source == "lfp" else self.read(channel, label, signal_type)
        else:
            raise ValueError(f"signals come from imaging, lfp or behavior, not {source}")
        out = out if max_frame is None else out.where(F.col("frame") < max_frame)
        if zscore:
            from ..operators.rolling import zscore as standardised

            out = standardised(out, "value", "value", [c for c in out.columns if c not in ("frame", "t", "value")])
        if metadata is not None:
            out = out.join(metadata, "roi", "left")
        if times is None:
            return out
        shared = [c for c in times.columns if c != "t" and c in out.columns]  # an experiment's key too, where both have one
        return out.join(times.select(*shared, "t"), shared, "left")

    def delete_rois(self, label: str, channel: str, types: list[str], dry_run: bool = True) -> list[str]:
        """Remove a label's signals of these types; by default only say which ones are there."""
        there = [t for t in types if self._exists(self._at(channel, label, t))]
        if not dry_run:
            for t in there:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(channel, label, t))
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return there

    def export(self, path: str, source: tuple[str, str, str], behaviour: DataFrame | None = None, masks: DataFrame | None = None, overwrite: bool = False) -> None:
        """Write signals (spikes as 0 and 1), behaviour and masks of an experiment below another path, for other programs."""
        if self._exists(path) and not overwrite:
            raise Exists(path)
        signals = self.read(*source)
        binary(signals).write.mode("overwrite").parquet(f"{path}/signals") if source[2] == "spikes" else signals.write.mode("overwrite").parquet(f"{path}/signals")
        for name, df in (("behaviour", behaviour), ("masks", masks)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")


def behaviour_signal(frames: DataFrame, variable: str, keys: list[str] | None = None) -> DataFrame:
    """One column of behaviour by frame as a signal: keys, frame, value (flags as 0 and 1)."""
    return frames.select(*(keys or [c for c in ("roi", "expt_id") if c in frames.columns]), "frame", F.col(variable).cast("double").alias("value"))


def trim_to(signals: DataFrame, behaviour: DataFrame, keys: list[str]) -> DataFrame:
    """Signals up to the last frame that behaviour has."""
    last = behaviour.groupBy(*keys).agg(F.max("frame").alias("_last"))
    return signals.join(last, keys).where(F.col("frame") <= F.col("_last")).drop("_last")


def trim_to_duration(signals: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Signals of the frames that behaviour was recorded for: the first int(duration / frame_period) of each recording (keys, duration, frame_period)."""
    frames = F.floor(F.col("duration") / F.col("frame_period") + 1e-9).cast("long")
    return signals.join(recordings.select(*keys, frames.alias("_n")), keys).where(F.col("frame") < F.col("_n")).drop("_n")


def binary(spikes: DataFrame, value: str = "value") -> DataFrame:
    """Spikes as 1 where positive, 0 elsewhere."""
    return spikes.withColumn(value, (F.coalesce(F.col(value), F.lit(0.0)) > 0).cast("double"))


def registered_signals(signals: DataFrame, registered: DataFrame, frames: DataFrame) -> DataFrame:
    """Signals of one session over all registered regions (reference, roi): reference, frame, value, missing where the session lacks the region."""
    spine = registered.select("reference", "roi").join(frames.select("frame").distinct())
    return spine.join(signals.select("roi", "frame", "value"), ["roi", "frame"], "left").select("reference", "frame", "value")


def split_batch(frames: DataFrame, children: DataFrame) -> DataFrame:
    """Frames of a concatenated session as those of its children (child, n_frames, place), counted anew from 0.

    One sorted pass over the frames and the children's first frames: each frame belongs to the latest child before it.
    """
    from pyspark.sql import Window

    # children are sessions of one recording: a handful of rows
    ends = children.withColumn("_end", F.sum("n_frames").over(Window.orderBy("place"))).withColumn("_start", F.col("_end") - F.col("n_frames"))
    numbered = ends.select(*[c for c in children.columns if c not in ("n_frames", "place")], F.explode(F.sequence(F.col("_start"), F.col("_end") - 1)).alias("frame"), "_start")
    return frames.join(numbered, "frame").withColumn("frame", F.col("frame") - F.col("_start")).drop("_start")
