"""Amplifier recordings (RHD files) as a Spark data source: blocks of one file are read by many tasks.

    recorder.read_recording(spark, "/data/day1.rhd", channels=["left"], until=60.0)

Rows are (file, t, kind, channel, value): kind is amplifier (microvolts), adc or aux (volts), supply (volts), temperature
(degrees), digital_in or digital_out (0 or 1). Limits of time, kinds and channels are options of the reader: blocks outside the time are not
read, values of other channels are not decoded. They are no pushed filters, as Spark keeps those with the table: two scans of
one DataFrame, as in a self-join, would both get the filters of the last one. A narrower schema given to the reader drops columns
before they are made.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, t double, kind string, channel string, value double"
MAGIC = 0xC6912702
#: Kinds by their number in the file's list of channels.
KINDS = ("amplifier", "aux", "supply", "adc", "digital_in", "digital_out")
#: Samples of a task.
TASK_SAMPLES = 1 << 18


@dataclass
class Header:
    """What a file says about itself, and how its blocks are laid out."""

    rate: float
    samples: int
    mode: int
    channels: dict[str, list[tuple[str, int]]]
    sensors: int
    start: int
    signed: bool
    parts: dict[str, tuple[int, int, int]] = field(default_factory=dict)  # kind to (offset in a block, channels, samples of each)
    block: int = 0

    def lay_out(self) -> Header:
        n, at = self.samples, 4 * self.samples
        for kind, count, each in (("amplifier", len(self.channels["amplifier"]), n), ("aux", len(self.channels["aux"]), n // 4), ("supply", len(self.channels["supply"]), 1), ("temperature", self.sensors, 1), ("adc", len(self.channels["adc"]), n), ("digital_in", bool(self.channels["digital_in"]), n), ("digital_out", bool(self.channels["digital_out"]), n)):
            self.parts[kind] = (at, int(count), each)
            at += 2 * int(count) * each
        self.block = at
        return self


def read_header(f) -> Header:
    """The header at the start of an open file."""

    def take(kind: str):
        got = struct.unpack("<" + kind, f.read(struct.calcsize("<" + kind)))
        return got[0] if len(got) == 1 else got

    def text() -> str:
        n = take("I")
        return "" if n == 0xFFFFFFFF else f.read(n).decode("utf-16-le")

    if take("I") != MAGIC:
        raise ValueError("no recording: the file does not begin as one")
    major, minor = take("hh")
    version = (major, minor)
    rate = take("f")
    take("h6fh2f")  # filters, notch, impedance
    for _ in range(3):
        text()  # notes
    sensors = take("h") if version >= (1, 1) else 0
    mode = take("h") if version >= (1, 3) else 0
    if major >= 2:
        text()  # reference channel
    channels: dict[str, list[tuple[str, int]]] = {k: [] for k in KINDS}
    for _ in range(take("h")):
        text(), text()
        on, count, _ = take("hhh")
        for _ in range(count if on else 0):
            native, custom = text(), text()
            order, _, kind, enabled, _, _ = take("6h")
            take("4h2f")  # triggers, impedance
            if enabled:
                channels[KINDS[kind]].append((custom or native, order))
    return Header(rate, 128 if major >= 2 else 60, mode, channels, sensors, f.tell(), version >= (1, 2)).lay_out()


def scaled(kind: str, raw: np.ndarray, mode: int) -> np.ndarray:
    """Numbers of the file in their units."""
    if kind == "amplifier":
        return 0.195 * (raw.astype(np.float64) - 32768)
    if kind == "aux":
        return 37.4e-6 * raw
    if kind == "supply":
        return 74.8e-6 * raw
    if kind == "temperature":
        return raw.astype(np.int16) / 100
    if mode == 1:
        return 152.59e-6 * (raw.astype(np.float64) - 32768)
    if mode == 13:
        return 312.5e-6 * (raw.astype(np.float64) - 32768)
    return 50.354e-6 * raw


def opened(path: str):
    """A file by path or address, wherever the machine's Arrow can read it."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return where.open_input_file(inner)


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file."""

    path: str
    first: int
    last: int

    def __hash__(self) -> int:
        return hash((self.path, self.first, self.last))


class RecorderReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], options: dict[str, str]):
        self.paths, self.columns = paths, columns
        self.task_samples = int(options.get("task_samples", TASK_SAMPLES))
        self.low, self.high = float(options.get("since", "-inf")), float(options.get("until", "inf"))
        self.only: dict[str, set[str] | None] = {c: set(options[f"{c}s"].split(",")) if f"{c}s" in options else None for c in ("kind", "channel")}

    def partitions(self) -> list[Blocks]:
        """Runs of whole blocks of each file; only headers and sizes are read here."""
        out = []
        for path in self.paths:
            with opened(path) as f:
                h = read_header(f)
                blocks = (f.size() - h.start) // h.block
            step = max(1, self.task_samples // h.samples)
            out += [Blocks(path, at, min(at + step, blocks)) for at in range(0, blocks, step)]
        return out or [Blocks("", 0, 0)]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with opened(part.path) as f:
            h = read_header(f)
            for at in range(part.first, part.last, 64):
                n = min(64, part.last - at)
                f.seek(h.start + at * h.block)
                raw = np.frombuffer(f.read(n * h.block), np.uint8).reshape(n, h.block)
                ticks = np.ascontiguousarray(raw[:, : 4 * h.samples]).view("<i4" if h.signed else "<u4")
                t = ticks / h.rate
                if t.max() < self.low or t.min() >= self.high:
                    continue
                for kind, (offset, count, each) in h.parts.items():
                    if not count or self.only["kind"] is not None and kind not in self.only["kind"]:
                        continue
                    names = [(f"temperature_{i + 1}", i) for i in range(count)] if kind == "temperature" else h.channels[kind]
                    words = np.ascontiguousarray(raw[:, offset : offset + 2 * count * each]).view("<u2").reshape(n, count, each)
                    times = t[:, :: h.samples // each].ravel() if each > 1 else t[:, 0]
                    inside = (times >= self.low) & (times < self.high)
                    for i, (name, order) in enumerate(names):
                        if self.only["channel"] is not None and name not in self.only["channel"] or not inside.any():
                            continue
                        digital = kind.startswith("digital")
                        got = words[:, 0 if digital else i].ravel()[inside]
                        value = (got >> order & 1).astype(np.float64) if digital else scaled(kind, got, h.mode)
                        made = {"file": part.path, "kind": kind, "channel": name}
                        columns = [pa.array(times[inside]) if c == "t" else pa.array(value) if c == "value" else pa.repeat(pa.scalar(made[c], pa.string()), len(value)) for c in self.columns]
                        yield pa.RecordBatch.from_arrays(columns, self.columns)


class RecorderSource(DataSource):
    """Options: path, kinds and channels (one, or several with commas), since and until (seconds, the second not included), task_samples."""

    @classmethod
    def name(cls) -> str:
        return "recorder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecorderReader:
        wrong = [f.name for f in schema.fields if f.name not in ("file", "t", "kind", "channel", "value")]
        if wrong:
            raise ValueError(f"a recording has no {', '.join(wrong)}")
        return RecorderReader(self.options["path"].split(","), [f.name for f in schema.fields], dict(self.options))


def read_recording(
    spark: SparkSession, *paths: str, columns: str = SCHEMA, kinds: list[str] | None = None, channels: list[str] | None = None, since: float | None = None, until: float | None = None, task_samples: int = TASK_SAMPLES
) -> DataFrame:
    """Rows of the recordings, of some kinds or channels, from ``since`` to before ``until`` (seconds)."""
    spark.dataSource.register(RecorderSource)
    reader = spark.read.format("recorder").schema(columns).option("task_samples", task_samples)
    for name, value in (("kinds", kinds and ",".join(kinds)), ("channels", channels and ",".join(channels)), ("since", since), ("until", until)):
        reader = reader if value is None else reader.option(name, str(value))
    return reader.load(",".join(paths))


def lfp_signals(recording: DataFrame, sync: str, level: float = 1.0) -> DataFrame:
    """(file, t, channel, value): amplifier channels from the first sample at which the ``sync`` converter exceeds ``level``, with time counted from there."""
    start = recording.where((F.col("kind") == "adc") & (F.col("channel") == sync) & (F.col("value") > level)).groupBy("file").agg(F.min("t").alias("_0"))
    rows = recording.where(F.col("kind") == "amplifier").join(start, "file").where(F.col("t") >= F.col("_0"))
    return rows.select("file", (F.col("t") - F.col("_0")).alias("t"), "channel", "value")
