"""A recording written here reads back equal, block by block."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.sources import imports, recorder


def text(s):
    raw = s.encode("utf-16-le")
    return struct.pack("<I", len(raw)) + raw


def written(path, blocks=40, major=2, seed=0, sensors=1, mode=1):
    """A small file with two amplifier, one aux, one supply, two converter and two digital channels; its values."""
    rng = np.random.default_rng(seed)
    n = 128 if major >= 2 else 60
    out = struct.pack("<Ihhf", recorder.MAGIC, major, 3, 1000.0) + struct.pack("<h6fh2f", 1, *([0.5] * 6), 2, 1.0, 1.0) + text("a") + struct.pack("<I", 0xFFFFFFFF) + text("")
    out += struct.pack("<hh", sensors, mode) + (text("ref") if major >= 2 else b"") + struct.pack("<h", 3)
    groups = [("Port A", [("A-0", "left", 0, 0, 1), ("A-1", "", 1, 0, 1), ("A-2", "off", 2, 0, 0), ("AUX", "", 0, 1, 1), ("VDD", "", 0, 2, 1)]), ("Board", [("ADC-0", "sync", 0, 3, 1), ("ADC-1", "", 1, 3, 1), ("DIN-0", "", 0, 4, 1), ("DIN-3", "beam", 3, 4, 1)]), ("Empty", [])]
    for g, channels in groups:
        out += text(g) + text("x") + struct.pack("<hhh", bool(channels), len(channels), 2)
        for native, custom, order, kind, on in channels:
            out += text(native) + text(custom) + struct.pack("<6h", order, order, kind, on, 0, 0) + struct.pack("<4h2f", 0, 0, 0, 0, 1.0, 0.0)
    want = {k: [] for k in ("t", "left", "A-1", "AUX", "VDD", "temperature_1", "sync", "ADC-1", "DIN-0", "beam")}
    for b in range(blocks):
        ticks = np.arange(b * n, (b + 1) * n, dtype="<i4")
        amp, aux, vdd = rng.integers(0, 65536, (2, n), "u2"), rng.integers(0, 65536, (1, n // 4), "u2"), rng.integers(0, 65536, 1, "u2")
        temp, adc, din = rng.integers(-500, 500, sensors, "i2"), rng.integers(0, 30000, (2, n), "u2"), rng.integers(0, 16, n, "u2")
        if b >= 7:
            adc[0] = 60000
        out += ticks.tobytes() + amp.tobytes() + aux.tobytes() + vdd.tobytes() + temp.tobytes() + adc.tobytes() + din.tobytes()
        for k, v in (("t", ticks / 1000), ("left", 0.195 * (amp[0] - 32768.0)), ("A-1", 0.195 * (amp[1] - 32768.0)), ("AUX", 37.4e-6 * aux[0]), ("VDD", 74.8e-6 * vdd), ("temperature_1", temp / 100), ("sync", 152.59e-6 * (adc[0] - 32768.0)), ("ADC-1", 152.59e-6 * (adc[1] - 32768.0)), ("DIN-0", din & 1), ("beam", din >> 3 & 1)):
            want[k] += list(v)
    path.write_bytes(out + b"\0" * 17)  # a block that was cut off
    return want


@pytest.mark.parametrize("major", [1, 2])
def test_a_file_reads_back_equal_from_several_partitions(spark, tmp_path, major):
    want = written(tmp_path / "a.rhd", major=major)
    df = recorder.read_recording(spark, str(tmp_path / "a.rhd"), task_samples=1000)
    assert df.rdd.getNumPartitions() > 2
    got = df.toPandas().sort_values(["channel", "t"])
    for name, values in want.items():
        if name != "t":
            mine = got[got["channel"] == name]
            np.testing.assert_allclose(mine["value"], values)
            step = len(want["t"]) // len(values)
            np.testing.assert_allclose(mine["t"], want["t"][::step])
    assert set(got["channel"]) == set(want) - {"t"}


def test_limits_and_columns_reach_the_reader(spark, tmp_path):
    want = written(tmp_path / "a.rhd")
    written(tmp_path / "b.rhd", blocks=3, seed=1)
    both = (str(tmp_path / "a.rhd"), str(tmp_path / "b.rhd"))
    columns = "t double, channel string, value double, kind string"
    got = recorder.read_recording(spark, *both, columns=columns, channels=["left", "sync"], since=1.0, until=1.5).collect()
    assert len(got) == 2 * 500
    left = sorted((r["t"], r["value"]) for r in got if r["channel"] == "left")
    np.testing.assert_allclose([v for _, v in left], want["left"][1000:1500])
    assert recorder.read_recording(spark, *both, columns=columns, kinds=["temperature"]).count() == 43
    assert recorder.read_recording(spark, *both, columns=columns, channels=["nothing"]).count() == 0
    whole = recorder.read_recording(spark, *both)
    two = whole.where("channel = 'left'").join(whole.where("channel = 'sync'"), ["file", "t"])
    assert two.count() == 43 * 128  # conditions of one side don't reach the other
    reader = recorder.RecorderReader([both[0]], ["t"], {"task_samples": "1000", "channels": "left", "since": "5.0"})
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in rows) == 120 and rows[0].schema.names == ["t"]
    with pytest.raises(Exception, match="no wrong"):
        recorder.read_recording(spark, both[0], columns="wrong int").count()


def test_lfp_begins_where_imaging_does(spark, tmp_path):
    want = written(tmp_path / "a.rhd")
    df = recorder.read_recording(spark, str(tmp_path / "a.rhd"))
    got = recorder.lfp_signals(df, "sync").toPandas()
    assert len(got) == 2 * (len(want["t"]) - 7 * 128) and got["t"].min() == 0
    wide = df.where("channel IN ('left', 'sync')").groupBy("file", "t").pivot("channel", ["left", "sync"]).agg(F.first("value"))
    same = imports.lfp_from_imaging_start(wide, ["file"], "sync").toPandas().sort_values("t")
    np.testing.assert_allclose(same["left"], got[got["channel"] == "left"].sort_values("t")["value"])


def test_what_is_no_recording_is_an_error(spark, tmp_path):
    (tmp_path / "x.rhd").write_bytes(b"\0" * 100)
    with pytest.raises(Exception, match="no recording"):
        recorder.read_recording(spark, str(tmp_path / "x.rhd")).count()
