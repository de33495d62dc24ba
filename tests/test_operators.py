"""Operators on hand fixtures, and those that SQL doesn't express."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import aggregates, catalog, intervals, models, rolling, signals, simulate, spatial
from spindrift.plans import population
from spindrift.sources import behaviour_log
from spindrift.sources.store import Exists, Store, split_batch
from spindrift.streaming import events as stream_events


def trace(spark, values, name="value", roi=1):
    return spark.createDataFrame([(roi, i, float(v) if v is not None else None) for i, v in enumerate(values)], f"roi int, frame int, {name} double")


def ordered(df, key, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy(key).collect()]


def test_runs(spark):
    df = trace(spark, [0, 1, 1, 0, 1])
    assert ordered(intervals.runs(df, F.col("value") > 0, ["roi"]), "onset", "onset", "offset") == [(1, 3), (4, 5)]


def test_circular_runs(spark):
    df = trace(spark, [1, 0, 0, 1, 0, 1])
    assert ordered(intervals.runs(df, F.col("value") > 0, ["roi"], circular=6), "onset", "onset", "offset") == [(3, 4), (5, 1)]


def test_hysteresis(spark):
    df = trace(spark, [0, 1, 3, 2.5, 0.6, 0.4, 0, 2.1, 2.2, 0.2, 5, 1])
    assert ordered(intervals.hysteresis(df, "value", 2, 0.5, ["roi"]), "onset", "onset", "offset") == [(1, 4), (6, 8)]


def test_find_first_n(spark):
    df = trace(spark, [0, 1, 0, 0, 1, 0, 1]).withColumn("f", F.col("value") > 0)
    assert rolling.find_first_n(df, "f", 2, 3, ["roi"], "frame", "x").first()["x"] == 4


def test_centred_windows(spark):
    df = trace(spark, [5, 3, 4, 1, 2, 6])
    assert ordered(rolling.rolling(df, "min", "value", 4, "r", ["roi"]), "frame", "r") == [3, 3, 1, 1, 1, 1]
    assert ordered(rolling.rolling(df, "quantile", "value", 3, "r", ["roi"], q=0.25), "frame", "r") == [3.5, 3.5, 2.0, 1.5, 1.5, 3.0]


def test_wide_gaussian_equals_narrow_one(spark, monkeypatch):
    df = trace(spark, [math.sin(i) if i % 7 else None for i in range(60)])
    a = ordered(rolling.gaussian_rolling(df, "value", 10, 2, "s", ["roi"]), "frame", "s")
    monkeypatch.setattr(rolling, "LAGGED", 0)
    b = ordered(rolling.gaussian_rolling(df, "value", 10, 2, "s", ["roi"]), "frame", "s")
    assert np.allclose(a, b)


def test_information(spark):
    c = spark.createDataFrame([(k, i, float(v)) for k, vs in ((1, [0, 0, 4, 0]), (2, [1, 2, 3, 2])) for i, v in enumerate(vs)], "roi int, bin int, value double")
    got = ordered(spatial.information(c, ["roi"]), "roi", "skaggs", "entropy", "tuning_score")
    assert got[0][0] == 2.0 and abs(got[1][0] - 0.0943609377704) < 1e-12 and abs(got[1][1] - 1.9056390622296) < 1e-12 and abs(got[1][2] - 0.0943609377704) < 1e-12


def test_centre_and_autocorrelation(spark):
    c = trace(spark, [0, 1, 3, 1, 0]).withColumnRenamed("frame", "bin")
    assert spatial.centres(c, ["roi"], 5).first()["com"] == 2.0
    a = trace(spark, [1, 2, 4, 1]).withColumnRenamed("frame", "bin")
    assert np.allclose(ordered(spatial.autocorrelation(a, ["roi"], 2), "lag", "acf"), [-2 / 3, -1 / 6, 1, -1 / 6, -2 / 3])


def test_bins(spark):
    df = spark.createDataFrame([(0.25,), (0.0,)], "p double")
    assert [tuple(r) for r in df.select(spatial.bin_floor(F.col("p"), 4), spatial.bin_left(F.col("p"), 4)).collect()] == [(1, 0), (0, -1)]


def test_smoothing_equals_convolution(spark):
    v = np.random.default_rng(1).random(20)
    c = trace(spark, v).withColumnRenamed("frame", "bin")
    for m in (8, 9):
        got = ordered(spatial.smooth_same(c, ["roi"], 1.0, m), "bin", "smoothed")
        assert np.allclose(got, np.convolve(v, spatial.gaussian_kernel(m, 1.0), "same"))


def test_filters(spark):
    df = spark.createDataFrame([(x,) for x in "abcd"], "k string")
    a, b = catalog.Filter(F.col("k").isin("a", "b")), catalog.Filter(F.col("k").isin("b", "c"))
    keep = lambda f: "".join(sorted(r["k"] for r in f.keep(df).collect()))
    assert [keep(f) for f in (a & b, a | b, ~a, a ^ b, a - b, a.and_not(b))] == ["b", "abc", "cd", "ac", "abd", "a"]
    assert keep(~(a & b)) == keep(~a | ~b)


def test_place_fields_follow_their_parts(spark):
    rows = [(1, lap * 20 + b, lap, b / 20, 5.0 if 6 <= b < 9 else 0.1) for lap in range(10) for b in range(20)]
    df = spark.createDataFrame(rows, "roi int, frame int, lap int, position double, value double")
    got = [tuple(r) for r in spatial.place_fields(df, ["roi"], "lap", 20, 30, 0.05).collect()]
    assert got == [(1, 6, 9, 3, 10)]


def test_oasis_recovers_spikes(spark):
    g, spikes = 0.9, np.zeros(80)
    spikes[[10, 30, 31, 60]] = [2, 1, 3, 1.5]
    y = np.zeros(80)
    for t in range(1, 80):
        y[t] = g * y[t - 1] + spikes[t]
    got = ordered(signals.oasis_ar1(trace(spark, y), ["roi"], g), "frame", "spikes")
    assert np.allclose(got, spikes, atol=1e-9)
    noisy = y + np.random.default_rng(0).normal(0, 0.2, 80)
    assert min(ordered(signals.oasis_ar1(trace(spark, noisy), ["roi"], g), "frame", "spikes")) >= 0


@pytest.mark.parametrize("kind", ["poisson", "bernoulli"])
def test_hmm_recovers_states(spark, kind):
    rng, rows, truth = np.random.default_rng(2), [], {}
    for roi in range(6):
        s = 0
        for t in range(150):
            s = s if rng.random() < 0.95 else 1 - s
            x = rng.poisson((1, 9)[s]) if kind == "poisson" else int(rng.random() < (0.05, 0.95)[s])
            rows.append((roi, t, int(x)))
            truth[roi, t] = s
    df = spark.createDataFrame(rows, "roi int, frame int, x int")
    short = models.hmm(df, "x", ["roi"], 2, rounds=1, kind=kind)
    model = models.hmm(df, "x", ["roi"], 2, rounds=8, kind=kind)
    assert model["log_likelihood"] >= short["log_likelihood"]
    path = models.decode(df, model, "x", ["roi"]).collect()
    assert np.mean([truth[r["roi"], r["frame"]] == r["state"] for r in path]) > 0.93
    bic, aic = models.criteria(-10.0, 2, 100)
    assert aic == 28.0 and bic > aic


def test_factorisation_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.random((30, 2)) @ np.abs(rng.normal(size=(2, 8)))
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(8)], "roi int, bin int, value double")
    w, h = models.factorise(df, "roi", "bin", "value", 2, rounds=40)
    w = np.array([r["w"] for r in w.orderBy("roi").collect()])
    assert (w >= 0).all() and (h >= 0).all() and np.allclose(h.max(axis=1), 1)
    assert np.linalg.norm(w @ h - x) < 0.05 * np.linalg.norm(x)


def test_assignment_is_the_best(spark):
    d = np.random.default_rng(4).random((5, 6))
    df = spark.createDataFrame([(1, i, j, float(d[i, j])) for i in range(5) for j in range(6)], "f int, a int, b int, distance double")
    got = models.assigned(df, ["f"], 2.0).collect()
    best = min(sum(d[i, p[i]] for i in range(5)) for p in itertools.permutations(range(6), 5))
    assert len(got) == 5 and abs(sum(r["distance"] for r in got) - best) < 1e-9


def test_clusters(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10, float(i % 2)) for i in range(20)], "roi int, u double, v double")
    assert {(r["roi"] % 2, r["cluster"]) for r in models.kmeans(df, ["u", "v"], 2).collect()} == {(0, 0), (1, 1)}


def test_cumulants_and_histogram(spark):
    x = [1, 2, 3, 4, 9]
    got = aggregates.cumulants(trace(spark, x), "value", ["roi"]).first()
    assert abs(got["k2"] - np.var(x, ddof=1)) < 1e-9
    assert ordered(aggregates.histogram(trace(spark, x), "value", 1, 9, 4, ["roi"]), "bin", "n") == [2, 2, 0, 1]


def test_simulation(spark):
    fields = simulate.drifting_fields(spark, 3, 4, 30, step=2.0, first_lap=1)
    stats = population.first_lap_statistics(fields.where("roi = 1"), ["roi"])
    assert stats.first()["first_lap"] == 1
    cells = spark.createDataFrame([(1, 10.0)], "roi int, centre double")
    n = simulate.spikes(simulate.rates(cells, 40), 200, 0.05).groupBy("bin").agg(F.sum("spike").alias("n")).orderBy(F.desc("n")).first()
    assert 7 <= n["bin"] <= 13


def test_log_reader(spark, tmp_path):
    lines = [
        {"time": 0.5, "y": 100.0}, {"time": 1.0, "y": 450.0}, {"time": 0.1, "position_controller": {"position": {"dy": 5.0, "dt": 0.1}, "millis": 1}}, {"time": 1.2, "position_controller": {"position": {"dy": 3.0, "dt": 0.1}, "millis": 2}},
        {"time": 0.2, "behavior_controller": {"lick": {"action": "start"}}}, {"time": 0.4, "behavior_controller": {"lick": {"action": "stop"}}}, {"time": 0.9, "behavior_controller": {"valve": {"pin": 5, "action": "open"}}},
    ]
    (tmp_path / "a.log").write_text("\n".join([*map(json.dumps, lines), "broken"]))
    m = behaviour_log.read_log(spark, str(tmp_path))
    assert m.count() == 7
    assert ordered(behaviour_log.positions(m, 400.0), "t", "t", "position") == [(0.0, 0.25), (0.5, 0.25), (1.0, 0.125)]
    licks = intervals.paired(behaviour_log.actions(m, "lick"), "action", "start", "stop", ["file", "name"])
    assert ordered(licks, "onset", "onset", "offset") == [(0.2, 0.4)]
    assert ordered(behaviour_log.actions(m, "valve"), "t", "name", "action") == [("5", "start")]
    assert ordered(behaviour_log.velocity(m, 0.5), "frame", "velocity") == [10.0, 0.0, 6.0]
    iv = spark.createDataFrame([(1, 0.2, 0.4)], "k int, onset double, offset double")
    assert ordered(behaviour_log.interval_frames(iv, 0.1, 1.0, ["k"]), "frame", "frame") == [2, 3, 4]


def test_zero_order_hold(spark):
    s = spark.createDataFrame([(1, 1.0, 0.1), (1, 3.0, 0.5)], "k int, t double, value double")
    g = spark.createDataFrame([(1, float(t)) for t in range(5)], "k int, t double")
    assert ordered(behaviour_log.hold(s, g, ["k"]), "t", "value") == [0.5, 0.1, 0.1, 0.5, 0.5]


def test_store(spark, tmp_path):
    store, df = Store(spark, str(tmp_path)), trace(spark, range(6))
    store.write(df, "green", "v1", "raw")
    with pytest.raises(Exists):
        store.write(df, "green", "v1", "raw")
    out = store.calculate(lambda x: rolling.zscore(x, "value", "z", ["roi"]), ("green", "v1", "raw"), "z")
    assert out.count() == 6 and store.read("green", "v1", "raw", 3).count() == 3
    calls = []
    make = lambda: calls.append(1) or df
    assert store.cached("x", {"b": 1, "a": 2}, make).count() == store.cached("x", {"a": 2, "b": 1}, make).count() == 6 and calls == [1]
    assert store.split(("green", "v1", "raw"), df.select("roi").limit(1), "v2").count() == 6
    kids = split_batch(df, spark.createDataFrame([("a", 2, 0), ("b", 4, 1)], "child string, n_frames int, place int"))
    assert ordered(kids.where("child = 'b'"), "frame", "frame", "value") == [(0, 2.0), (1, 3.0), (2, 4.0), (3, 5.0)]


def test_streams(spark, tmp_path):
    rows = [(1, 0.0, "start"), (1, 1.0, "stop"), (2, 0.5, "start"), (2, 2.0, "stop"), (1, 3.0, "stop"), (1, 4.0, "start")]
    spark.createDataFrame(rows, "roi int, t double, action string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("roi int, t double, action string").parquet(str(tmp_path / "in"))
    q = stream_events.paired_stream(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert ordered(spark.table("pairs"), "roi", "roi", "onset", "offset") == [(1, 0.0, 1.0), (2, 0.5, 2.0)]
    batch = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 07:00:00", "a", 2.0)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert ordered(stream_events.windowed(batch), "start", "n", "value") == [(1, 1.0), (1, 2.0)]


def test_smoothing_across_laps(spark):
    v = np.random.default_rng(5).random(24)
    rows = spark.createDataFrame([(1, i // 8, i % 8, float(x)) for i, x in enumerate(v)], "roi int, lap int, bin int, value double")
    got = [r["smoothed"] for r in spatial.smooth_same(rows, ["roi"], 1.0, 8, ("lap", "bin")).orderBy("lap", "bin").collect()]
    assert np.allclose(got, np.convolve(v, spatial.gaussian_kernel(8, 1.0), "same"))


def test_downsampling_keeps_slow_waves(spark):
    t = np.arange(130)
    got = signals.downsampled(trace(spark, np.sin(2 * np.pi * t * 2 / 128)), ["roi"], 4)
    y = np.array(ordered(got, "frame", "value"))
    assert len(y) == 32 and np.corrcoef(y, np.sin(2 * np.pi * np.arange(32) * 2 / 32))[0, 1] > 0.99


def test_second_order_deconvolution(spark):
    s = np.zeros(100)
    s[[10, 50]] = [2.0, 1.0]
    k = (0.9 ** np.arange(1, 101) - 0.5 ** np.arange(1, 101)) / 0.4
    got = np.array(ordered(signals.oasis_ar2(trace(spark, np.convolve(s, k)[:100]), ["roi"], 0.9, 0.5), "frame", "spikes"))
    assert (got >= 0).all() and np.abs(np.convolve(got, k)[:100] - np.convolve(s, k)[:100]).max() < 0.05 and got.argmax() == 10


def test_duration_thresholds(spark):
    up = spark.createDataFrame([(0, d, 10) for d in range(4)], "a int, d int, n long")
    down = spark.createDataFrame([(0, 0, 10), (0, 1, 4), (0, 2, 0), (0, 3, 0)], "a int, d int, n long")
    assert abs(signals.duration_thresholds(up, down, 0.2).first()["duration"] - 1.5 / 4) < 1e-9
