"""Operators of behaviour, catalog, store and simulation that have no SQL, by hand and against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import catalog, intervals, masks, models, rolling, signals, simulate, spatial
from spindrift.plans import responses, tuning
from spindrift.sources import behaviour_log, store


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_offsets_of_laps_are_independent(spark):
    df = spark.range(200).select(F.col("id").alias("s")).withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("off", spatial.offsets(F.col("s"), F.col("lap"), F.lit(50).cast("long")))
    got = {(r["s"], r["lap"]): r["off"] for r in df.collect()}
    between = {(got[s, 1] - got[s, 0]) % 50 for s in range(200)}
    assert len(between) > 40 and len({tuple((got[s, k] - got[s, 0]) % 50 for k in range(10)) for s in range(200)}) == 200
    counts = np.bincount([got[s, k] for s in range(200) for k in range(10)], minlength=50)
    assert counts.min() > 15 and counts.max() < 75


def test_shuffled_rolls_each_lap(spark):
    df = spark.createDataFrame([(1, lap, f, (f % 5) / 5, float(10 * lap + f)) for lap in range(2) for f in range(5)], "roi int, lap int, frame int, position double, value double")
    got = {}
    for r in spatial.shuffled(df, ["roi"], "lap", 5, 4).collect():
        got.setdefault(r["shuffle"], []).append((r["bin"], r["value"]))
    x = lambda s, lap: (17 + 7919 * s + 104729 * lap) % 2147483647
    for s, pairs in got.items():
        want = []
        for lap in range(2):
            a = x(s, lap)
            for more in (s, lap, 12345):
                a = (a * a + more) % 2147483647
            want += [((f - a % 5) % 5, float(10 * lap + f)) for f in range(5)]
        assert sorted(pairs) == sorted(want)


def test_pairs_are_optimal(spark):
    rng = random.Random(3)
    left = [(m, i, rng.randrange(0, 3000)) for m in range(4) for i in range(4)]
    right = [(m, 100 + i, rng.randrange(0, 3000)) for m in range(4) for i in range(4)]
    frame = lambda r: spark.createDataFrame(r, "mouse int, id int, t int").select("mouse", "id", F.timestamp_seconds("t").alias("time"))
    got = catalog.pair_optimally(frame(left), frame(right), "mouse", 900.0).collect()
    for m in range(4):
        ls, rs = [(i, t) for k, i, t in left if k == m], [(i, t) for k, i, t in right if k == m]
        best = None
        for p in itertools.permutations(range(4)):
            d = [abs(ls[i][1] - rs[j][1]) for i, j in enumerate(p) if abs(ls[i][1] - rs[j][1]) <= 900]
            best = min(best, (-len(d), sum(d))) if best else (-len(d), sum(d))
        mine = [r["apart"] for r in got if r["mouse"] == m]
        assert (-len(mine), sum(mine)) == best
    assert len({(r["mouse"], r["right_id"]) for r in got}) == len(got)


def test_log_is_synchronised_and_repaired(spark):
    iv = spark.createDataFrame([("a", "sync_pin", None, 2.0), ("a", "led", 5.0, 6.0), ("b", "AOD_sync_pin", 0.5, 1.5), ("b", "sync_pin", 0.2, 0.3), ("c", "led", 1.0, 2.0)], "file string, name string, onset double, offset double")
    zero = behaviour_log.sync_offset(iv)
    assert rows(zero, "file", "zero") == [("a", 1.9), ("b", 1.5), ("c", 0.0)]
    moved = behaviour_log.synchronised(iv.where("name = 'led'"), zero, ["onset", "offset"])
    assert [(f, round(a, 6), round(b, 6)) for f, a, b in rows(moved, "file", "onset", "offset")] == [("a", 3.1, 4.1), ("c", 1.0, 2.0)]
    up = spark.createDataFrame([("a", 1.0, 2.0, 10.0, 1.0), ("a", None, 3.0, 10.0, 2.0), ("a", 3.0, 4.0, 10.0, 3.0), ("a", None, 9.0, 1.0, 4.0)], "file string, t double, dy double, dt double, millis double")
    assert rows(behaviour_log.whole_updates(up), "t", "dy", "millis") == [(1.0, 2.0, 1.0), (3.0, 7.0, 3.0)]
    samples = spark.createDataFrame([("a", 1.0, 0.1), ("a", 3.0, 0.5)], "file string, t double, position double")
    filled = behaviour_log.filled_positions(samples, behaviour_log.whole_updates(up))
    assert rows(filled, "t", "position") == [(1.0, 0.1), (2.9, 0.5), (3.0, 0.5)]
    track = spark.createDataFrame([("a", float(t), t / 10) for t in range(10)], "file string, t double, position double")
    cues = spark.createDataFrame([("a", 4.0, None), ("a", None, 5.0)], "file string, onset double, offset double")
    assert rows(behaviour_log.repaired_by_position(cues, track, 0.45, 0.2, ["file"]), "onset", "offset") == [(2.0, 5.0), (4.0, 7.0)]


def test_broken_lines_are_kept_apart(spark):
    lines = spark.createDataFrame([("a", '{"time": 1.0, "y": 2.0}'), ("a", "broken"), ("a", '{"settings": {"sync_pin": 3}}'), ("a", "")], "file string, value string")
    assert behaviour_log.parsed(lines).count() == 1 and rows(behaviour_log.broken_lines(lines), "broken") == [("broken",)]
    with pytest.raises(Exception, match="no message"):
        behaviour_log.parsed(lines, errors="raise").collect()
    assert rows(behaviour_log.settings(lines), "sync_pin") == [(3,)]


def test_discretised(spark):
    pos = spark.createDataFrame([("a", 0.0, 0.1), ("a", 0.2, 0.5), ("a", 0.4, 0.95), ("a", 0.6, 0.02)], "file string, t double, position double")
    moved = spark.createDataFrame([("a", 0.05, 1.0), ("a", 0.21, 2.0)], "file string, t double, dy double")
    iv = spark.createDataFrame([("a", "led", 0.2, 0.4)], "file string, name string, onset double, offset double")
    out = behaviour_log.discretised(pos, moved, iv, 0.1, 0.8, ["file"], ["led"]).orderBy("frame").collect()
    assert [r["position"] for r in out] == [0.1, 0.1, 0.5, 0.5, 0.95, 0.95, 0.02, 0.02]
    assert [r["velocity"] for r in out] == [10.0, 0, 20.0, 0, 0, 0, 0, 0] and [r["led"] for r in out] == [False, False, True, True, True, False, False, False]
    assert [r["lap"] for r in out] == [0] * 6 + [1] * 2
    assert behaviour_log.discretised(pos, moved, iv, 0.1, 0.8, ["file"], ["led"], first_lap=True).count() == 2


def test_walk_and_neuron(spark):
    x, n, pause, trial = 0.0, [], None, 0
    for _ in range(60):  # the animal, step by step
        n.append((x, trial))
        if pause is not None:
            pause += 0.5
            if pause >= 2.0:
                x, trial, pause = 0.0, trial + 1, None
        elif x + 0.5 * 3 > 10:
            x, pause = None, 0.0
        else:
            x += 0.5 * 3
    got = simulate.walk(spark, 60, 3.0, 10.0, 0.5, pause=2.0).orderBy("frame").collect()
    assert [(r["position"], r["trial"]) for r in got] == n
    circle = simulate.walk(spark, 10, 3.0, 10.0, 1.0).orderBy("frame").collect()
    assert [r["position"] for r in circle][:5] == [0.0, 3.0, 6.0, 9.0, 2.0]
    inputs = spark.createDataFrame([(i, float(i)) for i in range(10)], "input int, centre double")
    w = simulate.weights_after(inputs, 5.0, 3.0)
    s = w.agg(F.avg("w").alias("m"), F.stddev_pop("w").alias("s")).first()
    assert abs(s["m"]) < 1e-9 and abs(s["s"] - 1) < 1e-9 and w.orderBy(F.desc("w")).first()["input"] == 5
    rates = simulate.output_rate(simulate.input_rates(simulate.walk(spark, 40, 3.0, 10.0, 0.1), inputs, 1.0, 1.0, 10.0), w)
    assert abs(rates.agg(F.max("rate").alias("m")).first()["m"] - 30) < 1e-6


def test_reconvolution_and_subsampling(spark):
    s = [1.0 if f % 7 == 3 else 0.0 for f in range(50)]
    df = spark.createDataFrame([(1, f, v) for f, v in enumerate(s)], "roi int, frame int, spikes double")
    c = np.array(s)
    g = [np.exp(-0.1 / 0.4) + np.exp(-0.1 / 0.06), -np.exp(-0.1 / 0.4) * np.exp(-0.1 / 0.06)]
    for i in range(2, 50):
        c[i] += g[0] * c[i - 1] + g[1] * c[i - 2]
    got = [r["calcium"] for r in signals.reconvolved(df, ["roi"], 0.4, 0.06, 0.1).orderBy("frame").collect()]
    assert np.allclose(got, (c - c.mean()) / c.std())
    calm = signals.reconvolved(df, ["roi"], 0.4, 0.06, 0.1)
    fewer = simulate.subsampled(calm, 1e9, ["roi"], fs=2.0, dt=0.1)
    assert np.allclose([r["calcium"] for r in fewer.orderBy("frame").collect()], (np.array(got) - min(got))[::5], atol=1e-6)


def test_errors_by_group(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0)], "k int, v double")
    inverse = lambda pdf: pdf.assign(v=[1 / float(x) for x in pdf["v"].tolist()])
    out = signals.each_safely(df, ["k"], inverse, "k int, v double", "warn").collect()
    assert {r["k"]: (r["v"], (r["error"] or "").split(":")[0]) for r in out} == {1: (1.0, ""), 2: (None, "ZeroDivisionError")}
    assert signals.each_safely(df, ["k"], inverse, "k int, v double", "ignore").count() == 1
    with pytest.raises(Exception, match="ZeroDivisionError"):
        signals.each_safely(df, ["k"], inverse, "k int, v double").collect()


def test_store_of_events_and_behaviour(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.write_events(spark.createDataFrame([(1, 2, 5)], "roi int, onset int, offset int"), "l", "transients", "Ch2")
    with pytest.raises(store.Exists):
        s.write_events(spark.createDataFrame([(1, 2, 5)], "roi int, onset int, offset int"), "l", "transients", "Ch2")
    times = spark.createDataFrame([(f, f * 0.5) for f in range(10)], "frame int, t double")
    assert rows(s.events("transients", "imaging", "l", "Ch2", times), "onset", "offset") == [(1.0, 2.5)]
    s.write_behaviour(spark.createDataFrame([(f, f > 3 and f < 6, f / 10) for f in range(10)], "frame int, running boolean, position double"))
    assert rows(s.events("running", "behavior"), "onset", "offset") == [(4, 6)]
    assert rows(s.signals("behavior", "position", max_frame=2), "frame", "value") == [(0, 0.0), (1, 0.1)]
    s.write(spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0)], "roi int, frame int, value double"), "Ch2", "l", "spikes")
    meta = spark.createDataFrame([(1, "pyr")], "roi int, kind string")
    assert rows(s.signals("imaging", "l", signal_type="spikes", metadata=meta, times=times), "value", "kind", "t") == [(0.0, "pyr", 0.5), (0.5, "pyr", 0.0)]
    s.export(str(tmp_path / "out"), ("Ch2", "l", "spikes"))
    assert rows(spark.read.parquet(str(tmp_path / "out" / "signals")), "value") == [(0.0,), (1.0,)]
    assert s.delete_rois("l", "Ch2", ["spikes", "dfof"]) == ["spikes"] and s.read("Ch2", "l", "spikes").count() == 2
    s.delete_rois("l", "Ch2", ["spikes"], dry_run=False)
    assert s.delete_rois("l", "Ch2", ["spikes"]) == []
    reg = spark.createDataFrame([("r1", 1), ("r2", 7)], "reference string, roi int")
    sig = spark.createDataFrame([(1, 0, 2.0)], "roi int, frame int, value double")
    assert rows(store.registered_signals(sig, reg, sig), "reference", "value") == [("r1", 2.0), ("r2", None)]
    assert store.trim_to(spark.createDataFrame([(1, f) for f in range(5)], "roi int, frame int"), spark.createDataFrame([(1, 2)], "roi int, frame int"), ["roi"]).count() == 3


def test_catalog_rules(spark):
    mice = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "mouse_id int, mouse_name string")
    assert catalog.mouse_id(mice, "a") == 1
    for name in ("b", "c"):
        with pytest.raises(KeyError):
            catalog.mouse_id(mice, name)
    assert catalog.mouse_id(catalog.with_mouse(mice, "c"), "c") == 4
    trials = spark.createDataFrame([(1, 1), (2, 2)], "trial_id int, mouse_id int")
    with pytest.raises(ValueError):
        catalog.one_mouse(trials)
    assert catalog.one_mouse(trials.limit(1)).count() == 1
    df = spark.createDataFrame([(5, 1.0), (9, 2.0)], "roi int, value double")
    bound = catalog.bind_by_place(df, spark.createDataFrame([(0, "x"), (1, "y")], "place int, value string"), "roi", "kind")
    assert rows(bound, "roi", "kind") == [(5, "x"), (9, "y")]
    assert rows(catalog.bind_by_place(df, spark.createDataFrame([(0, "z")], "place int, value string"), "roi", "kind"), "kind") == [("z",), ("z",)]
    assert rows(catalog.changed(df, spark.createDataFrame([(5, 1.0), (9, 3.0)], "roi int, value double"), ["roi"]), "roi") == [(9,)]
    a, b, c = (catalog.Filter(F.col("roi") > n) for n in (4, 6, 8))
    assert rows(catalog.all_of(a, b, c).keep(df), "roi") == [(9,)] and catalog.any_of().keep(df).count() == 0 and catalog.everything().keep(df).count() == 2
    assert (~catalog.any_of(b, c)).keep(df).count() == (~b & ~c).keep(df).count() == 1


def test_blocks_positions_and_masks(spark):
    laps = spark.createDataFrame([(1, k, c) for k, c in enumerate("AABBC")], "expt int, lap int, context string")
    assert rows(intervals.merged_blocks(laps, "context", ["expt"]), "context", "start", "stop") == [("A", 0, 2), ("B", 2, 5)]
    ev = spark.createDataFrame([(1, 0.5, None), (1, 1.0, 0.26)], "k int, onset double, offset double")
    assert rows(intervals.spatial_to_bins(ev, 5), "onset", "offset") == [(2, None), (4, 1)]
    pos = spark.createDataFrame([(1, f, f / 10) for f in range(4)], "k int, frame int, position double")
    assert rows(intervals.runs_as_positions(spark.createDataFrame([(1, 0, 1, 3), (1, 1, 2, 4)], "k int, run int, onset int, offset int"), pos, ["k"]), "onset", "offset") == [(0.1, 0.3), (0.2, None)]
    px = spark.createDataFrame([(1, 0, 0), (2, 5, 5)], "roi int, y int, x int")
    moved = spark.createDataFrame([("s", 1.0, 0.0, -3.0, 0.0, 1.0, 0.0)], "session string, yy double, yx double, dy double, xy double, xx double, dx double")
    assert rows(masks.inside_bounds(px, moved, ["roi"], 8, 8), "roi") == [(2,)]
    iv = spark.createDataFrame([(1, "led", 1.0, 2.0), (1, "reward", None, 3.0)], "k int, name string, onset double, offset double")
    assert rows(responses.named_triggers(iv, "LED_off", ["k"]), "trigger") == [(2.0,)] and responses.named_triggers(iv, "Reward", ["k"]).count() == 0


def test_plateau_velocity_and_factors(spark):
    velocity = spark.createDataFrame([(1, lap, b, float(10 * lap + b)) for lap in range(4) for b in range(5)], "expt int, lap int, bin int, value double")
    fields = spark.createDataFrame([(1, 7, 1, 1, 2, 4)], "expt int, roi int, block int, first_lap int, start_bin int, stop_bin int")
    assert tuning.plateau_velocity(fields, velocity, ["expt"], "lap", {0: 0, 1: 2}).first()["plateau_velocity"] == 33.0
    made = models.mean_normalised(velocity.withColumnRenamed("expt", "roi"), ["roi"])
    assert abs(made.agg(F.avg("value").alias("m")).first()["m"] - 1) < 1e-9 and made.agg(F.count_distinct("cell").alias("n")).first()["n"] == 20
    rng = np.random.default_rng(0)
    x = rng.random((12, 2)) @ rng.random((2, 6))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(6)], "roi int, cell int, value double")
    errors = dict(rows(models.factor_errors(cells, "roi", "cell", "value", range(1, 3), 60), "rank", "error"))
    assert errors[2] < 0.1 * errors[1]


def test_long_windows_equal_short_ones(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, f, None if rng.random() < 0.1 else rng.random()) for f in range(80)], "roi int, frame int, value double")
    short = {how: rows(rolling.rolling(df, how, "value", 13, "r", ["roi"], 4, 0.2).select("frame", F.round("r", 9).alias("r")), "frame", "r") for how in ("mean", "min", "max", "median", "quantile", "std")}
    smooth = rows(rolling.gaussian_rolling(df, "value", 13, 3.0, "r", ["roi"]).select("frame", F.round("r", 9).alias("r")), "frame", "r")
    monkeypatch.setattr(rolling, "LAGGED", 5)
    for how, want in short.items():
        assert rows(rolling.rolling(df, how, "value", 13, "r", ["roi"], 4, 0.2).select("frame", F.round("r", 9).alias("r")), "frame", "r") == want, how
    assert rows(rolling.gaussian_rolling(df, "value", 13, 3.0, "r", ["roi"]).select("frame", F.round("r", 9).alias("r")), "frame", "r") == smooth


def test_dfof_of_a_users_baseline(spark):
    df = spark.createDataFrame([(1, f, float(f + 1)) for f in range(6)], "roi int, frame int, value double")
    out = signals.custom_dfof(df, lambda d: d.withColumn("baseline", F.lit(2.0)))
    assert [r["dfof"] for r in out.orderBy("frame").collect()][:2] == [-0.5, 0.0]
    both = spark.createDataFrame([(1, f, float(f + 5), 1.0) for f in range(30)], "roi int, frame int, raw double, npil double")
    assert signals.neuropil_dfof_constant(both, ["roi"], 9, 2.0).where("dfof is null").count() == 0
