"""Edges, gaps and fits of operators against small cases by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import aggregates, catalog, masks, models, records, registration, rolling, selection, signals, simulate, spatial, thresholds
from spindrift.plans import population, tuning
from spindrift.sources import behaviour_log, store


def reflected_median(x, half):
    n = len(x)
    at = lambda i: x[i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)]
    return [sum(at(j) for j in range(i - half, i + half + 1)) > half for i in range(n)]


def test_debounce_reflects_its_ends(spark):
    rng = np.random.default_rng(1)
    traces = {r: [bool(v) for v in rng.random(n) < 0.5] for r, n in enumerate((1, 2, 3, 7, 40))}
    df = spark.createDataFrame([(r, 3 * t, v) for r, x in traces.items() for t, v in enumerate(x)], "roi int, frame int, f boolean")
    for seconds in (0, 2, 4, 9):
        got = {(r["roi"], r["frame"]): r["out"] for r in rolling.debounced(df, "f", seconds, 1.0, "out", ["roi"]).collect()}
        assert got == {(r, 3 * t): v for r, x in traces.items() for t, v in enumerate(reflected_median(x, seconds // 2))}
    v = spark.createDataFrame([(1, t, x) for t, x in enumerate([4.9, 5.0, -9.0, 5.2, 5.9])], "roi int, frame int, velocity double")
    assert [r["running"] for r in rolling.running(v, ["roi"], 1.0, seconds=0).orderBy("frame").collect()] == [False, True, False, True, True]


def test_gaps_come_back_after_smoothing(spark):
    rows = [(1, 0.05 + 0.1 * b, float(b + 1)) for b in (0, 1, 4, 5, 6, 9)]
    df = spark.createDataFrame(rows, "roi int, position double, value double")
    for circular in (False, True):
        got = {r["bin"]: r["value"] for r in tuning.simple_tuning(df, ["roi"], 10, 1.0, circular).collect()}
        full = np.interp(range(10), [0, 1, 4, 5, 6, 9], [1, 2, 5, 6, 7, 10])
        k = np.array(spatial.gaussian_kernel(8, 1.0))
        want = np.convolve(np.tile(full, 3) if circular else full, k, "same")[10 * circular : 10 * circular + 10]
        assert {b for b, v in got.items() if v is None} == {2, 3, 7, 8}
        for b in (0, 1, 4, 5, 6, 9):
            assert abs(got[b] - want[b]) < 1e-9
    assert [r["value"] for r in tuning.simple_tuning(df, ["roi"], 10).orderBy("bin").collect()][2] is None


def test_smoothed_velocity(spark):
    v = [0.0, 0.1, 0.05, -0.02, 0.03, 0.0, 0.0, 0.2, 0.1]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "roi int, frame int, velocity double")
    got = [r["velocity"] for r in signals.smoothed_velocity(df, ["roi"], 0.1, 0.1, track=1000.0).orderBy("frame").collect()]
    np.testing.assert_allclose(got, np.convolve(np.array(v) * 100 / 0.1, spatial.gaussian_kernel(8, 1.0), "same"))
    lines = spark.createDataFrame([("f", f'{{"time": {t / 10}, "position_controller": {{"position": {{"dy": {x}}}}}}}') for t, x in enumerate([2.0, 0, 0, 4.0, 0, 0, 0, 0, 1.0])], "file string, value string")
    got = [r["velocity"] for r in behaviour_log.velocity(behaviour_log.parsed(lines), 0.5, sigma=0.6).orderBy("frame").collect()]
    np.testing.assert_allclose(got, np.convolve([12.0, 2.0], spatial.gaussian_kernel(16, 2.0), "full")[7:9], atol=1e-9)


def test_frames_with_a_gap_in_any_region_go(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "b", 0, None), (1, "a", 1, 2.0), (1, "b", 1, 3.0), (1, "a", 2, float("nan")), (1, "b", 2, 1.0), (2, "a", 0, 5.0)], "expt int, roi string, frame int, value double")
    assert sorted((r["expt"], r["roi"], r["frame"]) for r in aggregates.complete_frames(df, ["expt"], "frame").collect()) == [(1, "a", 1), (1, "b", 1), (2, "a", 0)]


def test_component_order_by_hand():
    h = np.zeros((4, 12))  # 3 laps of 4 bins
    h[0, 8], h[1, 0], h[1, 3], h[2, 1], h[2, 2], h[3, 4] = 1.0, 0.2, 0.9, 0.8, 0.1, 1.0
    assert list(models.component_order(h, 3, False)) == [1, 2, 3, 0]
    assert list(models.component_order(h, 3)) == [2, 3, 0, 1]  # of 1 and 2, 1 peaks later in the first lap


def test_padded_laps_and_masks(spark):
    raster = spark.createDataFrame([(1, lap, b, None if (lap, b) == (5, 1) else float(lap + b)) for lap in (3, 4, 5) for b in range(2)], "roi int, lap int, rel int, value double")
    fields = spark.createDataFrame([(1, 4)], "roi int, first_lap int")
    got = {(r["step"], r["rel"]): r["value"] for r in population.padded_laps(raster, fields, ["roi"], 4).collect()}
    assert got == {(0, 0): 4.0, (0, 1): 5.0, (1, 0): 5.0, (1, 1): None, (2, 0): 0.0, (2, 1): 0.0, (3, 0): 0.0, (3, 1): 0.0}
    f = spark.createDataFrame([(1, 2, 4), (1, 8, 1)], "roi int, start_bin int, stop_bin int")
    masks = lambda **k: sorted((r["start_bin"], r["bin"]) for r in population.field_masks(f, ["roi"], 10, **k).collect())
    assert masks(margin=3) == [(2, b) for b in range(7)]
    assert masks(margin=1, circular=True) == [(2, b) for b in (1, 2, 3, 4)] + [(8, b) for b in (0, 1, 7, 8, 9)]


def test_shuffled_cues_keep_lengths_and_stay_apart(spark):
    rng = np.random.default_rng(2)
    rows = []
    for lap in range(6):
        at = 0.0
        for _ in range(4):
            at += rng.uniform(0.1, 3)
            rows.append((lap, f"c{len(rows)}", at, at := at + rng.uniform(0.5, 2)))
    rows.append((0, "broken", None, 3.0))
    df = spark.createDataFrame(rows, "lap int, name string, onset double, offset double")
    got = behaviour_log.shuffled_cues(df, ["lap"], 30.0, seed=3).collect()
    lengths = {n: b - a for _, n, a, b in rows if a is not None}
    assert {r["name"] for r in got} == set(lengths)
    for lap in range(6):
        mine = sorted((r["onset"], r["offset"], r["name"]) for r in got if r["lap"] == lap)
        assert all(abs(b - a - lengths[n]) < 1e-9 for a, b, n in mine) and all(x[1] <= y[0] + 1e-9 for x, y in zip(mine, mine[1:]))
        assert mine[0][0] >= 0 and mine[-1][1] <= 30.0 + 1e-9
    assert [r["name"] for r in sorted(got, key=lambda r: (r["lap"], r["onset"]))] != [n for n in lengths]


# ---------------------------------------------------------------- fitted thresholds


def curves(spark, made):
    return spark.createDataFrame([(a, [(float(t), None if r is None else float(r)) for t, r in c]) for a, c in made.items()], "a int, curve array<struct<t:double,rate:double>>")


def test_known_curves_give_their_parameters_and_thresholds(spark):
    t = np.arange(20) / 4
    made = {0: list(zip(t, 0.6 * np.exp(-1.3 * t) + 0.02)), 1: list(zip(t, 0.01 + 0 * t)), 2: list(zip(t, 0.5 + 0 * t)), 3: [(x, None if i % 4 == 1 else 0.9 * np.exp(-0.4 * x)) for i, x in enumerate(t)], 4: [(x, None) for x in t]}
    got = {r["a"]: r for r in thresholds.fitted_thresholds(curves(spark, made), 0.25).collect()}
    np.testing.assert_allclose(got[0]["parameters"], [0.6, 1.3, 0.02], rtol=1e-4)
    assert abs(got[0]["duration"] + np.log((0.25 - 0.02) / 0.6) / 1.3) < 1e-5
    assert got[1]["duration"] == 0 and got[2]["duration"] is None and got[4]["duration"] is None
    assert abs(got[3]["duration"] + np.log(0.25 / 0.9) / 0.4) < 1e-4
    poly = np.poly1d([0.002, -0.01, 0.03, -0.2, 0.7])
    got = {r["a"]: r for r in thresholds.fitted_thresholds(curves(spark, {0: list(zip(t, poly(t))), 1: made[2]}), 0.25, "polynomial").collect()}
    np.testing.assert_allclose(got[0]["parameters"], poly.c, rtol=1e-6)
    assert abs(poly(got[0]["duration"]) - 0.25) < 1e-8 and got[1]["duration"] is None
    with pytest.raises(ValueError):
        thresholds.fitted_thresholds(curves(spark, made), 0.2, "linear")


def test_rates_pair_both_histograms(spark):
    up = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (0, 2, 0)], "a int, d int, n int")
    down = spark.createDataFrame([(0, 0, 2), (0, 2, 1)], "a int, d int, n int")
    got = thresholds.false_positive_rates(up, down).first()
    assert [(x["t"], x["rate"]) for x in got["curve"]] == [(0.0, 0.5), (0.25, 0.0), (0.5, None)]


def test_population_correlations_of_two_filters(spark):
    rng = np.random.default_rng(4)
    x, y = rng.random((9, 4)), rng.random((9, 4))
    x[0, 1] = np.nan
    frame = lambda m: spark.createDataFrame([(1, r, b, float(v)) for r, row in enumerate(m) for b, v in enumerate(row)], "c int, roi int, bin int, value double")
    got = {(r["a"], r["b"]): r for r in spatial.population_correlations(frame(x), frame(y), "roi", ["c"]).collect()}
    assert len(got) == 16
    for (a, b), r in got.items():
        ok = np.isfinite(x[:, a])
        want = np.corrcoef(x[ok, a], y[ok, b])[0, 1]
        assert abs(r["r"] - want) < 1e-9 and r["n"] == ok.sum()
        t = abs(want) * np.sqrt((r["n"] - 2) / (1 - want**2))
        s = np.linspace(0, t, 200_001)
        from math import gamma, pi

        v = r["n"] - 2
        density = gamma((v + 1) / 2) / (np.sqrt(v * pi) * gamma(v / 2)) * (1 + s**2 / v) ** (-(v + 1) / 2)
        inside = ((density[1:] + density[:-1]) / 2 * np.diff(s)).sum()
        assert abs(r["p"] - (1 - 2 * inside)) < 1e-6


def test_records_of_weights_viruses_and_pages(spark):
    mice = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "mouse_id int, mouse_name string")
    weights = spark.createDataFrame([(1, 20.0, "2024-01-01"), (1, 22.0, "2024-01-03"), (1, 27.0, "2024-01-02"), (2, 9.0, "2024-01-01")], "mouse_id int, weight double, date string")
    more = records.with_weight(weights, mice, "a", 31)
    report = records.weight_report(records.weight_history(mice, more, ["a"]), 2).orderBy("weight").collect()
    assert [(r["weight"], r["average"]) for r in report] == [(22.0, 25.0), (31.0, 25.0)]
    for name in ("b", "z"):
        with pytest.raises(KeyError):
            records.with_weight(weights, mice, name, 1.0)
    viruses = spark.createDataFrame([(7, "x"), (8, "y")], "virus_id int, label string")
    attrs = spark.createDataFrame([(7, "titre", "1"), (7, "titre", "2"), (7, "site", "CA1"), (7, None, "?")], "virus_id int, attribute string, value string")
    assert {r["virus_id"]: r["attributes"] for r in records.with_attributes(viruses, attrs, "virus_id").collect()} == {7: {"titre": "2", "site": "CA1"}, 8: {}}
    pages = spark.createDataFrame([(1, "note", "well"), (2, "note", "ill")], "mouse_id int, attribute string, value string")
    assert [tuple(r) for r in records.mouse_page(mice, pages, "a").collect()] == [("note", "well")]


def test_resampling_keeps_low_frequencies(spark):
    t = np.arange(1037) / 10
    x = 2 + np.sin(2 * np.pi * 5 * np.arange(1037) / 1024)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "roi int, frame int, value double")
    got = [r["value"] for r in signals.resampled(df, ["roi"], 256, 10.0, max_truncation=60.0).orderBy("frame").collect()]
    np.testing.assert_allclose(got, 2 + np.sin(2 * np.pi * 5 * np.arange(256) / 256), atol=1e-9)  # cut to 1024 samples
    short = signals.resampled(df, ["roi"], 256, 10.0, max_truncation=60.0, truncate_output=True)
    assert short.count() == 256 // 128 * 128
    even = signals.resampled(df.where("frame < 8"), ["roi"], 4, 10.0).orderBy("frame").collect()
    f = np.fft.fft(x[:8])
    y = np.array([f[0], f[1], f[2] + f[6], f[7]]) / 8
    np.testing.assert_allclose([r["value"] for r in even], [sum(y[k] * np.exp(2j * np.pi * k * i / 4) for k in range(4)).real for i in range(4)], atol=1e-9)
    assert len(t) == 1037


def test_field_edges_compare_as_written(spark):
    fields = spark.createDataFrame([(i, b) for i, b in enumerate((0, 19, 20, 49, 50, 99))], "roi int, start_bin int")
    start = selection.FieldEdge("start_bin", 100)
    assert [r["roi"] for r in ((0.2 < start) & (start < 0.5)).keep(fields).orderBy("roi").collect()] == [2]
    assert [r["roi"] for r in (~(start >= 0.2)).keep(fields).orderBy("roi").collect()] == [0]
    frames = spark.createDataFrame([(1, f) for f in range(6)], "expt int, frame int")
    spans = spark.createDataFrame([(1, "reward", 1, 3), (1, "tone", 4, 6)], "expt int, name string, onset int, offset int")
    assert sorted(r["frame"] for r in selection.in_reward(frames, spans, ["expt"]).collect()) == [1, 2]
    assert sorted(r["frame"] for r in selection.in_reward(frames, spans, ["expt"], inside=False).collect()) == [0, 3, 4, 5]


def test_metadata_of_several_files(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "roi int, layer string, depth int")
    b = spark.createDataFrame([(1, "z", 7), (3, "w", 9)], "roi int, layer string, depth int")
    c = spark.createDataFrame([(1, True)], "roi int, red boolean")
    got = catalog.composed(a, b, c, keys=["roi"])
    assert sorted(got.columns) == ["depth", "layer", "red", "roi"]
    assert {r["roi"]: (r["layer"], r["depth"], r["red"]) for r in got.collect()} == {1: ("x", 7, True), 2: ("y", 5, None), 3: ("w", 9, None)}


def test_store_moves_all_types_and_joins_times_by_experiment(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(e, r, f, float(10 * r + f)) for e in (1, 2) for r in (1, 2, 3) for f in range(3)], "expt_id int, roi int, frame int, value double")
    for kind in ("raw", "dfof"):
        s.write(rows, "Ch2", "all", kind)
    red = spark.createDataFrame([(2,)], "roi int")
    kinds = [("Ch2", "raw"), ("Ch2", "dfof"), ("Ch1", "raw")]
    assert s.move("all", red, "red", kinds, dry_run=True) == kinds[:2] and s.read("Ch2", "all", "raw").count() == 18
    s.move("all", red, "red", kinds)
    assert {r["roi"] for r in s.read("Ch2", "red", "dfof").collect()} == {2} and {r["roi"] for r in s.read("Ch2", "all", "raw").collect()} == {1, 3}
    with pytest.raises(store.Exists):
        s.move("all", red, "red", kinds)
    times = spark.createDataFrame([(e, f, e * 100.0 + f) for e in (1, 2) for f in range(3)], "expt_id int, frame int, t double")
    got = s.signals("imaging", "all", times=times)
    assert got.count() == 12 and all(r["t"] == r["expt_id"] * 100 + r["frame"] for r in got.collect())
    z = s.signals("imaging", "all", zscore=True).where("frame = 1").collect()
    assert all(abs(r["value"]) < 1e-9 for r in z)
    s.calculate_dfof(lambda df: df.withColumn("dfof", F.col("value") * 2), "red", overwrite=True)
    assert {r["value"] for r in s.read("Ch2", "red", "dfof").collect()} == {40.0, 42.0, 44.0}
    s.infer_spikes(lambda df: df.withColumn("spikes", F.lit(1.0)), "red")
    assert {r["value"] for r in s.read("Ch2", "red", "spikes").collect()} == {1.0}
    spans = spark.createDataFrame([(1, 0.25, 0.1), (2, 1.0, 0.1)], "expt_id int, duration double, frame_period double")
    assert store.trim_to_duration(rows, spans, ["expt_id"]).groupBy("expt_id").count().orderBy("expt_id").collect()[0]["count"] == 6


def test_frames_to_the_end_are_not_read_for_each_row(spark):
    """Filling in time and straight lines over gaps read each row a fixed number of times."""
    movie = spark.createDataFrame([(f, 0, 0, None if f in (0, 1, 3) else float(f)) for f in range(6)], "frame int, y int, x int, value double")
    full = masks.filled_in_time(movie)
    assert [r["value"] for r in full.orderBy("frame").collect()] == [2.0, 2.0, 2.0, 2.0, 4.0, 5.0]
    line = rolling.interpolated(movie.withColumnRenamed("y", "roi"), "value", "v", ["roi"], "frame")
    assert [r["v"] for r in line.orderBy("frame").collect()] == [2.0, 2.0, 2.0, 3.0, 4.0, 5.0]
    for df in (full, line):
        assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_null_thresholds_are_those_of_the_shuffled_rows(spark):
    """Thresholds made where the laps are equal the quantiles of shuffled rows, missing values, bins and laps among them, smoothed or not; no shuffle is a row."""
    rng = random.Random(5)
    rows = [(r, f, None if f % 29 == 3 else f // 13, None if f % 17 == 5 else rng.random(), None if r == 1 or f % 11 == 2 else rng.gauss(5, 2)) for r in range(3) for f in range(60)]
    df = spark.createDataFrame(rows, "roi int, frame int, lap int, position double, value double")
    for sigma in (None, 1.0):
        null = spatial.shuffled(df, ["roi"], "lap", 6, 20).groupBy("shuffle", "roi", "bin").agg(F.avg("value").alias("value"))
        if sigma:
            null = spatial.smooth_wrapped(null, ["shuffle", "roi"], sigma).withColumnRenamed("smoothed", "value")
        want = {(r[0], r[1]): r[2] for r in null.groupBy("roi", "bin").agg(F.percentile("value", F.lit(0.9))).collect()}
        found = spatial.null_threshold(df, ["roi"], "lap", 6, 20, 0.1, sigma)
        got = {(r[0], r[1]): r[2] for r in found.collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-12)) for k, v in want.items())
        assert "shuffle" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_centres_of_one_file_meet_references_in_many_tasks(spark):
    """Few references are broadcast; centres are dealt out before they meet them."""
    c = spark.range(200).select(F.lit(1).alias("f"), F.col("id").alias("b"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 11).cast("double").alias("x")).coalesce(1)
    found = registration.near_references(c, c.withColumnRenamed("b", "a"), ["f"], 2.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 1
    assert found.count() == sum(abs(i % 7 - j % 7) < 2 and abs(i % 11 - j % 11) < 2 for i in range(200) for j in range(200))


def test_spike_counts_add_up_spikes(spark):
    """Counts over laps equal the sum of the laps' spikes, without a row for each lap."""
    r = simulate.rates(spark.createDataFrame([(1, 3.0), (2, None)], "roi int, centre double"), 12)
    want = simulate.spikes(r, 10, 0.1).groupBy("roi", "bin").agg(F.sum("spike").alias("spikes"))
    got = simulate.spike_counts(r, 10, 0.1)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Generate") <= 1


def test_traces_pass_python_once(spark):
    """Traces that span batches, short ones and missing keys come out whole; baselines and spikes take one pass, not one for each step."""
    rows = [(None if r == 2 else r, f, float((f * 7 + r) % 13)) for r, n in enumerate((1, 700, 3, 250)) for f in range(n)]
    df = spark.createDataFrame(rows, "roi int, frame int, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r[0], r[1]): r[3] for r in rolling.by_traces(df, ["roi"], "frame", {"s": ("value", np.cumsum)}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, total = {}, {}
    for r, f, v in rows:
        total[r] = total.get(r, 0) + v
        want[r, f] = total[r]
    assert got == want
    for made in (signals.neuropil_dfof(df.selectExpr("roi", "frame", "value raw", "value / 9 npil"), ["roi"]), signals.spikes_ar1(df, ["roi"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("InPandas") == 1 and "Join" not in plan


def test_correlations_by_blocks_leave_nothing_out(spark, monkeypatch):
    """Correlations with chosen keys over several blocks: missing rows and values, flat curves; each pair once, none joined by place."""
    from spindrift.operators import blocks

    rng = np.random.default_rng(2)
    x = {k: {i: None if (k + i) % 9 == 4 else 3.0 if k == 5 else float(v) for i, v in enumerate(rng.normal(size=12)) if (k * i) % 7 != 3} for k in range(40)}
    df = spark.createDataFrame([(k, i, v) for k, c in x.items() for i, v in c.items()], "roi int, bin int, value double")
    monkeypatch.setattr(blocks, "BLOCK", 9)
    found = spatial.correlations_with(df, df.where("roi % 4 = 1"), "roi", "bin", [])
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in found.collect()}
    assert len(got) == found.count() == 10 * 39
    for (a, b), (r, n) in got.items():
        both = x[a].keys() & x[b].keys()
        u, v = zip(*[(x[a][i], x[b][i]) for i in both if x[a][i] is not None and x[b][i] is not None], strict=True)
        assert n == len(both) and (r is None if 5 in (a, b) else math.isclose(r, np.corrcoef(u, v)[0, 1], rel_tol=1e-9, abs_tol=1e-12))
    assert "Join Inner, (bin" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_small_and_large_keys_are_solved_alike(spark, monkeypatch):
    """Pairs of a key fall into groups in one row, or by rounds of labels beyond a size: the same totals; small keys take no rounds."""
    rng = random.Random(8)
    pairs = {(f, a, b): rng.random() for f in range(4) for g in range(3) for a in range(4 * g, 4 * g + 3) for b in range(5 * g, 5 * g + 4) if rng.random() < 0.7}
    df = spark.createDataFrame([(*k, d) for k, d in pairs.items()], "f int, a int, b int, distance double")
    total = {}
    for whole in (20_000, 20):
        monkeypatch.setattr(models, "WHOLE", whole)
        if whole > 20:
            monkeypatch.setattr(models, "_labels", None)
        for missing in (None, 0.5):
            got = models.assigned(df, ["f"], 0.9, missing=missing).collect()
            assert len({(r["f"], r["a"]) for r in got}) == len({(r["f"], r["b"]) for r in got}) == len(got)
            assert all(pairs[r["f"], r["a"], r["b"]] == r["distance"] for r in got)
            cost = (len(got), round(sum(r["distance"] for r in got), 9))
            assert total.setdefault(missing, cost) == cost
        monkeypatch.undo()


def test_sequences_in_step_are_as_each_alone():
    """Likelihood and posteriors of sequences of several lengths side by side are those of each by itself."""
    rng = np.random.default_rng(6)
    traces = [rng.poisson(2, n).astype(float) for n in (1, 5, 5, 17)]
    start, move, level = np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([1.0, 4.0])

    def run(some):
        for which, x, n in models._in_step(some):
            live = np.arange(x.shape[1])[None] < n[:, None]
            yield which, n, models._forward_backward(models._log_emissions(models._log_poisson, x, level, live), n, start, move)

    ((which, n, (g, steps, ll)),) = run(traces)
    alone = [next(run([t]))[2] for t in traces]
    assert np.allclose(steps, sum(s for _, s, _ in alone))
    for i, j in enumerate(which):
        assert np.isclose(ll[i], alone[j][2][0]) and np.allclose(g[i, : n[i]], alone[j][0][0])
    paths = np.array(np.meshgrid(*[[0, 1]] * 5)).reshape(5, -1).T
    x = traces[1]
    e = models._log_poisson(x, level)
    each = [start[p[0]] * np.exp(e[np.arange(5), p].sum()) * np.prod(move[p[:-1], p[1:]]) for p in paths]
    assert np.isclose(alone[1][2][0], np.log(sum(each)))
