"""Selection, masks, imports and the smaller event operators."""

import json

from pyspark.sql import functions as F

from spindrift.operators import intervals, masks, selection
from spindrift.sources import imports


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_crossings_laps_and_impulses(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 2, 3, 1, 5])], "roi int, frame int, value double")
    assert rows(intervals.crossings(df, "value", 2.0, ["roi"]), "frame", "rising") == [(0, True), (2, False), (3, True)]
    starts = spark.createDataFrame([(1, 0, 20), (1, 7, 20)], "roi int, f int, n int")
    laps = intervals.laps_as_events(starts, ["roi"], "f", "n")
    assert rows(laps, "lap", "onset", "offset") == [(0, 0, 7), (1, 7, 20)]
    assert rows(intervals.expand(laps, 2, 3), "onset", "offset") == [(0, 10), (5, 23)]
    ev = spark.createDataFrame([(1, 3)], "roi int, onset int")
    assert rows(intervals.impulses(ev, df, ["roi"]), "frame", "value") == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 1.0), (4, 0.0)]


def test_inter_trial(spark):
    df = spark.createDataFrame([(1, 0, i, True, p) for i, p in enumerate([0.3, 0.1, 0.2, 0.5])] + [(1, 1, 4, False, 0.0)], "roi int, lap int, frame int, active boolean, position double")
    assert rows(intervals.inter_trial(df, "active", "position", ["roi"], "lap"), "frame", "iti") == [(0, True), (1, False), (2, False), (3, False), (4, True)]


def test_selection(spark):
    points = spark.createDataFrame([(r, float(t), 1.0 if r == 1 and t >= 5 else 0.0) for r in (1, 2) for t in range(10)], "roi int, t double, value double")
    triggers = spark.createDataFrame([(1, 4.5), (2, 4.5)], "roi int, trigger double")
    assert rows(selection.responsive(points, triggers, 3, 3, ["roi"]), "roi") == [(1,)]
    fields = spark.createDataFrame([(1, 10, 20), (2, 60, 70)], "roi int, start_bin int, stop_bin int")
    assert rows(selection.field_between(fields, "start_bin", 0.2, None, 100), "roi") == [(2,)]
    assert rows(selection.with_field(points, fields.where("roi = 1"), ["roi"], inside=False).select("roi").distinct(), "roi") == [(2,)]
    a, b = spark.createDataFrame([(1, 2.0)], "roi int, u double"), spark.createDataFrame([(2, None), (3, 1.0)], "roi int, w double")
    assert rows(selection.aligned(a, b, keys=["roi"]), "roi") == [(1,), (3,)]
    curves = spark.createDataFrame([(r, i, float(i == p)) for r, p in ((1, 2), (2, 0), (3, 2)) for i in range(3)], "roi int, bin int, value double")
    assert rows(selection.ranked_by_peak(curves, ["roi"]), "roi", "peak", "place") == [(1, 2, 1), (2, 0, 0), (3, 2, 2)]
    on = spark.createDataFrame([(1, 3), (1, 9)], "roi int, onset int")
    ev = spark.createDataFrame([(1, 2, 5)], "roi int, onset int, offset int")
    assert rows(selection.trials_during(on, ev, ["roi"]), "onset") == [(3,)]


def test_classifier(spark):
    df = spark.createDataFrame([(i, float(i), float(i > 10)) for i in range(20)], "roi int, u double, y double")
    model = selection.fit_classifier(df, "y", ["u"])
    assert {r["roi"] for r in selection.classified(df, model, ["u"], ["roi"]).collect()} == set(range(11, 20))


def test_masks(spark):
    px = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 2, 1.0), (1, 5, 5, 0.01), (2, 0, 1, 1.0)], "roi int, y int, x int, weight double")
    b = masks.binarised(px, ["roi"])
    assert rows(masks.centroids(b, ["roi"]), "roi", "y", "x", "name") == [(1, 0.0, 1.0, "0000-0001"), (2, 0.0, 1.0, "0000-0001-1")]
    near = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 30.0, 0.0)], "f int, roi int, x double, y double")
    assert rows(masks.nearby(near, 4, 4, ["f"]), "a", "b") == [(1, 2)]
    movie = spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, 2.0), (2, 0, 0, None), (0, 1, 0, 1.0), (1, 1, 0, 1.0), (2, 1, 0, 1.0)], "frame int, y int, x int, value double")
    full = masks.filled_in_time(movie)
    assert rows(full, "y", "frame", "value") == [(0, 0, 2.0), (0, 1, 2.0), (0, 2, 2.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
    assert rows(masks.time_average(full), "y", "value") == [(0, 2.0), (1, 1.0)]
    assert masks.live_lines(full, "y").count() == 0
    assert rows(masks.bright(spark.createDataFrame([(1, 1.5), (2, 3.0)], "roi int, value double"), masks.time_average(full)), "roi") == [(2,)]


def test_imports(spark, tmp_path):
    (tmp_path / "m.csv").write_text("roi,kind\n1,pyr\n2,int\n")
    assert rows(imports.metadata_csv(spark, str(tmp_path / "m.csv"), "roi int, kind string"), "roi", "kind") == [(1, "pyr"), (2, "int")]
    (tmp_path / "p.json").write_text(json.dumps({"frame_period": 0.1, "imaging_system": "x"}, indent=1))
    assert imports.sidecar(spark, str(tmp_path / "p.json")).first()["frame_period"] == 0.1
    (tmp_path / "s.xml").write_text('<Scan><Sequence><Frame absoluteTime="0.5" index="1"/><Frame absoluteTime="0.625" index="2"/></Sequence></Scan>')
    assert imports.frame_period_xml(spark, str(tmp_path / "s.xml")).first()["frame_period"] == 0.125
    t = imports.imaging_times(spark, spark.createDataFrame([("a", 3, 0.5)], "k string, n_frames int, frame_period double"))
    assert rows(t, "frame", "t") == [(0, 0.0), (1, 0.5), (2, 1.0)]
    lfp = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 5.0), (1, 2.0, 0.0)], "k int, t double, adc double")
    assert rows(imports.lfp_from_imaging_start(lfp, ["k"]), "t") == [(0.0,), (1.0,)]
    sig = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 1.0)], "roi int, frame int, value double")
    cells = spark.createDataFrame([(1, True), (2, False)], "roi int, accepted boolean")
    got = imports.accepted_cells(sig, cells, spark.createDataFrame([(2,)], "frame int")).orderBy("frame")
    assert [r["value"] for r in got.select(F.col("value")).collect()] == [None, 2.0, None]
