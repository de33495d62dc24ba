"""Registered queries over stores, filters, masks and the smaller parts of the plans, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import views
from .functions.staging import folder
from .operators import catalog, intervals, masks, models, registration, selection, signals, spatial
from .plans import tuning
from .registered import ROI, query, rounded, st
from .sources import behaviour_log, imports
from .sources.store import Store, registered_signals, split_batch
from .views import read, with_views

_RUNS = ", r AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY frame) - 1 AS run FROM (SELECT roi, frame, value > 15 f, lag(value > 15) OVER (PARTITION BY roi ORDER BY frame) p FROM sig_short)), ev AS (SELECT roi, CAST(run AS INT) run, min(frame) onset, max(frame) + 1 AS \"offset\" FROM r WHERE f GROUP BY roi, run)"


def _events(spark, sf_dir):
    return intervals.runs(views.sig_short(spark, sf_dir), F.col("value") > 15, ROI)


# ---------------------------------------------------------------- stores


@query("stored_signals", with_views("sig_long") + f" SELECT roi, frame, frame * 0.1::DOUBLE t, {st('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)', 'value')} FROM sig_long WHERE frame < 40 WINDOW w AS (PARTITION BY roi)")
def stored_signals(spark, sf_dir):
    """Signals written to a store and read with their times, standardised, up to a frame."""
    rows = views.sig_long(spark, sf_dir).select("roi", "frame", "value")
    store = Store(spark, folder(spark, "store"))
    store.write(rows, "Ch2", "suite2p", "raw")
    times = rows.select("frame").distinct().withColumn("t", F.col("frame") * F.lit(0.1))
    return rounded(store.signals("imaging", "suite2p", signal_type="raw", zscore=True, max_frame=40, times=times).select("roi", "frame", "t", "value"), "value")


@query("stored_events", with_views("sig_short") + _RUNS + ' SELECT roi, onset, "offset" FROM ev')
def stored_events(spark, sf_dir):
    """Events written to a store and read back by type."""
    store = Store(spark, folder(spark, "store"))
    store.write_events(_events(spark, sf_dir), "suite2p", "transients", "Ch2")
    return store.events("transients").select("roi", "onset", "offset")


@query("cached_result", with_views("sig_long") + f" SELECT roi, {st('avg(value)', 'value')} FROM sig_long GROUP BY roi")
def cached_result(spark, sf_dir):
    """A result saved under its parameters: the second call reads what the first one saved."""
    store, rows = Store(spark, folder(spark, "store")), views.sig_long(spark, sf_dir)
    store.cached("mean", {"column": "value"}, lambda: rounded(rows.groupBy("roi").agg(F.avg("value").alias("value")), "value"))
    return store.cached("mean", {"column": "value"}, lambda: rows.select("roi", "value").limit(0))


@query("stored_dfof", with_views("sig_long") + f" SELECT roi, frame, {st('value / avg(value) OVER (PARTITION BY roi) - 1', 'value')} FROM sig_long")
def stored_dfof(spark, sf_dir):
    """dF/F of stored signals, saved as a type of its own."""
    store = Store(spark, folder(spark, "store"))
    store.write(views.sig_long(spark, sf_dir).select("roi", "frame", "value"), "Ch2", "suite2p", "raw")
    by = lambda df: df.withColumn("dfof", F.col("value") / F.avg("value").over(Window.partitionBy("roi")) - 1)
    return rounded(store.calculate_dfof(by, "suite2p"), "value")


@query("moved_label", "WITH l AS (SELECT l_suppkey roi, count(*) n FROM lineitem GROUP BY 1) SELECT roi, n, CASE WHEN roi % 4 = 0 THEN 'red' ELSE 'all' END AS label FROM l")
def moved_label(spark, sf_dir):
    """Some regions' signals moved to a new label in all types."""
    store = Store(spark, folder(spark, "store"))
    rows = views.sig_long(spark, sf_dir).select("roi", "frame", "value")
    store.write(rows, "Ch2", "all", "raw")
    store.move("all", rows.where("roi % 4 = 0").select("roi").distinct(), "red", [("Ch2", "raw"), ("Ch2", "dfof")])
    left, red = (store.read("Ch2", name, "raw").groupBy("roi").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(name)) for name in ("all", "red"))
    return left.unionByName(red)


@query("split_batch", with_views("sig_short") + " SELECT roi, child, CAST(frame - s AS INT) frame, value FROM sig_short JOIN (VALUES ('a', 0, 10), ('b', 10, 25), ('c', 25, 1000)) c(child, s, e) ON frame >= s AND frame < e")
def split_children(spark, sf_dir):
    """Frames of a session of three recordings as frames of each."""
    children = spark.createDataFrame([("a", 10, 0), ("b", 15, 1), ("c", 975, 2)], "child string, n_frames int, place int")
    rows = split_batch(views.sig_short(spark, sf_dir).select("roi", "frame", "value"), children)
    return rows.select("roi", "child", F.col("frame").cast("int").alias("frame"), "value")


@query("registered_signals", with_views("sig_short") + ", g AS (SELECT roi AS reference, CASE WHEN roi % 3 = 0 THEN NULL ELSE roi END roi FROM (SELECT DISTINCT roi FROM sig_short)), f AS (SELECT DISTINCT frame FROM sig_short WHERE frame < 30) SELECT g.reference, f.frame, s.value FROM g CROSS JOIN f LEFT JOIN sig_short s ON s.roi = g.roi AND s.frame = f.frame")
def signals_of_references(spark, sf_dir):
    """Signals over all registered regions, missing where the session lacks one."""
    rows = views.sig_short(spark, sf_dir)
    known = rows.select("roi").distinct().select(F.col("roi").alias("reference"), F.when(F.col("roi") % 3 != 0, F.col("roi")).alias("roi"))
    return registered_signals(rows, known, rows.where("frame < 30"))


@query("accepted_cells", with_views("sig_long") + " SELECT roi, frame, CASE WHEN frame % 17 <> 0 THEN nullif(discount, 0) END AS value FROM sig_long WHERE roi IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def accepted_cells(spark, sf_dir):
    """Signals of accepted cells; zeros and frames known as bad are missing."""
    rows = views.sig_long(spark, sf_dir).select("roi", "frame", F.col("discount").alias("value"))
    cells = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), (F.col("s_nationkey") < 10).alias("accepted"))
    return imports.accepted_cells(rows, cells, rows.where("frame % 17 = 0").select("frame")).select("roi", "frame", "value")


@query("imaging_times", "SELECT o_orderkey trial_id, CAST(f AS INT) frame, f * 0.25::DOUBLE t FROM (SELECT o_orderkey, unnest(range(o_orderkey % 20 + 1)) f FROM orders)")
def imaging_times(spark, sf_dir):
    """Times of the frames of each trial."""
    trials = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), (F.col("o_orderkey") % 20 + 1).cast("int").alias("n_frames"), F.lit(0.25).alias("frame_period"))
    return imports.imaging_times(spark, trials)


# ---------------------------------------------------------------- filters and selection


@query("filter_groups", with_views("sig_long") + " SELECT roi, frame FROM sig_long WHERE (discount < 0.03 OR position > 0.8) AND frame % 2 = 0")
def filter_groups(spark, sf_dir):
    """All of some filters, one of which is any of others."""
    chosen = catalog.all_of(catalog.any_of(catalog.Filter(F.col("discount") < 0.03), catalog.Filter(F.col("position") > 0.8)), catalog.everything(), catalog.Filter(F.col("frame") % 2 == 0))
    return chosen.keep(views.sig_long(spark, sf_dir)).select("roi", "frame")


@query("frames_between", with_views("sig_long") + " SELECT roi, frame, position FROM sig_long WHERE position > 0.2::DOUBLE AND position < 0.6::DOUBLE")
def frames_between(spark, sf_dir):
    return catalog.between(0.2, 0.6).keep(views.sig_long(spark, sf_dir)).select("roi", "frame", "position")


@query("features_of_kept_frames", with_views("sig_long") + f" SELECT roi, {st('avg(value)', 'mean')}, count(*) n FROM sig_long WHERE NOT (discount < 0.03) GROUP BY roi")
def features_of_kept_frames(spark, sf_dir):
    """Features over the frames that a filter keeps: others are dropped, not masked."""
    kept = (~catalog.Filter(F.col("discount") < 0.03)).keep(views.sig_long(spark, sf_dir))
    return rounded(kept.groupBy("roi").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


@query("regions_with_field", with_views("curves") + " SELECT roi, context, bin, value FROM curves WHERE roi NOT IN (SELECT roi FROM curves WHERE value > 0.3::DOUBLE)")
def regions_without_field(spark, sf_dir):
    c = views.curves(spark, sf_dir)
    return selection.with_field(c, c.where("value > 0.3"), ROI, inside=False)


@query("fields_starting_between", with_views("sig_short") + _RUNS + " SELECT roi, run, CAST(onset % 100 AS INT) start_bin FROM ev WHERE onset % 100 > 19 AND onset % 100 < 49")
def fields_starting_between(spark, sf_dir):
    """Fields whose start lies between two positions, as a condition on the edge."""
    start = selection.FieldEdge("start_bin", 100)
    fields = _events(spark, sf_dir).select("roi", "run", (F.col("onset") % 100).cast("int").alias("start_bin"))
    return ((0.2 < start) & (start < 0.5)).keep(fields)


@query("trials_during", with_views("sig_short") + _RUNS + ", o AS (SELECT roi, frame onset FROM sig_short WHERE kind = 'purchase') SELECT o.roi, o.onset FROM o SEMI JOIN ev ON ev.roi = o.roi AND o.onset >= ev.onset AND o.onset < ev.\"offset\"")
def trials_during(spark, sf_dir):
    """Trials that begin inside an event of their region."""
    onsets = views.sig_short(spark, sf_dir).where("kind = 'purchase'").select("roi", F.col("frame").alias("onset"))
    return selection.trials_during(onsets, _events(spark, sf_dir), ROI)


@query("near_references", "WITH r AS (SELECT s_suppkey a, s_acctbal / 50 y, CAST(s_suppkey * 37 % 200 AS DOUBLE) x FROM supplier WHERE s_suppkey % 5 <> 0), c AS (SELECT c_custkey b, c_acctbal / 50 y, CAST(c_custkey * 53 % 200 AS DOUBLE) x FROM customer) SELECT 1 AS plane, a, b, round(sqrt((r.y - c.y) * (r.y - c.y) + (r.x - c.x) * (r.x - c.x)) + 1e-8::DOUBLE, 6) AS distance FROM r JOIN c ON abs(r.y - c.y) < 5 AND abs(r.x - c.x) < 5")
def near_references(spark, sf_dir):
    """References near each region, without those that have a partner already."""
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    references = s.select(F.lit(1).alias("plane"), F.col("s_suppkey").alias("a"), (F.col("s_acctbal") / 50).alias("y"), (F.col("s_suppkey") * 37 % 200).cast("double").alias("x"))
    centres = c.select(F.lit(1).alias("plane"), F.col("c_custkey").alias("b"), (F.col("c_acctbal") / 50).alias("y"), (F.col("c_custkey") * 53 % 200).cast("double").alias("x"))
    return rounded(registration.near_references(centres, references, ["plane"], 5.0, references.where("a % 5 = 0").select("plane", "a")), "distance")


# ---------------------------------------------------------------- metadata and results


@query("composed_metadata", "WITH a AS (SELECT s_suppkey roi, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END layer FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey roi, -s_nationkey layer, s_acctbal depth FROM supplier WHERE s_suppkey % 5 <> 0) SELECT coalesce(a.roi, b.roi) roi, coalesce(a.layer, b.layer) layer, b.depth FROM a FULL JOIN b ON a.roi = b.roi")
def composed_metadata(spark, sf_dir):
    """Metadata of two files as one, keys once, the first file's values first."""
    s = read(spark, sf_dir, "supplier")
    a = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("roi"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("layer"))
    b = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("roi"), (-F.col("s_nationkey")).alias("layer"), F.col("s_acctbal").alias("depth"))
    return catalog.composed(a, b, keys=ROI).select("roi", "layer", "depth")


@query("bound_by_place", "SELECT n_regionkey roi, n_name AS name, r_name area FROM nation JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 place FROM region) r ON r.place = (SELECT count(DISTINCT m.n_regionkey) FROM nation m WHERE m.n_regionkey < nation.n_regionkey)")
def bound_by_place(spark, sf_dir):
    """Values without a key, bound to regions by their place."""
    values = read(spark, sf_dir, "region").select((F.row_number().over(Window.orderBy("r_regionkey")) - 1).alias("place"), F.col("r_name").alias("value"))  # five rows
    return catalog.bind_by_place(read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("roi"), F.col("n_name").alias("name")), values, "roi", "area")


@query("aligned_results", with_views("sig_long") + f", a AS (SELECT roi, avg(value) x FROM sig_long GROUP BY roi), b AS (SELECT roi, max(CASE WHEN roi % 2 = 0 THEN value END) y FROM sig_long GROUP BY roi) SELECT roi, {st('x', 'mean')}, CAST(NULL AS DOUBLE) most FROM a UNION ALL SELECT roi, NULL, {st('y', 'most')} FROM b WHERE y IS NOT NULL")
def aligned_results(spark, sf_dir):
    """Two analyses below each other, without rows that know nothing."""
    rows = views.sig_long(spark, sf_dir)
    a, b = rows.groupBy("roi").agg(F.avg("value").alias("mean")), rows.groupBy("roi").agg(F.max(F.when(F.col("roi") % 2 == 0, F.col("value").cast("double"))).alias("most"))
    return rounded(selection.aligned(a, b, keys=ROI), "mean", "most").select("roi", "mean", "most")


@query("noise_sigma", with_views("sig_short") + _RUNS + f" SELECT s.roi, {st('stddev_pop(s.value)', 'sigma')} FROM sig_short s ANTI JOIN ev ON ev.roi = s.roi AND s.frame >= ev.onset AND s.frame < ev.\"offset\" GROUP BY s.roi")
def noise_sigma(spark, sf_dir):
    """Deviation of each trace outside its events."""
    return rounded(signals.noise(views.sig_short(spark, sf_dir), "value", ROI, _events(spark, sf_dir)), "sigma")


@query("plateau_velocity", with_views("sig_long") + f", v AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), f AS (SELECT DISTINCT roi, 0 AS block, roi % 3 first_lap, 2 start_bin, 4 stop_bin FROM sig_long) SELECT f.roi, f.block, CAST(f.first_lap AS INT) first_lap, f.start_bin, f.stop_bin, {st('avg(v.v)', 'plateau_velocity')} FROM f LEFT JOIN v ON v.roi = f.roi AND v.lap = f.first_lap + 1 AND v.bin BETWEEN f.start_bin AND f.stop_bin GROUP BY ALL")
def plateau_velocity(spark, sf_dir):
    """Mean velocity inside each field in its first lap."""
    v = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10)
    f = v.select("roi").distinct().select("roi", F.lit(0).alias("block"), (F.col("roi") % 3).cast("int").alias("first_lap"), F.lit(2).alias("start_bin"), F.lit(4).alias("stop_bin"))
    return rounded(tuning.plateau_velocity(f, v, ROI, "lap", {0: 1}), "plateau_velocity")


@query("mean_normalised", with_views("sig_long") + f", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL) SELECT roi, CAST(lap * 10 + bin AS INT) cell, {st('v / nullif(avg(v) OVER (PARTITION BY roi), 0)', 'value')} FROM t")
def mean_normalised(spark, sf_dir):
    """Rasters by their mean, laps and bins as one cell."""
    return rounded(models.mean_normalised(spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10), ROI), "value")


@query("curves_by_peak", with_views("curves") + f", p AS (SELECT context, roi, bin, value, max(value) OVER (PARTITION BY context, roi) m FROM curves) SELECT context, roi, bin, {st('value / nullif(m, 0)', 'value')} FROM p")
def curves_by_peak(spark, sf_dir):
    return rounded(spatial.normalised_by_peak(views.curves(spark, sf_dir), ["context", "roi"]), "value")


@query("peak_order", with_views("curves") + ", p AS (SELECT roi, bin, value, row_number() OVER (PARTITION BY roi ORDER BY value DESC, bin) o FROM curves) SELECT roi, bin AS peak, CAST(row_number() OVER (ORDER BY bin, roi) - 1 AS INT) place FROM p WHERE o = 1")
def peak_order(spark, sf_dir):
    """Regions in order of the bin of their peak."""
    return selection.ranked_by_peak(views.curves(spark, sf_dir), ROI).select("roi", "peak", F.col("place").cast("int").alias("place"))


_K8 = spatial.gaussian_kernel(8, 1.0)


@query("smoothed_across_laps", with_views("sig_long") + ", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL) SELECT roi, lap, bin, " + st(" + ".join(f"coalesce({'lead' if o >= 0 else 'lag'}(v, {abs(o)}) OVER w, 0) * {_K8[3 - o]!r}::DOUBLE" for o in range(-4, 4)), "smoothed") + " FROM t WINDOW w AS (PARTITION BY roi ORDER BY lap, bin)")
def smoothed_across_laps(spark, sf_dir):
    """Smoothing by bin in which laps run on into each other."""
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10)
    return rounded(spatial.smooth_same(t, ROI, 1.0, order=("lap", "bin")).select("roi", "lap", "bin", "smoothed"), "smoothed")


@query("custom_dfof", with_views("sig_long") + f", b AS (SELECT roi, frame, value, min(value) OVER (PARTITION BY roi) m FROM sig_long) SELECT roi, frame, {st('(value - m) / nullif(m, 0)', 'dfof')} FROM b")
def custom_dfof(spark, sf_dir):
    """dF/F over a baseline of the user's."""
    rows = views.sig_long(spark, sf_dir).select("roi", "frame", "value")
    found = signals.custom_dfof(rows, lambda df: df.withColumn("baseline", F.min("value").over(Window.partitionBy("roi"))))
    return rounded(found, "dfof").select("roi", "frame", "dfof")


@query("position_bins", with_views("sig_long") + " SELECT roi, frame, CAST(floor(position * 25.0::DOUBLE) AS INT) floored, CAST(ceil(position * 25.0::DOUBLE) - 1 AS INT) below FROM sig_long")
def position_bins(spark, sf_dir):
    """Bins by the floor, and bins that an exact edge falls below."""
    p = F.col("position")
    return views.sig_long(spark, sf_dir).select("roi", "frame", spatial.bin_floor(p, 25).alias("floored"), spatial.bin_left(p, 25).alias("below"))


# ---------------------------------------------------------------- events


@query("crossings", with_views("sig_long") + ", c AS (SELECT roi, frame, position >= 0.5 a, lead(position >= 0.5) OVER (PARTITION BY roi ORDER BY frame) n FROM sig_long) SELECT roi, frame, n AS rising FROM c WHERE n IS NOT NULL AND n <> a")
def crossings(spark, sf_dir):
    """Frames right before the middle of the track is passed."""
    return intervals.crossings(views.sig_long(spark, sf_dir), "position", 0.5, ROI)


@query("laps_as_events", with_views("sig_long") + ", s AS (SELECT roi, lap, min(frame) f, max(max(frame)) OVER (PARTITION BY roi) + 1 n FROM sig_long GROUP BY roi, lap) SELECT roi, CAST(row_number() OVER w - 1 AS INT) lap, f onset, CAST(coalesce(lead(f) OVER w, n) AS INT) AS \"offset\" FROM s WINDOW w AS (PARTITION BY roi ORDER BY f)")
def laps_as_events(spark, sf_dir):
    """Laps as intervals of frames; the last ends with the recording."""
    rows = views.sig_long(spark, sf_dir)
    starts = rows.groupBy("roi", "lap").agg(F.min("frame").alias("frame")).join(rows.groupBy("roi").agg((F.max("frame") + 1).alias("n_frames")), "roi")
    return intervals.laps_as_events(starts, ROI, "frame", "n_frames")


@query("expanded_events", with_views("sig_short") + _RUNS + ' SELECT roi, run, greatest(onset - 2, 0) * 0.5::DOUBLE onset, ("offset" + 3) * 0.5::DOUBLE AS "offset" FROM ev')
def expanded_events(spark, sf_dir):
    """Events with frames before and after, in seconds."""
    return intervals.frames_to_times(intervals.expand(_events(spark, sf_dir), 2, 3), 0.5).select("roi", "run", "onset", "offset")


@query("inter_trial", with_views("sig_long") + ", i AS (SELECT *, row_number() OVER (PARTITION BY roi, lap ORDER BY frame) - 1 i FROM sig_long), t AS (SELECT roi, lap, i AS t FROM i WHERE i < 5 QUALIFY row_number() OVER (PARTITION BY roi, lap ORDER BY position, i) = 1) SELECT i.roi, i.frame, NOT (i.discount > 0.02) OR i.i < t.t AS iti FROM i JOIN t USING (roi, lap)")
def inter_trial(spark, sf_dir):
    """Frames between trials: no context, or a lap's start before its least position."""
    rows = views.sig_long(spark, sf_dir).withColumn("active", F.col("discount") > 0.02)
    return intervals.inter_trial(rows, "active", "position", ROI, "lap", within=5).select("roi", "frame", "iti")


@query("errors_by_group", "SELECT user_id roi, CASE WHEN user_id % 7 = 0 THEN NULL ELSE count(*) END AS n, CASE WHEN user_id % 7 = 0 THEN 'ValueError: no signal' END AS error FROM events GROUP BY user_id")
def errors_by_group(spark, sf_dir):
    """A computation for each region; those that fail give a row with what went wrong."""

    def count(pdf):
        if pdf["roi"].iloc[0] % 7 == 0:
            raise ValueError("no signal")
        return pdf[["roi"]].head(1).assign(n=len(pdf))

    rows = views.sig_short(spark, sf_dir).select("roi", "frame")
    return signals.each_safely(rows, ROI, count, f"roi {rows.schema['roi'].dataType.simpleString()}, n long", "warn")


# ---------------------------------------------------------------- behaviour logs


@query("track_positions", "WITH e AS (SELECT user_id AS file, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) - 3600 t, value FROM events), p AS (SELECT file, t, ((value / 7.0::DOUBLE) % 1 + 1) % 1 AS position FROM e WHERE t >= 0), a AS (SELECT * FROM p UNION ALL SELECT file, 0.0, min_by(position, t) FROM p GROUP BY file HAVING min(t) > 0)" + f" SELECT file, {st('t', 't')}, {st('position', 'position')} FROM a")
def track_positions(spark, sf_dir):
    """Positions as shares of the track from time 0 on, with a first one there."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (t - F.min(t).over(Window.partitionBy("user_id")) - 3600).alias("time"), F.col("value").alias("y"))
    return rounded(behaviour_log.positions(rows, 7.0), "t", "position")


@query("sync_offsets", with_views("sig_short") + ", i AS (SELECT roi AS file, CASE WHEN kind = 'purchase' AND roi % 3 > 0 THEN 'AOD_sync_pin' ELSE 'sync_pin' END n, CASE WHEN frame % 4 > 0 THEN t END onset, CASE WHEN frame % 5 > 0 OR frame % 4 = 0 THEN t + 2 END AS \"offset\" FROM sig_short), a AS (SELECT file, min_by(\"offset\", coalesce(onset, \"offset\")) FILTER (n = 'AOD_sync_pin' AND \"offset\" IS NOT NULL) z FROM i GROUP BY file), f AS (SELECT file, n, onset, \"offset\", row_number() OVER (PARTITION BY file, n ORDER BY coalesce(onset, \"offset\")) o FROM i) SELECT k.file, coalesce(x.\"offset\", y.onset, y.\"offset\" - 0.1::DOUBLE, 0.0) zero FROM (SELECT DISTINCT file FROM i) k LEFT JOIN f x ON x.file = k.file AND x.n = 'AOD_sync_pin' AND x.o = 1 LEFT JOIN f y ON y.file = k.file AND y.n = 'sync_pin' AND y.o = 1")
def sync_offsets(spark, sf_dir):
    """When imaging started, from the intervals of the sync pins."""
    rows = views.sig_short(spark, sf_dir)
    name = F.when((F.col("kind") == "purchase") & (F.col("roi") % 3 > 0), "AOD_sync_pin").otherwise("sync_pin")
    spans = rows.select(F.col("roi").alias("file"), name.alias("name"), F.when(F.col("frame") % 4 > 0, F.col("t")).alias("onset"), F.when((F.col("frame") % 5 > 0) | (F.col("frame") % 4 == 0), F.col("t") + 2).alias("offset"))
    return behaviour_log.sync_offset(spans)


@query("whole_updates", with_views("sig_short") + f", u AS (SELECT roi AS file, CASE WHEN frame % 3 > 0 THEN t END t, value dy, CAST(frame AS DOUBLE) dt, CAST(frame AS DOUBLE) millis FROM sig_short), g AS (SELECT *, count(t) OVER (PARTITION BY file ORDER BY millis) - CASE WHEN t IS NULL THEN 0 ELSE 1 END g FROM u) SELECT file, max(t) t, {st('sum(dy)', 'dy')}, max(CASE WHEN t IS NOT NULL THEN dt END) dt, max(CASE WHEN t IS NOT NULL THEN millis END) millis FROM g GROUP BY file, g HAVING max(t) IS NOT NULL")
def whole_updates(spark, sf_dir):
    """Movements without a time added to the next update that has one."""
    f = F.col("frame").cast("double")
    rows = views.sig_short(spark, sf_dir).select(F.col("roi").alias("file"), F.when(F.col("frame") % 3 > 0, F.col("t")).alias("t"), F.col("value").alias("dy"), f.alias("dt"), f.alias("millis"))
    return rounded(behaviour_log.whole_updates(rows), "dy")


# ---------------------------------------------------------------- masks and movies

_PIXELS = "WITH px AS (SELECT vec_id roi, CAST(bin // 8 AS INT) y, CAST(bin % 8 AS INT) x, abs(CAST(v AS DOUBLE)) weight FROM (SELECT vec_id, unnest(range(len(embedding))) bin, unnest(embedding) v FROM embeddings))"


def _pixels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("roi"), F.posexplode("embedding").alias("bin", "v"))
    return e.select("roi", F.floor(F.col("bin") / 8).cast("int").alias("y"), (F.col("bin") % 8).cast("int").alias("x"), F.abs(F.col("v").cast("double")).alias("weight"))


@query("mask_names", _PIXELS + f", b AS (SELECT * FROM px QUALIFY weight > 0.6::DOUBLE * max(weight) OVER (PARTITION BY roi)), c AS (SELECT roi, avg(y) y, avg(x) x FROM b GROUP BY roi), n AS (SELECT *, lpad(CAST(CAST(floor(y) AS INT) AS VARCHAR), 4, '0') || '-' || lpad(CAST(CAST(floor(x) AS INT) AS VARCHAR), 4, '0') n FROM c), i AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY roi) i FROM n) SELECT roi, {st('y', 'y')}, {st('x', 'x')}, CASE WHEN i = 1 THEN n ELSE n || '-' || CAST(i - 1 AS VARCHAR) END AS name FROM i")
def mask_names(spark, sf_dir):
    """Masks cut at a share of their peak, their centres, and names that don't collide."""
    return rounded(masks.centroids(masks.binarised(_pixels(spark, sf_dir), ROI, 0.6), ROI), "y", "x").select("roi", "y", "x", "name")


@query("masks_inside", _PIXELS + ", b AS (SELECT * FROM px WHERE weight > 0.2::DOUBLE), s(session, yy, yx, dy, xy, xx, dx) AS (VALUES (1, 1, 0, 0, 0, 1, 5), (2, 0, 1, -3, 1, 0, 2)), h AS (SELECT roi, session, bool_or(yy * y + yx * x + dy >= 0 AND yy * y + yx * x + dy < 8 AND xy * y + xx * x + dx >= 0 AND xy * y + xx * x + dx < 8) i FROM b CROSS JOIN s GROUP BY ALL) SELECT roi, y, x, weight FROM b WHERE roi NOT IN (SELECT roi FROM h WHERE NOT i)")
def masks_inside(spark, sf_dir):
    """Masks that keep a pixel inside the image of every session."""
    sessions = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 5.0), (2, 0.0, 1.0, -3.0, 1.0, 0.0, 2.0)], "session int, yy double, yx double, dy double, xy double, xx double, dx double")
    return masks.inside_bounds(_pixels(spark, sf_dir).where("weight > 0.2"), sessions, ROI, 8, 8)


_FILM = "WITH m AS (SELECT CAST(vec_id AS INT) frame, CAST(bin // 8 AS INT) y, CAST(bin % 8 AS INT) x, CASE WHEN abs(CAST(v AS DOUBLE)) > 0.05::DOUBLE THEN CAST(v AS DOUBLE) END AS value FROM (SELECT vec_id, unnest(range(len(embedding))) bin, unnest(embedding) v FROM embeddings))"


def _film(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("frame"), F.posexplode("embedding").alias("bin", "v"))
    v = F.col("v").cast("double")
    return e.select("frame", F.floor(F.col("bin") / 8).cast("int").alias("y"), (F.col("bin") % 8).cast("int").alias("x"), F.when(F.abs(v) > 0.05, v).alias("value"))


@query("filled_in_time", _FILM + " SELECT frame, y, x, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM m")
def filled_in_time(spark, sf_dir):
    return masks.filled_in_time(_film(spark, sf_dir))


@query("time_average", _FILM + f" SELECT y, x, {st('avg(value)', 'value')} FROM m GROUP BY y, x")
def time_average(spark, sf_dir):
    return rounded(masks.time_average(_film(spark, sf_dir)), "value")


@query("live_lines", _FILM + " SELECT y FROM m GROUP BY y HAVING var_pop(value) > 1e-10")
def live_lines(spark, sf_dir):
    """Rows of the image in which anything changes."""
    return masks.live_lines(_film(spark, sf_dir), "y")


@query("bright_masks", _FILM + ", a AS (SELECT y * 8 + x roi, avg(value) v FROM m GROUP BY ALL) SELECT CAST(roi AS INT) roi, " + st("v", "value") + " FROM a WHERE v > (SELECT quantile_cont(v, 0.9) FROM a)")
def bright_masks(spark, sf_dir):
    """Masks brighter than a quantile of the mean image."""
    image = masks.time_average(_film(spark, sf_dir))
    return rounded(masks.bright(image.select((F.col("y") * 8 + F.col("x")).cast("int").alias("roi"), "value"), image, 0.9), "value").select("roi", "value")


# ---------------------------------------------------------------- mice


@query("mice_with_one_more", "SELECT c_custkey mouse_id, c_name mouse_name FROM customer UNION ALL SELECT max(c_custkey) + 1, 'jd-9' FROM customer")
def mice_with_one_more(spark, sf_dir):
    """A mouse made where none has the name; one that is there stays as it is."""
    mice = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mouse_id"), F.col("c_name").alias("mouse_name"))
    return catalog.with_mouse(catalog.with_mouse(mice, "jd-9"), "jd-9")


@query("trials_of_one_mouse", "SELECT o_orderkey trial_id, o_custkey mouse_id FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def trials_of_one_mouse(spark, sf_dir):
    trials = views.trials(spark, sf_dir)
    newest = trials.agg(F.max("mouse_id")).first()[0]
    return catalog.one_mouse(catalog.mouse_trials(trials, newest)).select("trial_id", "mouse_id")
