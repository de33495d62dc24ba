"""Registered queries over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import views
from .functions.numeric import stable
from .operators import aggregates, assignment, blocks, catalog, intervals, models, rolling, signals, simulate, spatial
from .plans import population
from .registered import ORACLE_SQL, QUERIES, ROI, query, rounded, st  # noqa: F401
from .sources import behaviour_log
from .views import read, with_views

# ---------------------------------------------------------------- tuning: the flagship plan

@query(
    "tuning_two_level",
    with_views("sig_long")
    + f", m AS (SELECT roi, lap, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, CASE WHEN discount < 0.05 THEN value END v FROM sig_long WHERE roi IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 13)), a AS (SELECT roi, lap, bin, avg(v) v FROM m GROUP BY ALL) SELECT roi, bin, {st('avg(v)', 'value')} FROM a GROUP BY ALL",
)
def tuning_two_level(spark, sf_dir):
    """Region filter by metadata, time mask, mean by lap and bin, then over laps."""
    chosen = read(spark, sf_dir, "supplier").where("s_nationkey < 13").select(F.col("s_suppkey").alias("roi"))
    masked = catalog.Filter(F.col("discount") < 0.05).mask(views.sig_long(spark, sf_dir).join(chosen, "roi", "left_semi"))
    by_lap = spatial.tuning(masked, ["roi", "lap"], 20)
    return by_lap.groupBy("roi", "bin").agg(stable(F.avg("value")).alias("value"))


# ---------------------------------------------------------------- rolling windows

for _how, _sql in {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_pop(value)", "median": "quantile_cont(value, 0.5)", "quantile": "quantile_cont(value, 0.08)"}.items():

    def _rolling(spark, sf_dir, how=_how):
        out = rolling.rolling(views.sig_short(spark, sf_dir), how, "value", 12, "r", ROI, 5, 0.08)
        return out.select("roi", "frame", stable("r").alias("r"))

    query(f"rolling_{_how}", with_views("sig_short") + f" SELECT roi, frame, {st(f'CASE WHEN count(value) OVER w >= 5 THEN {_sql} OVER w END', 'r')} FROM sig_short WINDOW w AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)")(_rolling)

GAUSS = lambda src, keys="roi", value="value", w=9, sigma=2: (
    f"(SELECT a.roi, a.frame, sum(b.{value} * exp(-0.5 * power((b.frame - a.frame + {w // 2} - {(w - 1) / 2}) / {sigma}, 2))) / sum(exp(-0.5 * power((b.frame - a.frame + {w // 2} - {(w - 1) / 2}) / {sigma}, 2))) s "
    f"FROM {src} a JOIN {src} b ON a.roi = b.roi AND b.frame BETWEEN a.frame - {w // 2} AND a.frame + {(w - 1) // 2} GROUP BY a.roi, a.frame)"
)


@query("rolling_gaussian", with_views("sig_short") + f" SELECT roi, frame, {st('s', 's')} FROM {GAUSS('sig_short')}")
def rolling_gaussian(spark, sf_dir):
    out = rolling.gaussian_rolling(views.sig_short(spark, sf_dir), "value", 9, 2, "s", ROI)
    return out.select("roi", "frame", stable("s").alias("s"))


_REFLECTED = ", f AS (SELECT roi, frame, CASE WHEN {} THEN 1 ELSE 0 END f, row_number() OVER (PARTITION BY roi ORDER BY frame) - 1 i, count(*) OVER (PARTITION BY roi) n FROM sig_short), e AS (SELECT roi, f, n, i + 2 * n * k p FROM f CROSS JOIN range(-3, 4) g(k) UNION ALL SELECT roi, f, n, 2 * n * k - 1 - i FROM f CROSS JOIN range(-3, 4) g(k)), w AS (SELECT * FROM e WHERE p >= -2 AND p < n + 2) SELECT a.roi, a.frame, sum(w.f) > 2 AS running FROM f a JOIN w ON w.roi = a.roi AND w.p BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.roi, a.frame"


@query("debounce", with_views("sig_short") + _REFLECTED.format("value > 20"))
def debounce(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir).withColumn("f", F.col("value") > 20)
    return rolling.debounced(rows, "f", 4, 1, "running", ROI).select("roi", "frame", "running")


@query("zscore", with_views("sig_long") + f" SELECT roi, frame, {st('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)', 'z')} FROM sig_long WINDOW w AS (PARTITION BY roi)")
def zscore(spark, sf_dir):
    return rolling.zscore(views.sig_long(spark, sf_dir), "value", "z", ROI).select("roi", "frame", stable("z").alias("z"))


@query("zscore_robust", with_views("sig_long") + f" SELECT roi, frame, {st('(value - quantile_cont(value, 0.5) OVER w) / nullif(quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w, 0)', 'z')} FROM sig_long WINDOW w AS (PARTITION BY roi)")
def zscore_robust(spark, sf_dir):
    return rolling.robust_zscore(views.sig_long(spark, sf_dir), "value", "z", ROI).select("roi", "frame", stable("z").alias("z"))


@query(
    "interpolate",
    with_views("sig_short")
    + f", m AS (SELECT roi, frame, CASE WHEN kind <> 'click' THEN value END v FROM sig_short), b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER p pf, last_value(v IGNORE NULLS) OVER p pv, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER n nf, first_value(v IGNORE NULLS) OVER n nv FROM m WINDOW p AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT roi, frame, {st('CASE WHEN v IS NOT NULL THEN v WHEN pf IS NOT NULL AND nf IS NOT NULL THEN pv + (nv - pv) * (frame - pf) / (nf - pf) ELSE coalesce(pv, nv) END', 'filled')} FROM b",
)
def interpolate(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir).withColumn("v", F.when(F.col("kind") != "click", F.col("value")))
    return rolling.interpolated(rows, "v", "filled", ROI, "frame").select("roi", "frame", stable("filled").alias("filled"))


@query("find_first_n", with_views("sig_short") + ", h AS (SELECT roi, frame, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) n FROM sig_short) SELECT roi, min(CASE WHEN n >= 2 THEN frame END) AS first_frame FROM h GROUP BY roi")
def find_first_n(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir).withColumn("f", F.col("value") > 30)
    return rolling.find_first_n(rows, "f", 2, 5, ROI, "frame", "first_frame")


# ---------------------------------------------------------------- signals

@query("dfof_quantile", with_views("sig_short") + f", s AS {GAUSS('sig_short', w=9, sigma=2)}, b AS (SELECT roi, frame, CASE WHEN count(s) OVER w >= 2 THEN quantile_cont(s, 0.08) OVER w END b FROM s WINDOW w AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) SELECT roi, frame, {st('CASE WHEN b <> 0 THEN (value - b) / b END', 'dfof')} FROM sig_short JOIN b USING (roi, frame)")
def dfof_quantile(spark, sf_dir):
    out = signals.quantile_dfof(views.sig_short(spark, sf_dir), ROI, 0.08, 9, 2, 0.25)
    return out.select("roi", "frame", stable("dfof").alias("dfof"))


@query("dfof_jia", with_views("sig_short") + f", m AS (SELECT roi, frame, value, avg(value) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM sig_short), b AS (SELECT *, CASE WHEN count(m) OVER w >= 3 THEN min(m) OVER w END b FROM m WINDOW w AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) SELECT roi, frame, {st('CASE WHEN b <> 0 THEN (value - b) / b END', 'dfof')} FROM b")
def dfof_jia(spark, sf_dir):
    out = signals.jia_dfof(views.sig_short(spark, sf_dir), ROI, 5, 15)
    return out.select("roi", "frame", stable("dfof").alias("dfof"))


_MM = lambda src, s: f"(SELECT roi, frame, max(n) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) b FROM (SELECT roi, frame, min(s) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) n FROM {s}))"


@query("dfof_maxmin", with_views("sig_short") + f", s AS {GAUSS('sig_short')}, b AS {_MM('sig_short', 's')} SELECT roi, frame, {st('CASE WHEN b <> 0 THEN (value - b) / b END', 'dfof')} FROM sig_short JOIN b USING (roi, frame)")
def dfof_maxmin(spark, sf_dir):
    return signals.maxmin_dfof(views.sig_short(spark, sf_dir), ROI, 9, 2).select("roi", "frame", stable("dfof").alias("dfof"))


@query("dfof_neuropil", with_views("sig_long") + f", d AS (SELECT roi, frame, raw - npil AS value, npil FROM sig_long), s1 AS {GAUSS('d')}, b1 AS {_MM('d', 's1')}, s2 AS {GAUSS('d', value='npil')}, b2 AS {_MM('d', 's2')} SELECT d.roi, d.frame, {st('CASE WHEN b1.b + b2.b <> 0 THEN (value - b1.b) / (b1.b + b2.b) END', 'dfof')} FROM d JOIN b1 USING (roi, frame) JOIN b2 USING (roi, frame)")
def dfof_neuropil(spark, sf_dir):
    return signals.neuropil_dfof(views.sig_long(spark, sf_dir), ROI, 9, 2).select("roi", "frame", stable("dfof").alias("dfof"))


@query("mad_filter", with_views("sig_short") + f", m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY roi) m FROM sig_short), d AS (SELECT *, quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY roi) mad FROM m) SELECT roi, frame, {st('CASE WHEN value > 3 * mad THEN value ELSE 0.0 END', 'spikes')} FROM d")
def mad_filter(spark, sf_dir):
    return signals.mad_filter(views.sig_short(spark, sf_dir), "value", "spikes", ROI).select("roi", "frame", stable("spikes").alias("spikes"))


@query("velocity", with_views("sig_long") + f", d AS (SELECT roi, frame, position - lag(position) OVER (PARTITION BY roi ORDER BY frame) d FROM sig_long) SELECT roi, frame, {st('coalesce(last_value(CASE WHEN abs(d) <= 0.2::DOUBLE THEN d END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)', 'velocity')} FROM d")
def velocity(spark, sf_dir):
    return signals.velocity(views.sig_long(spark, sf_dir), ROI).select("roi", "frame", stable("velocity").alias("velocity"))


@query("ar_coefficients", with_views("sig_short") + f", c AS (SELECT roi, frame, value - avg(value) OVER (PARTITION BY roi) x FROM sig_short), l AS (SELECT roi, x, lag(x, 1) OVER w l1, lag(x, 2) OVER w l2 FROM c WINDOW w AS (PARTITION BY roi ORDER BY frame)), r AS (SELECT roi, (sum(x * l1) / count(x)) / avg(x * x) r1, (sum(x * l2) / count(x)) / avg(x * x) r2 FROM l GROUP BY roi) SELECT roi, {st('r1', 'ar1')}, {st('r1 * (1 - r2) / (1 - r1 * r1)', 'ar2_1')}, {st('(r2 - r1 * r1) / (1 - r1 * r1)', 'ar2_2')} FROM r")
def ar_coefficients(spark, sf_dir):
    return rounded(signals.ar_coefficients(views.sig_short(spark, sf_dir), ROI), "ar1", "ar2_1", "ar2_2")


@query("oasis_spikes")
def oasis_spikes(spark, sf_dir):
    """Deconvolved spikes; sequential, so without SQL: tests check the fit against its conditions."""
    return signals.oasis_ar1(views.sig_short(spark, sf_dir).select("roi", "frame", "value"), ROI, 0.87)


# ---------------------------------------------------------------- events

_RUNS = "r AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY frame) - 1 AS run FROM (SELECT roi, frame, f, lag(f) OVER (PARTITION BY roi ORDER BY frame) p FROM m))"


@query("event_runs", with_views("sig_short") + f", m AS (SELECT roi, frame, value > 15 f FROM sig_short), {_RUNS} SELECT roi, CAST(run AS INT) run, min(frame) onset, max(frame) + 1 AS \"offset\" FROM r WHERE f GROUP BY roi, run")
def event_runs(spark, sf_dir):
    return intervals.runs(views.sig_short(spark, sf_dir), F.col("value") > 15, ROI)


@query("circular_runs", with_views("curves") + ", m AS (SELECT roi, bin frame, value > 0.1::DOUBLE f FROM curves), " + _RUNS + ", g AS (SELECT roi, run, min(frame) a, max(frame) + 1 b FROM r WHERE f GROUP BY roi, run), h AS (SELECT *, min(CASE WHEN a = 0 THEN b END) OVER (PARTITION BY roi) head, max(CASE WHEN b = 64 THEN a END) OVER (PARTITION BY roi) tail FROM g), k AS (SELECT roi, a, CASE WHEN head IS NOT NULL AND tail > 0 AND b = 64 THEN head ELSE b END b FROM h WHERE NOT (head IS NOT NULL AND coalesce(tail, 0) > 0 AND a = 0)) SELECT roi, CAST(row_number() OVER (PARTITION BY roi ORDER BY a) - 1 AS INT) run, a AS onset, b AS \"offset\" FROM k")
def circular_runs(spark, sf_dir):
    return intervals.runs(views.curves(spark, sf_dir), F.col("value") > F.lit(0.1), ROI, "bin", circular=64)


_HYST = with_views("sig_short") + ", z AS (SELECT roi, frame, value / stddev_pop(value) OVER (PARTITION BY roi) x FROM sig_short), d AS (SELECT *, coalesce(last_value(CASE WHEN x > 2 THEN 1 WHEN x < 0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) s, max(frame) OVER (PARTITION BY roi) z FROM z), e AS (SELECT *, sum(CASE WHEN s = 1 AND coalesce(p, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY frame) ev FROM (SELECT *, lag(s) OVER (PARTITION BY roi ORDER BY frame) p FROM d)), ev AS (SELECT roi, greatest(min(frame) - 1, 0) onset, max(frame) AS \"offset\", max(x) amplitude, min_by(frame, (-x, frame)) peak FROM e WHERE s = 1 GROUP BY roi, ev, z HAVING max(frame) < z)"


@query("hysteresis_events", _HYST + f' SELECT roi, onset, "offset", {st("amplitude", "amplitude")}, peak FROM ev')
def hysteresis_events(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir).withColumn("x", F.col("value") / F.stddev_pop("value").over(Window.partitionBy("roi")))
    return rounded(intervals.hysteresis(rows, "x", 2, 0.5, ROI), "amplitude")


@query("transients", _HYST + f', t AS (SELECT *, ("offset" - onset) / 10.0::DOUBLE duration FROM ev) SELECT roi, onset, "offset", {st("amplitude", "amplitude")}, peak, {st("duration", "duration")} FROM t WHERE duration > 0.1::DOUBLE')
def transients(spark, sf_dir):
    return rounded(signals.transients(views.sig_short(spark, sf_dir), "value", ROI, 10.0), "amplitude", "duration")


@query("event_histogram", _HYST + ', t AS (SELECT least(floor(2 * amplitude) - 4, 6) a, least(floor(4 * ("offset" - onset)), 19) d FROM ev) SELECT CAST(g.a AS INT) a, CAST(h.d AS INT) d, (SELECT count(*) FROM t WHERE t.a >= g.a AND t.d >= h.d) n FROM range(7) g(a), range(20) h(d)')
def event_histogram(spark, sf_dir):
    found = signals.transients(views.sig_short(spark, sf_dir), "value", ROI, 1.0, shortest=-1)
    return signals.event_histogram(found)


@query("frames_in_events", with_views("sig_short") + f", m AS (SELECT roi, frame, value > 15 f FROM sig_short), {_RUNS}, e AS (SELECT roi, min(frame) a, max(frame) + 1 b FROM r WHERE f GROUP BY roi, run HAVING count(*) >= 2) SELECT roi, frame, value FROM sig_short s WHERE EXISTS (SELECT 1 FROM e WHERE e.roi = s.roi AND s.frame >= a AND s.frame < b)")
def frames_in_events(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir)
    found = intervals.runs(rows, F.col("value") > 15, ROI).where("offset - onset >= 2")
    return intervals.frames_in(rows, found, ROI).select("roi", "frame", "value")


@query("lap_blocks", with_views("sig_short") + ", c AS (SELECT roi, frame, kind, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w AND lag(frame) OVER w IS NOT NULL THEN 1 ELSE 0 END c FROM sig_short WINDOW w AS (PARTITION BY roi ORDER BY frame)), b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY roi ORDER BY frame) AS INT) block FROM c) SELECT roi, block, min(kind) kind, min(frame) first_frame, count(*) n FROM b GROUP BY roi, block")
def lap_blocks(spark, sf_dir):
    out = intervals.blocks(views.sig_short(spark, sf_dir), "kind", ROI, "frame")
    return out.groupBy("roi", "block").agg(F.min("kind").alias("kind"), F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("n"))


@query("paired_messages", with_views("sig_short") + ", m AS (SELECT roi, frame t, kind FROM sig_short WHERE kind IN ('view', 'purchase')), n AS (SELECT *, lead(kind) OVER w nk, lead(t) OVER w nt, lag(kind) OVER w pk FROM m WINDOW w AS (PARTITION BY roi ORDER BY t)) SELECT roi, CAST(t AS DOUBLE) onset, CAST(CASE WHEN nk = 'purchase' THEN nt END AS DOUBLE) AS \"offset\" FROM n WHERE kind = 'view' UNION ALL SELECT roi, NULL, t FROM n WHERE kind = 'purchase' AND (pk IS NULL OR pk = 'purchase')")
def paired_messages(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir).where(F.col("kind").isin("view", "purchase")).select("roi", F.col("frame").cast("double").alias("t"), "kind")
    return intervals.paired(rows, "kind", "view", "purchase", ROI)


# ---------------------------------------------------------------- as-of and window joins, PSTH

@query("as_of_join", with_views("sig_short") + ", p AS (SELECT roi, t FROM sig_short WHERE kind = 'purchase'), v AS (SELECT roi, t, value FROM sig_short WHERE kind = 'view') SELECT p.roi, p.t, (SELECT arg_max(value, v.t) FROM v WHERE v.roi = p.roi AND v.t < p.t) AS value FROM p")
def as_of_join(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir)
    left = rows.where("kind = 'purchase'").select("roi", "t")
    return intervals.as_of(left, rows.where("kind = 'view'").select("roi", "t", "value"), "value", ROI)


_PSTH = with_views("sig_short") + ", g AS (SELECT roi, t AS \"trigger\" FROM sig_short WHERE kind = 'purchase'), n AS (SELECT g.roi, g.trigger, s.value, s.t - g.trigger rel FROM g JOIN sig_short s ON s.roi = g.roi AND s.t >= g.trigger - 86400 AND s.t <= g.trigger + 86400)"


@query("psth", _PSTH + f", b AS (SELECT roi, CAST(floor(rel / 7200) AS INT) bin, value FROM n) SELECT roi, bin, count(*) n, {st('avg(value)', 'value')} FROM b GROUP BY ALL")
def psth(spark, sf_dir):
    """Mean signal by time from each trigger."""
    rows = views.sig_short(spark, sf_dir)
    near = intervals.around(rows.select("roi", "t", "value"), rows.where("kind = 'purchase'").select("roi", F.col("t").alias("trigger")), 86400, 86400, ROI)
    return near.groupBy("roi", F.floor(F.col("rel") / 7200).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), stable(F.avg("value")).alias("value"))


@query("responsiveness", _PSTH + f", e AS (SELECT roi, trigger, avg(CASE WHEN rel <= 0 THEN value END) pre, avg(CASE WHEN rel >= 0 THEN value END) post FROM n GROUP BY ALL) SELECT roi, {st('avg(post - pre)', 'response')}, {st('avg(CASE WHEN post + pre <> 0 THEN (post - pre) / (post + pre) END)', 'contrast')} FROM e GROUP BY roi")
def responsiveness(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir)
    near = intervals.around(rows.select("roi", "t", "value"), rows.where("kind = 'purchase'").select("roi", F.col("t").alias("trigger")), 86400, 86400, ROI)
    e = near.groupBy("roi", "trigger").agg(F.avg(F.when(F.col("rel") <= 0, F.col("value"))).alias("pre"), F.avg(F.when(F.col("rel") >= 0, F.col("value"))).alias("post"))
    both = F.col("post") + F.col("pre")
    return e.groupBy("roi").agg(stable(F.avg(F.col("post") - F.col("pre"))).alias("response"), stable(F.avg(F.when(both != 0, (F.col("post") - F.col("pre")) / both))).alias("contrast"))


# ---------------------------------------------------------------- aggregates

@query("moments", with_views("sig_long") + f", m AS (SELECT roi, value, value - avg(value) OVER (PARTITION BY roi) x FROM sig_long) SELECT roi, {st('avg(value)', 'mean')}, {st('stddev_pop(value)', 'std')}, {st('max(value)', 'max')}, {st('min(value)', 'min')}, {st('quantile_cont(value, 0.5)', 'median')}, {st('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')}, {st('avg(x * x * x) / power(avg(x * x), 1.5)', 'skew')}, {st('avg(x * x * x * x) / power(avg(x * x), 2) - 3', 'kurtosis')} FROM m GROUP BY roi")
def moments(spark, sf_dir):
    out = aggregates.moments(views.sig_long(spark, sf_dir), "value", ROI).drop("var")
    return rounded(out, *out.columns[1:])


@query("cumulants", with_views("sig_short") + f", c AS (SELECT roi, value - avg(value) OVER (PARTITION BY roi) x, value FROM sig_short), s AS (SELECT roi, CAST(count(*) AS DOUBLE) n, avg(value) k1, avg(x * x) m2, avg(x * x * x) m3, avg(x * x * x * x) m4 FROM c GROUP BY roi) SELECT roi, {st('k1', 'k1')}, {st('n * m2 / (n - 1)', 'k2')}, round(n * n * m3 / ((n - 1) * (n - 2)) + 1e-8::DOUBLE, 3) AS k3 FROM s")
def cumulants(spark, sf_dir):
    out = aggregates.cumulants(views.sig_short(spark, sf_dir), "value", ROI)
    return out.select("roi", stable("k1").alias("k1"), stable("k2").alias("k2"), F.round(F.col("k3") + 1e-8, 3).alias("k3"))


@query("means", with_views("sig_long") + f" SELECT roi, {st('exp(avg(ln(value)))', 'gmean')}, {st('count(*) / sum(1 / value)', 'hmean')} FROM sig_long GROUP BY roi")
def means(spark, sf_dir):
    return rounded(aggregates.means(views.sig_long(spark, sf_dir), "value", ROI), "gmean", "hmean")


@query("histogram", with_views("sig_short") + ", c AS (SELECT roi, CAST(least(floor(value / 5.0::DOUBLE), 9) AS INT) bin, count(*) n FROM sig_short WHERE value >= 0 AND value <= 50 GROUP BY ALL) SELECT r.roi, CAST(b.bin AS INT) bin, coalesce(c.n, 0) n FROM (SELECT DISTINCT roi FROM sig_short) r CROSS JOIN range(10) b(bin) LEFT JOIN c ON c.roi = r.roi AND c.bin = b.bin")
def histogram(spark, sf_dir):
    return aggregates.histogram(views.sig_short(spark, sf_dir), "value", 0.0, 50.0, 10, ROI)


@query("curve_features", with_views("curves") + f", t AS (SELECT *, sum(value) OVER w t, quantile_cont(value, 0.5) OVER w m FROM curves WINDOW w AS (PARTITION BY roi)) SELECT roi, {st('-sum(CASE WHEN value > 0 THEN value / t * ln(value / t) ELSE 0 END)', 'entropy')}, min_by(bin, (-value, bin)) peak, {st('1.4826::DOUBLE * quantile_cont(abs(value - m), 0.5)', 'mad')} FROM t GROUP BY roi")
def curve_features(spark, sf_dir):
    return rounded(aggregates.curve_features(views.curves(spark, sf_dir), ROI), "entropy", "mad")


@query("trend", with_views("sig_long") + f" SELECT roi, {st('regr_slope(value, position)', 'slope')}, {st('regr_intercept(value, position)', 'intercept')}, {st('regr_r2(value, position)', 'r2')} FROM sig_long GROUP BY roi")
def trend(spark, sf_dir):
    return rounded(aggregates.trend(views.sig_long(spark, sf_dir), "value", "position", ROI), "slope", "intercept", "r2")


# ---------------------------------------------------------------- spatial

@query("raster", with_views("sig_long") + f", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL) SELECT k.roi, k.lap, CAST(b.bin AS INT) bin, {st('coalesce(v, 0)', 'value')} FROM (SELECT DISTINCT roi, lap FROM sig_long) k CROSS JOIN range(10) b(bin) LEFT JOIN t ON t.roi = k.roi AND t.lap = k.lap AND t.bin = b.bin")
def raster(spark, sf_dir):
    return rounded(spatial.raster(views.sig_long(spark, sf_dir), ["roi", "lap"], 10, 0.0), "value")


@query("occupancy", with_views("sig_long") + f" SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, count(*) samples, {st('count(*) / sum(count(*)) OVER (PARTITION BY roi)', 'share')} FROM sig_long GROUP BY roi, CAST(floor(position * 20.0::DOUBLE) AS INT)")
def occupancy(spark, sf_dir):
    return rounded(spatial.occupancy(views.sig_long(spark, sf_dir), ROI, 20), "share")


_K = [round(x, 15) for x in spatial.gaussian_kernel(8, 1.0)]


@query("smooth_same", with_views("curves") + f", k AS (SELECT unnest(range(8)) i, unnest({spatial.gaussian_kernel(8, 1.0)}::DOUBLE[]) w) SELECT a.roi, a.bin, {st('sum(b.value * k.w)', 'smoothed')} FROM curves a JOIN curves b ON a.roi = b.roi AND b.bin BETWEEN a.bin - 4 AND a.bin + 3 JOIN k ON k.i = 3 - (b.bin - a.bin) GROUP BY a.roi, a.bin")
def smooth_same(spark, sf_dir):
    return spatial.smooth_same(views.curves(spark, sf_dir), ROI, 1.0, 8).select("roi", "bin", stable("smoothed").alias("smoothed"))


@query("smooth_wrapped", with_views("curves") + f", o AS (SELECT unnest(range(-8, 9)) o), k AS (SELECT o, exp(-0.5 * power(o / 2.0, 2)) / sum(exp(-0.5 * power(o / 2.0, 2))) OVER () w FROM o) SELECT a.roi, a.bin, {st('sum(b.value * w)', 'smoothed')} FROM curves a CROSS JOIN k JOIN curves b ON b.roi = a.roi AND b.bin = (a.bin + k.o + 64) % 64 GROUP BY a.roi, a.bin")
def smooth_wrapped(spark, sf_dir):
    return rounded(spatial.smooth_wrapped(views.curves(spark, sf_dir), ROI, 2.0), "smoothed")


#: Offsets of the shuffles in SQL: ``spatial.offsets``.
_DRAW = "(SELECT *, (x2 * x2 + 12345) % 2147483647 % n off FROM (SELECT *, (x1 * x1 + lap) % 2147483647 x2 FROM (SELECT *, (x0 * x0 + shuffle) % 2147483647 x1 FROM (SELECT *, (17 + 7919 * shuffle + 104729 * lap) % 2147483647 x0 FROM {}))))"
_NULL = (
    with_views("sig_long")
    + ", x AS (SELECT roi, lap, position, value, row_number() OVER (PARTITION BY roi, lap ORDER BY frame) - 1 i, count(*) OVER (PARTITION BY roi, lap) n FROM sig_long), l AS (SELECT DISTINCT roi, lap, n FROM x), o AS (SELECT roi, CAST(lap AS BIGINT) lap, n, CAST(s.s AS BIGINT) shuffle FROM l, range(100) s(s)), d AS "
    + _DRAW.format("o")
    + ", sh AS (SELECT d.shuffle, x.roi, x.lap, x.value, (x.i - d.off + x.n) % x.n j FROM x JOIN d USING (roi, lap)), p AS (SELECT sh.shuffle, sh.roi, CAST(floor(x.position * 20.0::DOUBLE) AS INT) bin, avg(sh.value) v FROM sh JOIN x ON x.roi = sh.roi AND x.lap = sh.lap AND x.i = sh.j GROUP BY ALL), th AS (SELECT roi, bin, quantile_cont(v, 0.95) threshold FROM p GROUP BY ALL)"
)


@query("null_threshold", _NULL + f" SELECT roi, bin, {st('threshold', 'threshold')} FROM th")
def null_threshold(spark, sf_dir):
    return rounded(spatial.null_threshold(views.sig_long(spark, sf_dir), ROI, "lap", 20, 100, 0.05), "threshold")


_FIELDS = (
    ", c AS (SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), m AS (SELECT c.roi, c.bin frame, c.v > th.threshold f FROM c JOIN th USING (roi, bin)), "
    "r AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY frame) - 1 AS run FROM (SELECT roi, frame, f, lag(f) OVER (PARTITION BY roi ORDER BY frame) p FROM m)), "
    "g AS (SELECT roi, run, min(frame) a, max(frame) + 1 b FROM r WHERE f GROUP BY roi, run), h AS (SELECT *, min(CASE WHEN a = 0 THEN b END) OVER (PARTITION BY roi) head, max(CASE WHEN b = 20 THEN a END) OVER (PARTITION BY roi) tail FROM g), "
    "k AS (SELECT roi, a, CASE WHEN head IS NOT NULL AND tail > 0 AND b = 20 THEN head ELSE b END b FROM h WHERE NOT (head IS NOT NULL AND coalesce(tail, 0) > 0 AND a = 0)), "
    "w AS (SELECT roi, a, b, CASE WHEN (b - a + 20) % 20 = 0 THEN 20 ELSE (b - a + 20) % 20 END width FROM k), "
    "t AS (SELECT roi, lap, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), "
    "q AS (SELECT w.roi, w.a, w.b, w.width, t.lap, avg(t.v) v FROM w JOIN t ON t.roi = w.roi AND (t.bin - w.a + 20) % 20 < w.width GROUP BY ALL) "
    "SELECT roi, a AS start_bin, b AS stop_bin, CAST(width AS INT) width, count(*) active_laps FROM q WHERE v > 0 GROUP BY ALL HAVING count(*) >= 3"
)


@query("place_fields", _NULL + _FIELDS)
def place_fields(spark, sf_dir):
    """Place fields by the shuffle test."""
    return spatial.place_fields(views.sig_long(spark, sf_dir), ROI, "lap", 20, 100, 0.05)


@query("information", with_views("sig_long") + f", t AS (SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v, count(*) c FROM sig_long GROUP BY ALL), q AS (SELECT *, c / sum(c) OVER w p, sum(v) OVER w sv, count(*) OVER w n FROM t WINDOW w AS (PARTITION BY roi)), r AS (SELECT *, sum(p * v) OVER (PARTITION BY roi) rate FROM q) SELECT roi, {st('sum(p * v / rate * log2(v / rate))', 'skaggs')}, {st('-sum(v / sv * log2(v / sv))', 'entropy')}, {st('log2(max(n)) + sum(v / sv * log2(v / sv))', 'tuning_score')} FROM r GROUP BY roi")
def information(spark, sf_dir):
    rows = views.sig_long(spark, sf_dir)
    t = spatial.tuning(rows, ROI, 20).join(spatial.occupancy(rows, ROI, 20), ["roi", "bin"])
    return rounded(spatial.information(t, ROI, "share"), "skaggs", "entropy", "tuning_score")


@query("centres", with_views("curves") + f" SELECT roi, {st('sum(bin * value) / sum(value)', 'com')}, {st('atan2(sum(sin(bin * 2 * pi() / 63) * value), sum(cos(bin * 2 * pi() / 63) * value))', 'centroid')}, min_by(bin, (-value, bin)) peak FROM curves GROUP BY roi")
def centres(spark, sf_dir):
    return rounded(spatial.centres(views.curves(spark, sf_dir), ROI, 64), "com", "centroid")


@query("field_width", with_views("curves") + ", t AS (SELECT *, max(value) OVER (PARTITION BY roi) top FROM curves), p AS (SELECT *, min(CASE WHEN value = top THEN bin END) OVER (PARTITION BY roi) peak FROM t), q AS (SELECT roi, max(CASE WHEN value < 0.05::DOUBLE * top AND bin < peak THEN bin END) l, min(CASE WHEN value < 0.05::DOUBLE * top AND bin > peak THEN bin END) r FROM p GROUP BY roi) SELECT roi, CAST(coalesce(r, 64) - coalesce(l, -1) - 1 AS INT) width FROM q")
def field_width(spark, sf_dir):
    return spatial.field_width(views.curves(spark, sf_dir), ROI)


@query("kuiper", with_views("sig_long") + f", c AS (SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, count(*) b, sum(CASE WHEN discount > 0.07 THEN 1 ELSE 0 END) a FROM sig_long GROUP BY ALL), d AS (SELECT roi, sum(a) OVER w / sum(a) OVER (PARTITION BY roi) - sum(b) OVER w / sum(b) OVER (PARTITION BY roi) d FROM c WINDOW w AS (PARTITION BY roi ORDER BY bin)) SELECT roi, {st('greatest(max(d), 0) - least(min(d), 0)', 'kuiper')} FROM d GROUP BY roi")
def kuiper(spark, sf_dir):
    rows = views.sig_long(spark, sf_dir).withColumn("bin", spatial.bin_floor(F.col("position"), 20))
    count = lambda df: df.groupBy("roi", "bin").agg(F.count(F.lit(1)).alias("n"))
    return rounded(spatial.kuiper(count(rows.where("discount > 0.07")), count(rows), ROI), "kuiper")


_ACF = with_views("curves") + ", c AS (SELECT roi, bin, value - avg(value) OVER (PARTITION BY roi) x FROM curves), l AS (SELECT unnest(range(-32, 33)) lag), f AS (SELECT a.roi, l.lag, sum(a.x * b.x) / sum(a.x * a.x) acf FROM c a CROSS JOIN l JOIN c b ON b.roi = a.roi AND b.bin = (a.bin + l.lag + 64) % 64 GROUP BY a.roi, l.lag)"


@query("autocorrelation", _ACF + f" SELECT roi, CAST(lag AS INT) lag, {st('acf', 'acf')} FROM f")
def autocorrelation(spark, sf_dir):
    return rounded(spatial.autocorrelation(views.curves(spark, sf_dir), ROI, 32), "acf")


@query("autocorrelation_width", _ACF + " SELECT roi, CAST(2 * coalesce(min(CASE WHEN lag >= 0 AND acf < 0.2::DOUBLE THEN lag END), 0) AS INT) width FROM f GROUP BY roi")
def autocorrelation_width(spark, sf_dir):
    return spatial.autocorrelation_width(spatial.autocorrelation(views.curves(spark, sf_dir), ROI, 32), ROI, 0.2)


@query("population_vector_correlations", with_views("curves") + f" SELECT a.context, a.bin AS a, b.bin AS b, {st('corr(a.value, b.value)', 'r')}, count(*) n FROM curves a JOIN curves b ON a.context = b.context AND a.roi = b.roi AND a.bin < b.bin GROUP BY ALL")
def population_vector_correlations(spark, sf_dir):
    return rounded(spatial.curve_correlations(views.curves(spark, sf_dir), "bin", "roi", ["context"]), "r")


@query("tuning_curve_correlations", with_views("sig_long") + f", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL) SELECT a.roi, a.lap AS a, b.lap AS b, {st('corr(a.v, b.v)', 'r')}, count(*) n FROM t a JOIN t b ON a.roi = b.roi AND a.bin = b.bin AND a.lap < b.lap GROUP BY ALL")
def tuning_curve_correlations(spark, sf_dir):
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10)
    return rounded(spatial.curve_correlations(t, "lap", "bin", ["roi"]), "r")


_XC = with_views("sig_long") + ", t AS (SELECT roi, lap, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), x AS (SELECT a.lap a, b.lap b, l.lag, corr(a.v, b.v) r FROM t a JOIN t b ON a.roi = b.roi AND a.lap < b.lap JOIN (SELECT unnest(range(-9, 11)) lag) l ON a.bin = ((b.bin - l.lag) % 20 + 20) % 20 GROUP BY a.lap, b.lap, l.lag)"


@query("cross_correlation", _XC + f" SELECT a, b, CAST(lag AS INT) lag, {st('r', 'r')} FROM x")
def cross_correlation(spark, sf_dir):
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 20)
    return rounded(spatial.cross_correlation(t, "lap", ROI, 20, -9, 10), "r")


@query("spatial_drift", _XC + f" SELECT a, b, {st('max(r)', 'r')}, CAST(min_by(lag, (-r, abs(lag), lag)) AS INT) lag FROM x GROUP BY a, b HAVING max(r) >= 0.05::DOUBLE")
def spatial_drift(spark, sf_dir):
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 20)
    return rounded(spatial.drift(spatial.cross_correlation(t, "lap", ROI, 20, -9, 10), 0.05), "r")


# ---------------------------------------------------------------- catalog

@query("trials_with_attributes", with_views("trials", "trial_attributes") + " SELECT trial_id, mouse_id, start_time, price FROM trials t WHERE EXISTS (SELECT 1 FROM trial_attributes a WHERE a.trial_id = t.trial_id AND attribute = 'status' AND value = 'F') AND EXISTS (SELECT 1 FROM trial_attributes a WHERE a.trial_id = t.trial_id AND attribute = 'priority' AND value = '1-URGENT')")
def trials_with_attributes(spark, sf_dir):
    return catalog.with_all(views.trials(spark, sf_dir), views.trial_attributes(spark, sf_dir), {"status": "F", "priority": "1-URGENT"})


@query("metadata_join", with_views("sig_short") + f" SELECT c_mktsegment AS segment, count(*) n, {st('avg(value)', 'value')} FROM sig_short LEFT JOIN customer ON c_custkey = roi GROUP BY ALL")
def metadata_join(spark, sf_dir):
    meta = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("roi"), F.col("c_mktsegment").alias("segment"))
    return catalog.annotate(views.sig_short(spark, sf_dir), meta, ROI).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), stable(F.avg("value")).alias("value"))


@query("filter_algebra", with_views("sig_short") + " SELECT roi, frame, (value > 10 AND kind <> 'view') AS a_and_b, (value > 10 OR kind <> 'view') AS a_or_b, NOT (value > 10) AS not_a, ((value > 10) <> (kind <> 'view')) AS a_xor_b, (value > 10 OR NOT (kind <> 'view')) AS a_minus_b, (value > 10 AND NOT (kind <> 'view')) AS a_and_not_b FROM sig_short")
def filter_algebra(spark, sf_dir):
    a, b = catalog.Filter(F.col("value") > 10), catalog.Filter(F.col("kind") != "view")
    return views.sig_short(spark, sf_dir).select("roi", "frame", (a & b).column.alias("a_and_b"), (a | b).column.alias("a_or_b"), (~a).column.alias("not_a"), (a ^ b).column.alias("a_xor_b"), (a - b).column.alias("a_minus_b"), a.and_not(b).column.alias("a_and_not_b"))


@query("pair_experiments", with_views("trials") + ", p AS (SELECT a.mouse_id, a.trial_id l, b.trial_id r, abs(epoch(a.start_time) - epoch(b.start_time)) d FROM trials a JOIN trials b ON a.mouse_id = b.mouse_id AND a.price > 200000 AND b.price <= 200000 WHERE abs(epoch(a.start_time) - epoch(b.start_time)) <= 2592000) SELECT mouse_id, l AS left_id, min_by(r, (d, r)) right_id, CAST(min(d) AS DOUBLE) apart FROM p GROUP BY ALL")
def pair_experiments(spark, sf_dir):
    t = views.trials(spark, sf_dir).select("mouse_id", F.col("trial_id").alias("id"), F.col("start_time").alias("time"), "price")
    return catalog.pair_within(t.where("price > 200000"), t.where("price <= 200000"), "mouse_id", 2592000)


@query("newest_trials", with_views("trials") + " SELECT trial_id, mouse_id, start_time FROM trials QUALIFY row_number() OVER (PARTITION BY mouse_id ORDER BY start_time DESC, trial_id) <= 2")
def newest_trials(spark, sf_dir):
    t = views.trials(spark, sf_dir).withColumn("k", F.struct((-F.unix_micros(F.col("start_time").cast("timestamp"))).alias("t"), "trial_id"))
    return catalog.newest(t, ["mouse_id"], F.col("k"), 2).select("trial_id", "mouse_id", "start_time")


@query("json_log", "SELECT user_id AS roi, count(*) n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) k FROM events GROUP BY user_id")
def json_log(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("roi"), F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("attributes_map", with_views("trial_attributes") + ", m AS (SELECT trial_id, max(CASE WHEN attribute = 'status' THEN value END) s, max(CASE WHEN attribute = 'priority' THEN value END) p FROM trial_attributes GROUP BY trial_id) SELECT trial_id, s AS status, p AS priority, 2::BIGINT n FROM m")
def attributes_map(spark, sf_dir):
    m = catalog.attributes_as_map(views.trial_attributes(spark, sf_dir))
    return m.select("trial_id", F.col("attributes")["status"].alias("status"), F.col("attributes")["priority"].alias("priority"), F.size("attributes").cast("long").alias("n"))


@query("attribute_upsert", with_views("trial_attributes") + " SELECT trial_id, attribute, CASE WHEN attribute = 'status' AND value = 'F' THEN 'done' ELSE value END AS value FROM trial_attributes")
def attribute_upsert(spark, sf_dir):
    old = views.trial_attributes(spark, sf_dir)
    new = old.where("attribute = 'status' and value = 'F'").withColumn("value", F.lit("done"))
    return catalog.upsert(old, new, ["trial_id", "attribute"])


# ---------------------------------------------------------------- behaviour

@query("laps_from_position", with_views("sig_long") + ", f AS (SELECT roi, frame t, CASE WHEN position - lag(position) OVER (PARTITION BY roi ORDER BY frame) < -0.75::DOUBLE THEN 1 ELSE 0 END f FROM sig_long) SELECT roi, t, CAST(sum(f) OVER (PARTITION BY roi ORDER BY t) AS INT) lap FROM f")
def laps_from_position(spark, sf_dir):
    rows = views.sig_long(spark, sf_dir).select("roi", F.col("frame").alias("t"), "position")
    return behaviour_log.laps(rows, ROI).select("roi", "t", "lap")


@query("zero_order_hold", with_views("sig_short") + ", v AS (SELECT roi, t, value FROM sig_short WHERE kind = 'view'), g AS (SELECT r.roi, 1704067200 + 43200.0::DOUBLE * i t FROM (SELECT DISTINCT roi FROM sig_short) r, range(60) x(i)) SELECT g.roi, g.t, coalesce((SELECT arg_max(v.value, v.t) FROM v WHERE v.roi = g.roi AND v.t <= g.t), (SELECT arg_max(v.value, v.t) FROM v WHERE v.roi = g.roi)) AS value FROM g")
def zero_order_hold(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir)
    grid = rows.select("roi").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("roi", (F.lit(1704067200.0) + F.col("i") * F.lit(43200.0)).alias("t"))
    return behaviour_log.hold(rows.where("kind = 'view'").select("roi", "t", "value"), grid, ROI)


@query("interval_frames", with_views("sig_short") + ", i AS (SELECT roi, frame * 0.7::DOUBLE a, frame * 0.7::DOUBLE + value / 10 b FROM sig_short WHERE kind = 'click'), f AS (SELECT roi, greatest(CAST(floor(a / 0.5::DOUBLE) AS INT), 0) a, least(CAST(floor(b / 0.5::DOUBLE) AS INT), 99) b FROM i) SELECT DISTINCT roi, CAST(g AS INT) frame FROM f, range(100) r(g) WHERE g >= a AND g <= b")
def interval_frames(spark, sf_dir):
    rows = views.sig_short(spark, sf_dir).where("kind = 'click'")
    spans = rows.select("roi", (F.col("frame") * F.lit(0.7)).alias("onset"), (F.col("frame") * F.lit(0.7) + F.col("value") / 10).alias("offset"))
    return behaviour_log.interval_frames(spans, 0.5, 50.0, ROI)


# ---------------------------------------------------------------- population plans

@query("first_lap_statistics", with_views("sig_long") + f", t AS (SELECT roi, lap, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), a AS (SELECT *, max(v) OVER (PARTITION BY roi) top, max(v) OVER (PARTITION BY roi, lap) lt FROM t), b AS (SELECT *, min(CASE WHEN lt > 0.97::DOUBLE * top THEN lap END) OVER (PARTITION BY roi) fl FROM a), c AS (SELECT roi, fl, sum(CASE WHEN lap = fl THEN bin * v END) / sum(CASE WHEN lap = fl THEN v END) fc, sum(CASE WHEN lap > fl THEN bin * v END) / sum(CASE WHEN lap > fl THEN v END) lc, max(CASE WHEN lap = fl THEN v END) fp, max(CASE WHEN lap > fl THEN v END) lp FROM b WHERE lap >= fl GROUP BY roi, fl) SELECT roi, fl first_lap, {st('fc', 'first_com')}, {st('lc', 'later_com')}, {st('fp', 'first_peak')}, {st('lp', 'later_peak')}, {st('lc - fc', 'shift')}, {st('(fp - lp) / (fp + lp)', 'gain')} FROM c")
def first_lap_statistics(spark, sf_dir):
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 20)
    out = population.first_lap_statistics(t, ROI, onset_part=0.97)
    return rounded(out, "first_com", "later_com", "first_peak", "later_peak", "shift", "gain")


@query("centred_raster", with_views("curves") + ", c AS (SELECT roi, sum(bin * value) / sum(value) centre FROM curves GROUP BY roi), r AS (SELECT k.roi, context, CAST(((bin - CAST(round(centre) AS INT) + 32) % 64 + 64) % 64 - 32 AS INT) rel, value FROM curves k JOIN c ON c.roi = k.roi) SELECT roi, context, rel, value FROM r WHERE abs(rel) <= 10")
def centred_raster(spark, sf_dir):
    c = views.curves(spark, sf_dir)
    centre = spatial.centres(c, ROI, 64).select("roi", F.col("com").alias("centre"))
    return population.centred_raster(c, centre, ROI, 64, 10)


@query("block_tuning", with_views("sig_long") + f", t AS (SELECT roi, lap, lap // 4 block, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), o AS (SELECT *, dense_rank() OVER (PARTITION BY roi, block ORDER BY lap) o FROM t) SELECT roi, CAST(block AS INT) block, bin, {st('avg(v)', 'value')} FROM o WHERE o <= 2 GROUP BY ALL")
def block_tuning(spark, sf_dir):
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 20).withColumn("block", F.floor(F.col("lap") / 4).cast("int"))
    return rounded(population.block_tuning(t, ROI, "block", 2), "value")


@query("template_correlation", with_views("sig_long") + f", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), w AS (SELECT *, CASE WHEN lap > (SELECT max(lap) FROM t) - 4 THEN 1 ELSE 0 END own FROM t), m AS (SELECT *, (coalesce(sum(CASE WHEN own = 1 THEN v END) OVER p, 0) - own * v) / nullif(CAST(count(CASE WHEN own = 1 THEN v END) OVER p - own AS DOUBLE), 0) m FROM w WINDOW p AS (PARTITION BY roi, bin)) SELECT lap, {st('corr(v, m)', 'r')} FROM m GROUP BY lap")
def template_correlation(spark, sf_dir):
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10)
    return rounded(spatial.template_correlation(t, "lap", ROI, 4), "r")


# ---------------------------------------------------------------- models

@query("transition_matrix", with_views("sig_short") + f", s AS (SELECT kind AS state, lead(kind) OVER (PARTITION BY roi ORDER BY frame) nxt FROM sig_short), c AS (SELECT state, nxt, count(*) n FROM s WHERE nxt IS NOT NULL GROUP BY ALL) SELECT state, nxt AS next, n, {st('n / sum(n) OVER (PARTITION BY state)', 'p')} FROM c")
def transition_matrix(spark, sf_dir):
    return rounded(models.transition_matrix(views.sig_short(spark, sf_dir), "kind", ROI), "p")


@query("hmm_states")
def hmm_states(spark, sf_dir):
    """Poisson model of counts per frame and its likeliest path; tests check likelihood and recovery."""
    rows = views.sig_short(spark, sf_dir).select("roi", "frame", F.floor("value").alias("count"))
    return models.decode(rows, models.hmm(rows, "count", ROI, 2, rounds=5), "count", ROI)


@query("nmf_weights")
def nmf_weights(spark, sf_dir):
    """Weights of each curve on three non-negative components; tests check the fit."""
    w, _ = models.factorise(views.curves(spark, sf_dir), "roi", "bin", "value", 3, rounds=8)
    return w.select("roi", F.posexplode("w").alias("component", "weight"))


@query("field_clusters")
def field_clusters(spark, sf_dir):
    """Clusters of fields by first-lap statistics."""
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 20)
    stats = population.first_lap_statistics(t, ROI, onset_part=0.97).na.drop(subset=["shift", "gain"])
    return models.kmeans(stats, ["shift", "gain"], 2).select("roi", "cluster")


@query("mask_overlap", "WITH p AS (SELECT DISTINCT l_linenumber f, l_linestatus s, l_suppkey roi, CAST(l_quantity AS INT) y, CAST(l_orderkey % 10 AS INT) x FROM lineitem), s AS (SELECT f, s, roi, count(*) n FROM p GROUP BY ALL), m AS (SELECT a.f, a.roi a, b.roi b, count(*) k FROM p a JOIN p b ON a.f = b.f AND a.y = b.y AND a.x = b.x AND a.s = 'O' AND b.s = 'F' GROUP BY ALL) SELECT m.f, m.a, m.b, round(1 - k / (x.n + y.n - k) + 1e-8::DOUBLE, 6) AS distance FROM m JOIN s x ON x.f = m.f AND x.roi = m.a AND x.s = 'O' JOIN s y ON y.f = m.f AND y.roi = m.b AND y.s = 'F'")
def mask_overlap(spark, sf_dir):
    """Masks of two sessions (by line status) of each field of view."""
    # distances are rounded before pairs are listed: a row stands for many
    return blocks.expanded(rounded(models.mask_overlap_groups(*_sessions_of_masks(spark, sf_dir), ["f"]), "distance"))


def _sessions_of_masks(spark, sf_dir):
    px = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_suppkey").alias("roi"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_orderkey") % 10).cast("int").alias("x"))
    return tuple(px.where(F.col("s") == s).drop("s") for s in ("O", "F"))


@query("registered_rois")
def registered_rois(spark, sf_dir):
    """One-to-one registration of the two sessions' masks by least total Jaccard distance; tests check it against all assignments."""
    return assignment.registered(*_sessions_of_masks(spark, sf_dir), ["f"], 0.95)


@query("simulated_spikes")
def simulated_spikes(spark, sf_dir):
    """Spike counts of cells centred where the curves' centres of mass are."""
    cells = spatial.centres(views.curves(spark, sf_dir), ROI, 64).select("roi", F.col("com").alias("centre"))
    return simulate.spike_counts(simulate.rates(cells, 64), 10, 0.1)
