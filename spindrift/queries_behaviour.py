"""Registered queries: responses to triggers, composed tuning, contexts, events of both polarities, behaviour logs, long windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views
from .functions.numeric import stable
from .operators import aggregates, catalog, intervals, signals, spatial
from .plans import responses, tuning
from .queries import _HYST, _MM, _PSTH, _XC, GAUSS
from .registered import ROI, query, rounded, st
from .sources import behaviour_log
from .views import with_views

# ---------------------------------------------------------------- responses

_BINS = _PSTH + ", f AS (SELECT *, min(rel) OVER (PARTITION BY roi, trigger) z FROM n), b AS (SELECT roi, trigger, z, CAST(floor((rel - z) / 7200.0::DOUBLE) AS INT) i, {} v FROM f GROUP BY ALL), e AS (SELECT roi, trigger, z, max(i) n FROM b GROUP BY ALL), u AS (SELECT e.roi, e.trigger, s.s i, b.v FROM e JOIN range(100) s(s) ON s.s <= e.n LEFT JOIN b ON b.roi = e.roi AND b.trigger = e.trigger AND b.i = s.s), gr AS (SELECT e.roi, e.trigger, CAST(s.s AS INT) step, -86400.0::DOUBLE + s.s * 7200.0::DOUBLE rel, greatest(0, least(CAST(floor((-86400.0::DOUBLE + s.s * 7200.0::DOUBLE - z) / 7200.0::DOUBLE + 0.5::DOUBLE) AS INT), n)) i FROM e, range(25) s(s))"
_SUMS = _BINS.format("sum(value)") + ", p AS (SELECT gr.roi, gr.trigger, gr.step, gr.rel, coalesce(u.v, 0) AS value FROM gr JOIN u USING (roi, trigger, i))"


def _responses(spark, sf_dir, how, limit=10):
    rows = views.sig_short(spark, sf_dir)
    return responses.psth(rows.select("roi", "t", "value"), rows.where("kind = 'purchase'").select("roi", F.col("t").alias("trigger")), 86400, 86400, 7200, ROI, how, limit)


@query("psth_sums", _SUMS + f" SELECT roi, trigger, step, rel, {st('value', 'value')} FROM p")
def psth_sums(spark, sf_dir):
    """Sums by two hours from each trigger, on a grid of a day before to a day after."""
    return rounded(_responses(spark, sf_dir, "sum"), "value")


@query(
    "psth_means",
    _BINS.format("avg(value)")
    + f", k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p pi, last_value(v IGNORE NULLS) OVER p pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER q ni, first_value(v IGNORE NULLS) OVER q nv FROM u WINDOW p AS (PARTITION BY roi, trigger ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY roi, trigger ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT gr.roi, gr.trigger, gr.step, gr.rel, {st('coalesce(k.v, CASE WHEN k.i - pi <= 3 THEN pv + (nv - pv) * (k.i - pi) / (ni - pi) END)', 'value')} FROM gr JOIN k USING (roi, trigger, i)",
)
def psth_means(spark, sf_dir):
    """Means by two hours from each trigger; gaps are interpolated over up to three bins."""
    return rounded(_responses(spark, sf_dir, "mean", 3), "value")


@query("responsiveness_binned", _SUMS + f", e2 AS (SELECT roi, trigger, avg(CASE WHEN rel <= 0 THEN value END) pre, avg(CASE WHEN rel >= 0 THEN value END) post FROM p GROUP BY ALL) SELECT roi, {st('avg(post - pre)', 'response')}, {st('avg(CASE WHEN pre + post <> 0 THEN (post - pre) / (pre + post) END)', 'contrast')} FROM e2 GROUP BY roi")
def responsiveness_binned(spark, sf_dir):
    return rounded(responses.responsiveness(_responses(spark, sf_dir, "sum"), ROI), "response", "contrast")


# ---------------------------------------------------------------- tuning

_T20 = ", t AS (SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), r AS (SELECT k.roi, CAST(b.bin AS INT) bin, coalesce(t.v, 0) v FROM (SELECT DISTINCT roi FROM sig_long) k CROSS JOIN range(20) b(bin) LEFT JOIN t ON t.roi = k.roi AND t.bin = b.bin)"


@query("tuning_smoothed", with_views("sig_long") + _T20 + f", o AS (SELECT unnest(range(-12, 13)) o), k AS (SELECT o, exp(-0.5 * power(o / 3.0, 2)) / sum(exp(-0.5 * power(o / 3.0, 2))) OVER () w FROM o), s AS (SELECT a.roi, a.bin, sum(b.v * w) s FROM r a CROSS JOIN k JOIN r b ON b.roi = a.roi AND b.bin = (a.bin + k.o + 40) % 20 GROUP BY a.roi, a.bin) SELECT roi, bin, {st('s / max(s) OVER (PARTITION BY roi)', 'value')} FROM s")
def tuning_smoothed(spark, sf_dir):
    """Curves smoothed round the track with sigma 3 and divided by their peak."""
    return rounded(tuning.spatial_tuning(views.sig_long(spark, sf_dir), ROI, 20, 3.0, True), "value").select("roi", "bin", "value")


@query("tuning_circular", with_views("sig_long") + _T20 + f", k AS (SELECT unnest(range(16)) i, unnest({spatial.gaussian_kernel(16, 2.0)}::DOUBLE[]) w) SELECT a.roi, a.bin, {st('sum(b.v * k.w)', 'value')} FROM r a CROSS JOIN k JOIN r b ON b.roi = a.roi AND b.bin = (a.bin + 7 - k.i + 20) % 20 GROUP BY a.roi, a.bin")
def tuning_circular(spark, sf_dir):
    """Pooled curves, missing bins interpolated, smoothed with a kernel of 8 sigma points that goes on round the track."""
    return rounded(tuning.simple_tuning(views.sig_long(spark, sf_dir), ROI, 20, 2.0, circular=True), "value").select("roi", "bin", "value")


@query("event_tuning", with_views("sig_long") + ", p AS (SELECT roi, frame, discount, lag(position) OVER (PARTITION BY roi ORDER BY frame) pos FROM sig_long), c AS (SELECT roi, CAST(floor(pos * 10.0::DOUBLE) AS INT) bin, count(*) n FROM p WHERE discount > 0.09 AND pos IS NOT NULL GROUP BY ALL) SELECT k.roi, CAST(b.bin AS INT) bin, coalesce(c.n, 0) n FROM (SELECT DISTINCT roi FROM sig_long) k CROSS JOIN range(10) b(bin) LEFT JOIN c ON c.roi = k.roi AND c.bin = b.bin")
def event_tuning(spark, sf_dir):
    """Events by bin of the position right before them."""
    rows = views.sig_long(spark, sf_dir).withColumn("t", F.col("frame").cast("double"))
    return tuning.event_tuning(rows.where("discount > 0.09"), rows, rows.select("roi").distinct(), 10, ROI)


@query("velocity_map", with_views("sig_long") + f", d AS (SELECT *, position - lag(position) OVER (PARTITION BY roi ORDER BY frame) d FROM sig_long), v AS (SELECT *, coalesce(last_value(CASE WHEN abs(d) <= 0.2::DOUBLE THEN d END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) velocity FROM d), g AS (SELECT * FROM v WHERE NOT discount > 0.08 AND velocity > 0.02::DOUBLE), t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(velocity) v FROM g GROUP BY ALL) SELECT k.roi, k.lap, CAST(b.bin AS INT) bin, {st('t.v', 'value')} FROM (SELECT DISTINCT roi, lap FROM g) k CROSS JOIN range(10) b(bin) LEFT JOIN t ON t.roi = k.roi AND t.lap = k.lap AND t.bin = b.bin")
def velocity_map(spark, sf_dir):
    """Velocity by lap and bin over the valid samples: outside pauses and fast enough."""
    moving = signals.velocity(views.sig_long(spark, sf_dir), ROI).withColumn("iti", F.col("discount") > 0.08)
    valid = catalog.valid_samples(0.02).keep(moving).select("roi", "lap", "position", "velocity")
    return rounded(tuning.velocity_map(valid, ROI, "lap", 10), "value")


@query("drift_scores", _XC + f", p AS (SELECT a, b, max(r) best, sum(lag * r) / sum(r) moved FROM x GROUP BY a, b), o AS (SELECT a, b, best, moved FROM p UNION ALL SELECT b, a, best, moved FROM p), s AS (SELECT a, (count(CASE WHEN best > 0.02::DOUBLE THEN 1 END) + 1) / (count(*) + 1) > 0.33::DOUBLE valid FROM o GROUP BY a), k AS (SELECT o.a, moved FROM o JOIN s x ON x.a = o.a AND x.valid JOIN s y ON y.a = o.b AND y.valid UNION ALL SELECT a, 0.0 FROM s WHERE valid), d AS (SELECT a, quantile_cont(moved, 0.5) drift FROM k GROUP BY a) SELECT s.a AS lap, s.valid, {st('d.drift', 'drift')} FROM s LEFT JOIN d USING (a)")
def drift_scores(spark, sf_dir):
    """Median displacement of each lap against all others; laps without enough likeness are left out."""
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 20)
    return rounded(tuning.drift_scores(spatial.cross_correlation(t, "lap", ROI, 20, -9, 10), 0.02, 0.33), "drift")


@query("cell_correlations", with_views("curves") + f" SELECT a.roi AS a, b.roi AS b, {st('corr(a.value, b.value)', 'r')}, count(*) n FROM curves a JOIN curves b ON a.bin = b.bin AND a.roi <> b.roi AND a.roi % 100 = 0 GROUP BY ALL")
def cell_correlations(spark, sf_dir):
    """Correlations of a stated set of cells (every hundredth) with all cells."""
    c = views.curves(spark, sf_dir)
    return rounded(spatial.correlations_with(c, c.where("roi % 100 = 0"), "roi", "bin", []), "r")


_STUDENT = "CASE WHEN df % 2 = 0 THEN s * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * power(1 - s * s, k)) FROM range(df // 2) g(k)) ELSE 2 / pi() * (asin(s) + s * sqrt(1 - s * s) * (SELECT sum(exp(lgamma(k + 1) - lgamma(k + 1.5) + lgamma(1.5)) * power(1 - s * s, k)) FROM range((df - 1) // 2) g(k))) END"


@query("trend_p", with_views("sig_long") + f", q AS (SELECT roi, abs(corr(value, position)) s, count(*) - 2 df FROM sig_long GROUP BY roi) SELECT roi, {st(f'greatest(1 - ({_STUDENT}), 0)', 'p')} FROM q")
def trend_p(spark, sf_dir):
    """Probability of each region's trend of value with position by chance."""
    r = views.sig_long(spark, sf_dir).groupBy("roi").agg(F.corr("value", "position").alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("roi", stable(spatial.correlation_p(F.col("r"), F.col("n"))).alias("p"))


@query("kuiper_p", with_views("sig_long") + f", c AS (SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, count(*) b, sum(CASE WHEN discount > 0.07 THEN 1 ELSE 0 END) a FROM sig_long GROUP BY ALL), d AS (SELECT roi, sum(a) OVER v na, sum(b) OVER v nb, sum(a) OVER w / sum(a) OVER v - sum(b) OVER w / sum(b) OVER v d FROM c WINDOW w AS (PARTITION BY roi ORDER BY bin), v AS (PARTITION BY roi)), k AS (SELECT roi, na * nb / (na + nb) n, greatest(max(d), 0) - least(min(d), 0) d FROM d GROUP BY roi, na, nb), l AS (SELECT roi, (sqrt(n) + 0.155::DOUBLE + 0.24::DOUBLE / sqrt(n)) * d l FROM k) SELECT roi, {st('CASE WHEN l < 0.4::DOUBLE THEN 1.0 ELSE least(greatest(2 * (SELECT sum((4 * j * j * l * l - 1) * exp(-2 * j * j * l * l)) FROM range(1, 61) g(j)), 0), 1) END', 'p')} FROM l")
def kuiper_p(spark, sf_dir):
    """Probability of each region's Kuiper statistic by chance."""
    rows = views.sig_long(spark, sf_dir).withColumn("bin", spatial.bin_floor(F.col("position"), 20))
    count = lambda df: df.groupBy("roi", "bin").agg(F.count(F.lit(1)).alias("n"))
    found = spatial.kuiper(count(rows.where("discount > 0.07")), count(rows), ROI)
    sizes = rows.groupBy("roi").agg(F.count(F.lit(1)).alias("nb"), F.count(F.when(F.col("discount") > 0.07, 1)).alias("na"))
    return found.join(sizes, "roi").select("roi", stable(spatial.kuiper_p(F.col("kuiper"), F.col("na"), F.col("nb"))).alias("p"))


@query("information_terms", with_views("sig_long") + f", t AS (SELECT roi, CAST(floor(position * 20.0::DOUBLE) AS INT) bin, avg(value) v, count(*) c FROM sig_long GROUP BY ALL), q AS (SELECT *, c / sum(c) OVER w p FROM t WINDOW w AS (PARTITION BY roi)), r AS (SELECT *, sum(p * v) OVER (PARTITION BY roi) rate FROM q) SELECT roi, bin, {st('p * (v / rate) * log2(v / rate)', 'term')} FROM r")
def information_terms(spark, sf_dir):
    """Skaggs information bin by bin."""
    rows = views.sig_long(spark, sf_dir)
    t = spatial.tuning(rows, ROI, 20).join(spatial.occupancy(rows, ROI, 20), ["roi", "bin"])
    return spatial.information_terms(t, ROI, "share").select("roi", "bin", stable("term").alias("term"))


@query("central_moments", with_views("sig_long") + f", c AS (SELECT roi, value - avg(value) OVER (PARTITION BY roi) x FROM sig_long) SELECT roi, {st('avg(x * x * x) / 1e9', 'moment')} FROM c GROUP BY roi")
def central_moments(spark, sf_dir):
    """Third central moment, in billions."""
    return aggregates.central_moment(views.sig_long(spark, sf_dir), "value", 3, ROI).select("roi", stable(F.col("moment") / F.lit(1e9)).alias("moment"))


@query("block_fields")
def block_fields(spark, sf_dir):
    """Place fields of each block of four laps, all in one plan; tests hold the parts against brute force."""
    rows = views.sig_long(spark, sf_dir).withColumn("block", F.floor(F.col("lap") / 4).cast("int"))
    return tuning.place_fields(rows, ["roi", "block"], "lap", 20, 100, 0.05, sigma=1.0, min_active=0.5)


# ---------------------------------------------------------------- events and contexts

@query("real_time_frames", with_views("sig_short") + ", e AS (SELECT row_number() OVER () e, roi, t - 3600 a, t + value * 60 + 7200 b FROM sig_short WHERE kind = 'purchase'), m AS (SELECT e.e, s.roi, s.frame, s.t, max(s.t) OVER (PARTITION BY e.e) z FROM e JOIN sig_short s ON s.roi = e.roi AND s.t >= a AND s.t <= b) SELECT DISTINCT roi, frame, t FROM m WHERE t < z")
def real_time_frames(spark, sf_dir):
    """Frames from an hour before events up to, but without, the last within two hours after."""
    rows = views.sig_short(spark, sf_dir)
    events = rows.where("kind = 'purchase'").select("roi", F.col("t").alias("onset"), (F.col("t") + F.col("value") * 60).alias("offset"))
    return intervals.real_time_frames(rows.select("roi", "frame", "t"), events, 3600, 7200, ROI)


@query("masked_by_events", with_views("sig_long") + " SELECT roi, lap, frame, CASE WHEN discount > 0.05 THEN value END AS value FROM sig_long")
def masked_by_events(spark, sf_dir):
    """Values outside each region's and lap's own events are missing."""
    rows = views.sig_long(spark, sf_dir).select("roi", "lap", "frame", "value", "discount")
    found = intervals.runs(rows, F.col("discount") > 0.05, ["roi", "lap"])
    return intervals.masked_by_events(rows.drop("discount"), found, ["roi", "lap"])


@query("impulses_at_times", with_views("sig_short") + ", f AS (SELECT DISTINCT g.roi, (SELECT count(*) FROM sig_short s WHERE s.roi = g.roi AND s.t < g.t - 1800) + 1 frame FROM sig_short g WHERE g.kind = 'purchase') SELECT s.roi, s.frame, CASE WHEN f.frame IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM sig_short s LEFT JOIN f ON f.roi = s.roi AND f.frame = s.frame")
def impulses_at_times(spark, sf_dir):
    """1 at the frame after each onset, found among the frames' times."""
    rows = views.sig_short(spark, sf_dir)
    return intervals.impulses_at_times(rows.where("kind = 'purchase'").select("roi", (F.col("t") - 1800).alias("onset")), rows.select("roi", "frame", "t"), ROI)


@query("block_ranges", with_views("sig_short") + ", k AS (SELECT roi, frame, kind, lag(kind) OVER (PARTITION BY roi ORDER BY frame) p FROM sig_short WHERE kind <> 'error'), e AS (SELECT roi, max(frame) + 1 z FROM sig_short GROUP BY roi), o AS (SELECT * FROM k WHERE p IS NULL OR p <> kind) SELECT o.roi, CAST(row_number() OVER w - 1 AS INT) block, kind AS context, frame AS start, coalesce(lead(frame) OVER w, z) AS stop FROM o JOIN e USING (roi) WINDOW w AS (PARTITION BY o.roi ORDER BY frame)")
def block_ranges(spark, sf_dir):
    """Half-open ranges of frames of equal context; frames without one belong to the block before."""
    rows = views.sig_short(spark, sf_dir).select("roi", "frame", F.when(F.col("kind") != "error", F.col("kind")).alias("context"))
    return intervals.block_ranges(rows, "context", ROI)


@query("lap_contexts", with_views("sig_long") + ", c AS (SELECT roi, lap, frame, CASE WHEN discount > 0.02 AND discount <= 0.06 THEN 'low' WHEN discount > 0.06 THEN 'high' END context FROM sig_long) SELECT roi, lap, arg_min(context, frame) AS context FROM c WHERE context IS NOT NULL GROUP BY roi, lap")
def lap_contexts(spark, sf_dir):
    """The context of each lap, from intervals of contexts by frame."""
    rows = views.sig_long(spark, sf_dir).select("roi", "lap", "frame", "discount")
    low = intervals.runs(rows, (F.col("discount") > 0.02) & (F.col("discount") <= 0.06), ROI).withColumn("name", F.lit("low"))
    high = intervals.runs(rows, F.col("discount") > 0.06, ROI).withColumn("name", F.lit("high"))
    return intervals.context_of_laps(intervals.context_of_samples(rows, low.unionByName(high), ROI), ROI)


_RUNS = "r AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY frame) - 1 AS run FROM (SELECT roi, frame, f, lag(f) OVER (PARTITION BY roi ORDER BY frame) p FROM m))"


@query("spatial_events", with_views("sig_long") + f", m AS (SELECT roi, frame, (position > 0.1::DOUBLE AND position < 0.4::DOUBLE) OR (position > 0.6::DOUBLE AND position < 0.7::DOUBLE) f FROM sig_long), {_RUNS} SELECT roi, CAST(run AS INT) run, min(frame) onset, max(frame) + 1 AS \"offset\" FROM r WHERE f GROUP BY roi, run")
def spatial_events(spark, sf_dir):
    """Runs of frames inside either of two stretches of the track."""
    rows = views.sig_long(spark, sf_dir).select("roi", "frame", "position")
    stretches = rows.select("roi").distinct().withColumn("x", F.explode(F.array(F.struct(F.lit(0.1).alias("onset"), F.lit(0.4).alias("offset")), F.struct(F.lit(0.6).alias("onset"), F.lit(0.7).alias("offset"))))).select("roi", "x.onset", "x.offset")
    return intervals.spatial_to_time(stretches, rows, ROI)


_BOTH = _HYST.replace("z AS (SELECT roi, frame, value / stddev_pop(value) OVER (PARTITION BY roi) x FROM sig_short)", "c AS (SELECT roi, frame, value - avg(value) OVER (PARTITION BY roi) c FROM sig_short), y AS (SELECT roi, frame, c / stddev_pop(c) OVER (PARTITION BY roi) x FROM c), z AS (SELECT roi || ':positive' roi, frame, x FROM y UNION ALL SELECT roi || ':negative', frame, -x FROM y)")


@query("event_histograms", _BOTH + ", t AS (SELECT split_part(roi, ':', 2) polarity, least(floor(2 * amplitude) - 4, 6) a, least(floor(4 * (\"offset\" - onset)), 19) d FROM ev) SELECT p.p AS polarity, CAST(g.a AS INT) a, CAST(h.d AS INT) d, (SELECT count(*) FROM t WHERE t.polarity = p.p AND t.a >= g.a AND t.d >= h.d) n FROM (VALUES ('positive'), ('negative')) p(p), range(7) g(a), range(20) h(d)")
def event_histograms(spark, sf_dir):
    """Events of all regions pooled, upwards and downwards, by amplitude and duration."""
    rows = views.sig_short(spark, sf_dir)
    mean = rows.groupBy("roi").agg(F.avg("value").alias("m"))
    found = signals.both_polarities(rows.join(mean, "roi").withColumn("c", F.col("value") - F.col("m")), "c", ROI, 1.0)
    up, down = signals.pooled_histograms(found)
    return up.withColumn("polarity", F.lit("positive")).unionByName(down.withColumn("polarity", F.lit("negative")))


@query("transients_identified", _BOTH + f', t AS (SELECT split_part(roi, \':\', 1)::BIGINT roi, split_part(roi, \':\', 2) polarity, onset, "offset", amplitude, peak, CAST("offset" - onset AS DOUBLE) duration FROM ev), u AS (SELECT *, least(floor(2 * amplitude) - 4, 6) a, least(floor(4 * duration), 19) d FROM t), g AS (SELECT g.a, h.d, (SELECT count(*) FROM u WHERE polarity = \'positive\' AND u.a >= g.a AND u.d >= h.d) up, (SELECT count(*) FROM u WHERE polarity = \'negative\' AND u.a >= g.a AND u.d >= h.d) down FROM range(7) g(a), range(20) h(d)), r AS (SELECT a, d, min(least(coalesce(down / nullif(up, 0), 1.0), 1.0)) OVER (PARTITION BY a ORDER BY d) r FROM g), q AS (SELECT *, lag(r) OVER (PARTITION BY a ORDER BY d) b FROM r), h AS (SELECT a, min(CASE WHEN r < 0.2::DOUBLE AND b IS NULL THEN d WHEN r < 0.2::DOUBLE THEN d - 1 + (b - 0.2::DOUBLE) / nullif(b - r, 0) END) / 4.0::DOUBLE least FROM q GROUP BY a) SELECT roi, onset, "offset", {st("amplitude", "amplitude")}, peak, duration FROM u JOIN h USING (a) WHERE polarity = \'positive\' AND duration > h.least AND duration > 0.1::DOUBLE')
def transients_identified(spark, sf_dir):
    """Upward events longer than the duration at which downward ones of their amplitude are rare."""
    rows = views.sig_short(spark, sf_dir)
    mean = rows.groupBy("roi").agg(F.avg("value").alias("m"))
    found = signals.both_polarities(rows.join(mean, "roi").withColumn("c", F.col("value") - F.col("m")), "c", ROI, 1.0)
    least = signals.duration_thresholds(*signals.pooled_histograms(found), 0.2)
    return rounded(signals.identified(found.where("polarity = 'positive'"), least).drop("polarity"), "amplitude")


@query("spikes_binary")
def spikes_binary(spark, sf_dir):
    """Deconvolved spikes without those under three median deviations, as 0 and 1; tests hold the parts."""
    return signals.spikes_ar1(views.sig_short(spark, sf_dir).select("roi", "frame", "value"), ROI, 0.7, 10.0, 3.0, binary=True)


#: What a spike leaves k frames later, for time constants of 0.4 and 0.06 s at 10 frames a second; the first frame's reaches on from the third.
_LEFT = "(exp(-0.25::DOUBLE * ({0} + 1)) - exp(-({0} + 1) / 0.6::DOUBLE)) / (exp(-0.25::DOUBLE) - exp(-1 / 0.6::DOUBLE))"


@query(
    "reconvolved",
    with_views("sig_short")
    + ", s AS (SELECT roi, frame, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END v FROM sig_short), c AS (SELECT t.roi, t.frame, t.v spikes, sum(j.v * CASE WHEN j.frame = t.frame THEN 1.0 WHEN j.frame > 0 THEN "
    + _LEFT.format("(t.frame - j.frame)")
    + " WHEN t.frame < 2 THEN 0.0 ELSE -exp(-0.25::DOUBLE - 1 / 0.6::DOUBLE) * "
    + _LEFT.format("(t.frame - 2)")
    + f" END) c FROM s t JOIN s j ON j.roi = t.roi AND j.frame <= t.frame GROUP BY ALL) SELECT roi, frame, {st('(c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0)', 'calcium')} FROM c WINDOW w AS (PARTITION BY roi)",
)
def reconvolved(spark, sf_dir):
    """Calcium of spikes by a second-order recursion, standardised; in SQL as the sum of what each spike leaves."""
    rows = views.sig_short(spark, sf_dir).select("roi", "frame", F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("spikes"))
    return rounded(signals.reconvolved(rows, ROI, 0.4, 0.06, 0.1), "calcium")


# ---------------------------------------------------------------- behaviour logs

#: Log messages of each event, the name of an action and its other name. The view's user is the log.
_LOG = {"view": ("context", "start"), "purchase": ("context", "stop"), "click": ("valve", "open"), "error": ("valve", "close"), "signup": ("lick", "start")}


def _log_lines(spark, sf_dir):
    """The events table as lines of behaviour logs, one log to a user, each with a line about itself."""
    rows = views.sig_short(spark, sf_dir)
    message = None
    for kind, (what, action) in _LOG.items():
        body = F.struct(F.struct(F.lit("ctx").alias("id"), F.lit(5).alias("pin"), F.lit(action).alias("action")).alias(what))
        line = F.to_json(F.struct(F.col("frame").cast("double").alias("time"), body.alias("behavior_controller")))
        message = F.when(F.col("kind") == kind, line) if message is None else message.when(F.col("kind") == kind, line)
    about = '{"settings": {"sync_pin": 1, "track_length": 2.0, "contexts": [{"id": "led", "valves": [5]}], "reward": {"id": "ctx", "pin": 5}}}'
    return rows.select(F.col("roi").alias("file"), message.alias("value")).unionByName(rows.select(F.col("roi").alias("file")).distinct().withColumn("value", F.lit(about)))


@query("log_intervals", with_views("sig_short") + ", m AS (SELECT roi, frame t, CASE WHEN kind IN ('view', 'purchase') THEN 'ctx' WHEN kind IN ('click', 'error') THEN 'led' ELSE 'licking' END AS name, kind IN ('view', 'click', 'signup') s FROM sig_short), a AS (SELECT * FROM m UNION ALL SELECT roi, t, CASE WHEN name = 'ctx' THEN 'reward' ELSE 'water' END, s FROM m WHERE name IN ('ctx', 'led')), n AS (SELECT *, lead(s) OVER w ns, lead(t) OVER w nt, lag(s) OVER w ps FROM a WINDOW w AS (PARTITION BY roi, name ORDER BY t)) SELECT roi, name, CAST(t AS DOUBLE) onset, CAST(CASE WHEN NOT ns THEN nt END AS DOUBLE) AS \"offset\" FROM n WHERE s UNION ALL SELECT roi, name, NULL, CAST(t AS DOUBLE) FROM n WHERE NOT s AND (ps IS NULL OR NOT ps)")
def log_intervals(spark, sf_dir):
    """Behaviour logs parsed into named intervals: contexts, valves by their context, licks, and the reward's other names."""
    lines = _log_lines(spark, sf_dir)
    found = behaviour_log.named_actions(behaviour_log.every_action(behaviour_log.parsed(lines)), behaviour_log.settings(lines))
    return intervals.paired(found, "action", "start", "stop", ["file", "name"]).withColumnRenamed("file", "roi")


@query("repaired_intervals", with_views("sig_short") + f", i AS (SELECT roi, CAST(frame AS DOUBLE) onset, CASE WHEN kind <> 'error' THEN frame + value / 10 END AS \"offset\" FROM sig_short), m AS (SELECT *, avg(\"offset\" - onset) OVER (PARTITION BY roi) m FROM i) SELECT roi, onset, {st('coalesce(\"offset\", CASE WHEN onset + m < 60 THEN onset + m END)', '\"offset\"')} FROM m")
def repaired_intervals(spark, sf_dir):
    """Intervals whose missing end is set by the mean length of their log's others."""
    rows = views.sig_short(spark, sf_dir).select("roi", F.col("frame").cast("double").alias("onset"), F.when(F.col("kind") != "error", F.col("frame") + F.col("value") / 10).alias("offset"))
    return rounded(behaviour_log.repaired_by_length(rows, ROI, 60.0), "offset")


# ---------------------------------------------------------------- dF/F at its real windows

@query("dfof_quantile_300", with_views("sig_long") + f", s AS {GAUSS('sig_long', w=300, sigma=5)}, b AS (SELECT roi, frame, CASE WHEN count(s) OVER w >= 60 THEN quantile_cont(s, 0.08) OVER w END b FROM s WINDOW w AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING)) SELECT roi, frame, {st('CASE WHEN b <> 0 THEN (value - b) / b END', 'dfof')} FROM sig_long JOIN b USING (roi, frame)")
def dfof_quantile_300(spark, sf_dir):
    out = signals.quantile_dfof(views.sig_long(spark, sf_dir).select("roi", "frame", "value"), ROI)
    return out.select("roi", "frame", stable("dfof").alias("dfof"))


@query("dfof_jia_1800", with_views("sig_long") + f", m AS (SELECT roi, frame, value, CASE WHEN count(value) OVER w >= 18 THEN avg(value) OVER w END m FROM sig_long WINDOW w AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING)), b AS (SELECT *, CASE WHEN count(m) OVER w >= 360 THEN min(m) OVER w END b FROM m WINDOW w AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN 900 PRECEDING AND 899 FOLLOWING)) SELECT roi, frame, {st('CASE WHEN b <> 0 THEN (value - b) / b END', 'dfof')} FROM b")
def dfof_jia_1800(spark, sf_dir):
    out = signals.jia_dfof(views.sig_long(spark, sf_dir).select("roi", "frame", "value"), ROI)
    return out.select("roi", "frame", stable("dfof").alias("dfof"))


def _wide(w: int) -> str:
    return _MM("{}", "{}").replace("4 PRECEDING", f"{w // 2} PRECEDING").replace("4 FOLLOWING", f"{(w - 1) // 2} FOLLOWING")


@query("dfof_neuropil_600", with_views("sig_long") + f", d AS (SELECT roi, frame, raw - npil AS value, npil FROM sig_long), s1 AS {GAUSS('d', w=600, sigma=10)}, b1 AS {_wide(600).format('s1')}, s2 AS {GAUSS('d', value='npil', w=600, sigma=10)}, b2 AS {_wide(600).format('s2')} SELECT d.roi, d.frame, {st('CASE WHEN b1.b + b2.b <> 0 THEN (value - b1.b) / (b1.b + b2.b) END', 'dfof')} FROM d JOIN b1 USING (roi, frame) JOIN b2 USING (roi, frame)")
def dfof_neuropil_600(spark, sf_dir):
    return signals.neuropil_dfof(views.sig_long(spark, sf_dir).select("roi", "frame", "raw", "npil"), ROI).select("roi", "frame", stable("dfof").alias("dfof"))


@query("dfof_maxmin_1800", with_views("sig_long") + f", s AS {GAUSS('sig_long', w=1800, sigma=90)}, b AS {_wide(1800).format('s')} SELECT roi, frame, {st('CASE WHEN b <> 0 THEN (value - b) / b END', 'dfof')} FROM sig_long JOIN b USING (roi, frame)")
def dfof_maxmin_1800(spark, sf_dir):
    return signals.maxmin_dfof(views.sig_long(spark, sf_dir).select("roi", "frame", "value"), ROI).select("roi", "frame", stable("dfof").alias("dfof"))
