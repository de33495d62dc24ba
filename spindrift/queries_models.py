"""Registered queries over models, registration, movies and messages, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views
from .functions.numeric import stable
from .operators import aggregates, autoregression, dynamics, hidden_states, movies, records, registration, rolling, selection, signals, spatial, thresholds
from .operators.sequences import sequences
from .plans import population, tuning
from .queries import _REFLECTED
from .queries_behaviour import _STUDENT
from .registered import ROI, query, rounded, st
from .sources import messages as routed_messages
from .views import read, with_views

# ---------------------------------------------------------------- autoregression


@query(
    "yule_walker",
    with_views("sig_short")
    + ", x AS (SELECT roi, frame, value - avg(value) OVER (PARTITION BY roi) x FROM sig_short), l AS (SELECT roi, x, lag(x, 1) OVER w l1, lag(x, 2) OVER w l2, lag(x, 3) OVER w l3 FROM x WINDOW w AS (PARTITION BY roi ORDER BY frame)),"
    + " c AS (SELECT roi, sum(x * x) / count(x) c0, sum(x * l1) / nullif(greatest(count(x) - 1, 0), 0) c1, sum(x * l2) / nullif(greatest(count(x) - 2, 0), 0) c2, sum(x * l3) / nullif(greatest(count(x) - 3, 0), 0) c3 FROM l GROUP BY roi),"
    + " p AS (SELECT *, c1 / nullif(c0, 0) k1 FROM c), q AS (SELECT *, c0 * (1 - k1 * k1) e1, (c2 - k1 * c1) / nullif(c0 * (1 - k1 * k1), 0) k2 FROM p), r AS (SELECT *, k1 - k2 * k1 a, e1 * (1 - k2 * k2) e2 FROM q), s AS (SELECT *, (c3 - a * c2 - k2 * c1) / nullif(e2, 0) k3 FROM r)"
    + f" SELECT roi, {st('a - k3 * k2', 'ar1')}, {st('k2 - k3 * a', 'ar2')}, {st('k3', 'ar3')}, {st('CASE WHEN e2 * (1 - k3 * k3) >= 0 THEN sqrt(e2 * (1 - k3 * k3)) END', 'sigma')} FROM s",
)
def yule_walker(spark, sf_dir):
    """Autoregression of order 3, by the recursion that serves any order."""
    return rounded(autoregression.ar(views.sig_short(spark, sf_dir), ROI, 3), "ar1", "ar2", "ar3", "sigma")


@query("arma_coefficients")
def arma_coefficients(spark, sf_dir):
    """ARMA(1, 1) of each centred trace by exact maximum likelihood; tests hold it against the dense likelihood."""
    rows = views.sig_short(spark, sf_dir)
    mean = rows.groupBy("roi").agg(F.avg("value").alias("m"))
    return autoregression.arma(rows.join(mean, "roi").select("roi", "frame", (F.col("value") - F.col("m")).alias("value")), ROI, 1, 1)


# ---------------------------------------------------------------- hidden states and dynamics


def _sessions(spark, sf_dir, counts=False):
    """Sessions of 100 frames of 64 regions: a frame for each embedding."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 1000).cast("int").alias("mouse"), F.floor(F.col("vec_id") / 100).cast("int").alias("trial"), (F.col("vec_id") % 100).cast("int").alias("frame"), F.posexplode("embedding").alias("roi", "value"))
    return rows.withColumn("value", F.floor(F.abs("value") * 20)) if counts else rows


def _hidden(spark, sf_dir):
    seqs, names = sequences(_sessions(spark, sf_dir, counts=True), ["mouse", "trial"])
    return seqs, names, hidden_states.fit(seqs, len(names), 3, rounds=6)


@query("region_states")
def region_states(spark, sf_dir):
    """The likeliest path of three states behind the counts of all regions; tests hold the parts against all paths."""
    seqs, _, model = _hidden(spark, sf_dir)
    return hidden_states.paths(seqs, ["mouse", "trial"], model)


@query("state_emissions")
def state_emissions(spark, sf_dir):
    """Events per second of each region in each state, by session; tests hold it against NumPy."""
    seqs, names, model = _hidden(spark, sf_dir)
    return hidden_states.emissions(seqs, ["mouse", "trial"], names, model, 0.125, "analytical")


@query("hmm_intervals")
def hmm_intervals(spark, sf_dir):
    """95th percentiles of posteriors when regions' trials are dealt apart; tests hold it against NumPy."""
    seqs, _, model = _hidden(spark, sf_dir)
    return hidden_states.posterior_limits(seqs, ["mouse"], "trial", model, 95, shuffles=5)


@query("latent_courses")
def latent_courses(spark, sf_dir):
    """Two latent courses behind all regions; tests hold filter and smoother against the dense Gaussian."""
    seqs, names = sequences(_sessions(spark, sf_dir), ["mouse", "trial"])
    return dynamics.latents(seqs, ["mouse", "trial"], dynamics.fit(seqs, len(names), 2, rounds=5))


# ---------------------------------------------------------------- registration


@query("registered_sessions")
def registered_sessions(spark, sf_dir):
    """Masks of ten sessions (by label) of each field registered to one growing reference; tests hold it against a fold over all assignments."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("int").alias("field"), F.col("label").alias("session"), F.col("vec_id").alias("roi"), F.posexplode("embedding").alias("bin", "v"))
    px = e.where("v > 0.08").select("field", "session", "roi", F.floor(F.col("bin") / 8).cast("int").alias("y"), (F.col("bin") % 8).cast("int").alias("x"))
    return registration.registered_sessions(px, ["field"], "session", limit=0.7)


@query(
    "masks_within",
    "WITH p AS (SELECT DISTINCT l_linenumber f, l_linestatus s, l_suppkey roi, CAST(l_quantity AS INT) y, CAST(l_orderkey % 10 AS INT) x FROM lineitem), s AS (SELECT f, s, roi, count(*) n FROM p GROUP BY ALL), m AS (SELECT a.f, a.roi a, b.roi b, count(*) k FROM p a JOIN p b ON a.f = b.f AND a.y = b.y AND a.x = b.x AND a.s = 'O' AND b.s = 'F' GROUP BY ALL) SELECT m.f, m.a, m.b, round(1 - k / (x.n + y.n - k) + 1e-8::DOUBLE, 6) AS distance FROM m JOIN s x ON x.f = m.f AND x.roi = m.a AND x.s = 'O' JOIN s y ON y.f = m.f AND y.roi = m.b AND y.s = 'F' WHERE 1 - k / (x.n + y.n - k) <= 0.9::DOUBLE + 1e-9::DOUBLE",
)
def masks_within(spark, sf_dir):
    """Pairs of masks of two sessions with a Jaccard distance up to 0.9."""
    px = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_suppkey").alias("roi"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_orderkey") % 10).cast("int").alias("x"))
    masks = registration.with_pixels(px.where("s IN ('O', 'F')"), ["f"], ["s", "roi"])
    sides = (masks.where(F.col("s") == s).drop("s").withColumnRenamed("roi", c) for s, c in (("O", "a"), ("F", "b")))
    return rounded(registration.overlapping(*sides, ["f"], 0.9), "distance")


# ---------------------------------------------------------------- movies


def _movie(spark, sf_dir):
    """Movies of 100 frames of 8 x 8 pixels: a frame for each embedding; small values are missing."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("int").alias("movie"), (F.col("vec_id") % 100).cast("int").alias("frame"), F.posexplode("embedding").alias("bin", "v"))
    v = F.col("v").cast("double")
    return e.select("movie", "frame", F.floor(F.col("bin") / 8).cast("int").alias("y"), (F.col("bin") % 8).cast("int").alias("x"), F.when(F.abs(v) >= 0.03, v).alias("value"))


@query(
    "filled_pixels",
    "WITH e AS (SELECT CAST(vec_id // 100 AS INT) movie, CAST(vec_id % 100 AS INT) frame, unnest(range(len(embedding))) bin, unnest(embedding) v FROM embeddings), m AS (SELECT movie, frame, CAST(bin // 8 AS INT) y, CAST(bin % 8 AS INT) x, CASE WHEN abs(CAST(v AS DOUBLE)) >= 0.03::DOUBLE THEN CAST(v AS DOUBLE) END AS value FROM e), g AS (SELECT *, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY movie, frame) <= 1 / 3::DOUBLE few FROM m),"
    + " f AS (SELECT a.movie, a.frame, a.y, a.x, sum(exp(-((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) / (2 * 0.64::DOUBLE)) * b.value) / sum(exp(-((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) / (2 * 0.64::DOUBLE))) v FROM g a JOIN g b ON a.movie = b.movie AND a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND b.value IS NOT NULL WHERE a.value IS NULL AND a.few GROUP BY ALL)"
    + f" SELECT g.movie, g.frame, g.y, g.x, {st('coalesce(g.value, f.v)', 'value')} FROM g LEFT JOIN f USING (movie, frame, y, x)",
)
def filled_pixels(spark, sf_dir):
    """Missing pixels as the Gaussian mean of known ones within two pixels, in frames that miss a third at most."""
    return rounded(movies.filled_in_space(_movie(spark, sf_dir), ["movie"], 0.8, radius=2), "value")


@query("denoised_movie")
def denoised_movie(spark, sf_dir):
    """The movies put together again from blocks of few components; tests hold error and rank against the singular values."""
    u, v, _ = movies.low_rank(_movie(spark, sf_dir), ["movie"], 8, 8, block=4, overlap=1, part=0.8)
    return rounded(movies.recomposed(u, v, ["movie"]), "value")


# ---------------------------------------------------------------- messages


@query("message_kinds", f"SELECT user_id AS file, event_type AS kind, count(*) n, {st('sum(value)', 'total')} FROM events GROUP BY ALL")
def message_kinds(spark, sf_dir):
    """Events written as log lines of a key of their own kind, and routed by that key without a schema."""
    e = read(spark, sf_dir, "events")
    body = F.to_json(F.struct("value"))
    line = F.concat(F.lit('{"time": '), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit(', "'), F.col("event_type"), F.lit('": '), body, F.lit("}"))
    found = routed_messages.parts(routed_messages.messages(e.select(F.col("user_id").alias("file"), line.alias("value"))))
    values = found.select("file", "kind", F.try_variant_get("body", "$.value", "double").alias("v"))
    return values.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), stable(F.sum("v")).alias("total"))


# ---------------------------------------------------------------- thresholds


@query("thresholds_fitted")
def thresholds_fitted(spark, sf_dir):
    """Durations at which an exponential fitted to the false positive rates reaches 0.2; tests hold known curves."""
    rows = views.sig_short(spark, sf_dir)
    mean = rows.groupBy("roi").agg(F.avg("value").alias("m"))
    found = signals.both_polarities(rows.join(mean, "roi").withColumn("c", F.col("value") - F.col("m")), "c", ROI, 1.0)
    rates = thresholds.false_positive_rates(*signals.pooled_histograms(found))
    return rounded(thresholds.fitted_thresholds(rates, 0.2).drop("parameters"), "duration")


# ---------------------------------------------------------------- behaviour and tuning with gaps


@query("running_frames", with_views("sig_short") + _REFLECTED.format("CAST(trunc(value) AS BIGINT) > 20"))
def running_frames(spark, sf_dir):
    """Frames of running: velocity in whole numbers over 20, debounced with reflected ends."""
    rows = views.sig_short(spark, sf_dir).withColumn("velocity", F.col("value"))
    return rolling.running(rows, ROI, 1.0, 20, 4.0).select("roi", "frame", "running")


_K16 = spatial.gaussian_kernel(16, 2.0)


@query("velocity_smoothed", with_views("sig_long") + ", d AS (SELECT roi, frame, position - lag(position) OVER (PARTITION BY roi ORDER BY frame) d FROM sig_long), v AS (SELECT roi, frame, coalesce(last_value(CASE WHEN abs(d) <= 0.2::DOUBLE THEN d END IGNORE NULLS) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) * (2000 / 10 / 0.1::DOUBLE) v FROM d) SELECT roi, frame, " + st(" + ".join(f"coalesce({'lead' if o >= 0 else 'lag'}(v, {abs(o)}) OVER w, 0) * {_K16[7 - o]!r}::DOUBLE" for o in range(-8, 8)), "velocity") + " FROM v WINDOW w AS (PARTITION BY roi ORDER BY frame)")
def velocity_smoothed(spark, sf_dir):
    """Velocity in cm per second on a track of 2 m, smoothed over 0.2 s at 10 frames per second."""
    moving = signals.velocity(views.sig_long(spark, sf_dir), ROI).select("roi", "frame", "velocity")
    return rounded(signals.smoothed_velocity(moving, ROI, 0.1, 0.2, track=2000.0), "velocity")


@query(
    "tuning_gaps",
    with_views("sig_long")
    + ", t AS (SELECT roi, CAST(floor(position * 50.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long WHERE discount > 0.07::DOUBLE GROUP BY ALL), s AS (SELECT k.roi, CAST(b.bin AS INT) bin, t.v FROM (SELECT DISTINCT roi FROM t) k CROSS JOIN range(50) b(bin) LEFT JOIN t ON t.roi = k.roi AND t.bin = b.bin),"
    + " n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER p pb, last_value(v IGNORE NULLS) OVER p pv, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER q nb, first_value(v IGNORE NULLS) OVER q nv FROM s WINDOW p AS (PARTITION BY roi ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY roi ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
    + " i AS (SELECT roi, bin, v IS NULL gap, CASE WHEN v IS NOT NULL THEN v WHEN pb IS NOT NULL AND nb IS NOT NULL THEN pv + (nv - pv) * (bin - pb) / (nb - pb) ELSE coalesce(pv, nv) END v FROM n)"
    + f" SELECT roi, bin, CASE WHEN gap THEN NULL ELSE value END AS value FROM (SELECT roi, bin, gap, {st(' + '.join(f'''coalesce({'lead' if o >= 0 else 'lag'}(v, {abs(o)}) OVER w, 0) * {_K16[7 - o]!r}::DOUBLE''' for o in range(-8, 8)), 'value')} FROM i WINDOW w AS (PARTITION BY roi ORDER BY bin))",
)
def tuning_gaps(spark, sf_dir):
    """Pooled curves of 50 bins, interpolated, smoothed, and missing again where no frame was."""
    rows = views.sig_long(spark, sf_dir).where("discount > 0.07")
    return rounded(tuning.simple_tuning(rows, ROI, 50, 2.0), "value").select("roi", "bin", "value")


@query(
    "histogram_complete",
    with_views("sig_long")
    + ", m AS (SELECT roi, roi % 10 expt, frame, CASE WHEN raw % 500 >= 1 THEN raw END AS value FROM sig_long), g AS (SELECT DISTINCT expt, frame FROM m WHERE value IS NULL), c AS (SELECT m.* FROM m ANTI JOIN g ON g.expt = m.expt AND g.frame = m.frame),"
    + " h AS (SELECT roi, CAST(least(floor(value / 10000.0::DOUBLE), 9) AS INT) bin, count(*) n FROM c WHERE value BETWEEN 0 AND 100000 GROUP BY ALL) SELECT k.roi, CAST(b.bin AS INT) bin, coalesce(h.n, 0) n FROM (SELECT DISTINCT roi FROM c) k CROSS JOIN range(10) b(bin) LEFT JOIN h ON h.roi = k.roi AND h.bin = b.bin",
)
def histogram_complete(spark, sf_dir):
    """Histograms over the frames in which no region of the experiment misses its value."""
    rows = views.sig_long(spark, sf_dir).select("roi", (F.col("roi") % 10).alias("expt"), "frame", F.when(F.col("raw") % 500 >= 1, F.col("raw")).alias("value"))
    return aggregates.histogram(aggregates.complete_frames(rows, ["expt"], "frame"), "value", 0.0, 100000.0, 10, ROI)


@query("centres_thresholded", with_views("curves") + f", t AS (SELECT roi, context, bin, CASE WHEN value < 0.3::DOUBLE * max(value) OVER (PARTITION BY roi, context) THEN 0.0 ELSE value END v FROM curves) SELECT roi, context, {st('sum(bin * v) / nullif(sum(v), 0)', 'com')} FROM t GROUP BY roi, context")
def centres_thresholded(spark, sf_dir):
    """Centres of mass of what is at least 0.3 of the peak."""
    return rounded(spatial.centres(views.curves(spark, sf_dir), ["roi", "context"], 64, part=0.3).select("roi", "context", "com"), "com")


@query("population_correlations_p", with_views("curves") + f", x AS (SELECT * FROM curves WHERE value > 0.03::DOUBLE), y AS (SELECT * FROM curves WHERE value > 0.06::DOUBLE), c AS (SELECT x.context, x.bin a, y.bin b, corr(x.value, y.value) r, count(*) n FROM x JOIN y ON x.context = y.context AND x.roi = y.roi GROUP BY ALL), z AS (SELECT *, abs(r) s, n - 2 df FROM c) SELECT context, a, b, {st('CASE WHEN isfinite(r) THEN r END', 'r')}, n, {st(f'CASE WHEN NOT isfinite(r) OR df < 1 THEN NULL WHEN s > 0.999999999999::DOUBLE THEN 0 ELSE greatest(1 - ({_STUDENT}), 0) END', 'p')} FROM z")
def population_correlations_p(spark, sf_dir):
    """Populations at each bin under one filter against those at each bin under another, with probabilities."""
    c = views.curves(spark, sf_dir)
    return rounded(spatial.population_correlations(c.where("value > 0.03"), c.where("value > 0.06"), "roi", ["context"]), "r", "p")


@query(
    "rasters_padded",
    with_views("sig_long")
    + ", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL), f AS (SELECT roi, min(lap) + 2 first_lap FROM t GROUP BY roi), b AS (SELECT DISTINCT roi, bin FROM t), r AS (SELECT t.roi, CAST(lap - first_lap AS INT) step, bin, v FROM t JOIN f USING (roi) WHERE lap >= first_lap AND lap < first_lap + 20), h AS (SELECT DISTINCT roi, step FROM r)"
    + f" SELECT b.roi, CAST(s.s AS INT) step, b.bin, {st('CASE WHEN h.step IS NULL THEN 0.0 ELSE r.v END', 'value')} FROM b CROSS JOIN range(20) s(s) LEFT JOIN r ON r.roi = b.roi AND r.bin = b.bin AND r.step = s.s LEFT JOIN h ON h.roi = b.roi AND h.step = s.s",
)
def rasters_padded(spark, sf_dir):
    """Twenty laps of each raster from its third on; laps that are not there are 0."""
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10)
    first = t.groupBy("roi").agg((F.min("lap") + 2).alias("first_lap"))
    return rounded(population.padded_laps(t, first, ROI, 20, "bin"), "value")


@query(
    "cross_correlation_cropped",
    with_views("sig_long")
    + f", t AS (SELECT roi, lap, CAST(floor(position * 10.0::DOUBLE) AS INT) bin, avg(value) v FROM sig_long GROUP BY ALL) SELECT a.lap AS a, b.lap AS b, CAST(l.l AS INT) AS lag, {st('corr(a.v, b.v)', 'r')} FROM t a CROSS JOIN range(-2, 3) l(l) JOIN t b ON a.roi = b.roi AND a.lap < b.lap AND b.bin = a.bin + l.l GROUP BY ALL",
)
def cross_correlation_cropped(spark, sf_dir):
    """Correlation of the population between laps at small shifts, without the part that a shift wraps round."""
    t = spatial.tuning(views.sig_long(spark, sf_dir), ["roi", "lap"], 10)
    return rounded(spatial.cross_correlation(t, "lap", ROI, 10, -2, 2, crop=True), "r")


@query(
    "weight_report",
    "WITH w AS (SELECT c_name mouse_name, o_totalprice weight, o_orderdate date FROM customer JOIN orders ON o_custkey = c_custkey)"
    + f" SELECT mouse_name, date, weight, {st('average', 'average')} FROM (SELECT *, avg(weight) OVER (PARTITION BY mouse_name) average FROM w) QUALIFY row_number() OVER (PARTITION BY mouse_name ORDER BY date DESC, weight DESC) <= 3",
)
def weight_report(spark, sf_dir):
    """The newest three records of each mouse and the mean of all: customers as mice, orders as weights."""
    mice = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mouse_id"), F.col("c_name").alias("mouse_name"))
    weights = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mouse_id"), F.col("o_totalprice").alias("weight"), F.col("o_orderdate").alias("date"))
    return rounded(records.weight_report(records.weight_history(mice, weights), 3), "average")


@query(
    "centroid_order",
    with_views("curves") + f", c AS (SELECT context, roi, sum(bin * value) / nullif(sum(value), 0) c FROM curves GROUP BY ALL) SELECT context, roi, {st('c', 'centroid')}, CAST(row_number() OVER (PARTITION BY context ORDER BY c NULLS LAST, roi) - 1 AS INT) AS place FROM c",
)
def centroid_order(spark, sf_dir):
    """Regions of each session in order of their curve's centre of mass."""
    return rounded(selection.ranked_by_centroid(views.curves(spark, sf_dir), ["context", "roi"], ["context"]), "centroid")
