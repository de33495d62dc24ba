"""Registered queries: the experiment catalog over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views
from .operators import catalog
from .registered import query, rounded, st
from .views import read, with_views


def _trials(spark, sf_dir):
    """Trials with their fields: trial_id, mouse_id, start_time, experiment_group, tSeries_path."""
    o = read(spark, sf_dir, "orders")
    path = F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("/data/"), (F.col("o_orderkey") % 10).cast("string")))
    return o.select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("mouse_id"), F.col("o_orderdate").alias("start_time"), F.col("o_orderpriority").alias("experiment_group"), path.alias("tSeries_path"))


def _attributes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).cast("string").alias("day"))
    return o.unpivot("trial_id", ["status", "day"], "attribute", "value")


def _mice(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("mouse_id"), F.col("c_name").alias("mouse_name")), c.select(F.col("c_custkey").alias("mouse_id"), F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("value"))


_T = "WITH t AS (SELECT o_orderkey trial_id, o_custkey mouse_id, o_orderdate start_time, o_orderpriority experiment_group, CASE WHEN o_totalprice > 100000 THEN '/data/' || (o_orderkey % 10) END AS \"tSeries_path\", o_orderstatus status, o_orderkey % 5 AS day FROM orders)"


@query("fetch_trials", _T + " SELECT trial_id, mouse_id, start_time, experiment_group, \"tSeries_path\" FROM t WHERE \"tSeries_path\" IS NOT NULL AND experiment_group IN ('1-URGENT', '2-HIGH') AND status IN ('F', 'O') AND day IN (0, 1, 2)")
def fetch_trials(spark, sf_dir):
    """Trials with an imaging series, of two projects, two states and three days; older names of fields."""
    return catalog.fetch_trials(_trials(spark, sf_dir), _attributes(spark, sf_dir), "tSeriesDirectory", project_name=["1-URGENT", "2-HIGH"], status=["F", "O"], day=[0, 1, 2])


@query("fetch_mice", _T + " SELECT c_custkey mouse_id, c_name mouse_name FROM customer c WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND EXISTS (SELECT 1 FROM t WHERE mouse_id = c_custkey AND status = 'F') AND EXISTS (SELECT 1 FROM t WHERE mouse_id = c_custkey AND experiment_group = '1-URGENT') AND EXISTS (SELECT 1 FROM t WHERE mouse_id = c_custkey AND starts_with(\"tSeries_path\", '/data/3'))")
def fetch_mice(spark, sf_dir):
    """Mice by an attribute of their own, one of their trials, a field of their trials, and project."""
    mice, own = _mice(spark, sf_dir)
    return catalog.fetch_mice(mice, _trials(spark, sf_dir), _attributes(spark, sf_dir), own, project="1-URGENT", segment=["BUILDING", "MACHINERY"], status="F", tSeries_path="/data/3")


@query("imaged_trials", _T + " SELECT trial_id, mouse_id, start_time, experiment_group, \"tSeries_path\" FROM t WHERE \"tSeries_path\" IS NOT NULL")
def imaged_trials(spark, sf_dir):
    return catalog.imaged_trials(_trials(spark, sf_dir))


@query("cohorts", _T + ", c AS (SELECT mouse_id, string_agg(trial_id, ',' ORDER BY start_time, trial_id) trial_ids, count(*) n_trials FROM t GROUP BY mouse_id) SELECT c_custkey mouse_id, c_name mouse_name, trial_ids, n_trials FROM customer LEFT JOIN c ON c.mouse_id = c_custkey")
def cohorts(spark, sf_dir):
    """Mice with their trials in order of time."""
    mice, _ = _mice(spark, sf_dir)
    return catalog.cohorts(_trials(spark, sf_dir), mice).withColumn("trial_ids", F.array_join("trial_ids", ","))


@query("attribute_values", _T + " SELECT status AS value, count(*) n FROM t GROUP BY status")
def attribute_values(spark, sf_dir):
    return catalog.attribute_values(_attributes(spark, sf_dir), "status")


@query("attribute_delete", _T + " SELECT trial_id, 'status' AS attribute, status AS value FROM t UNION ALL SELECT trial_id, 'day', CAST(day AS VARCHAR) FROM t WHERE status <> 'F'")
def attribute_delete(spark, sf_dir):
    """Attributes without the day of finished trials."""
    a = _attributes(spark, sf_dir)
    gone = a.where("attribute = 'status' and value = 'F'").select("trial_id", F.lit("day").alias("attribute"))
    return catalog.without_attributes(a, gone)


@query("trial_info_attributes", "SELECT o_orderkey trial_id, 'led_context' AS attribute, '{\"radius\":' || (o_orderkey % 7) || '}' AS value FROM orders UNION ALL SELECT o_orderkey, 'day', CAST(o_orderkey % 5 AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, 'tags', '[\"' || o_orderstatus || '\"]' FROM orders")
def trial_info_attributes(spark, sf_dir):
    """A trial's JSON info as attributes, contexts one by one."""
    o = read(spark, sf_dir, "orders")
    info = F.format_string('{"mouse": "m%d", "start_time": "x", "controllers": {"ip": 1}, "contexts": {"led": {"radius":%d}}, "day": %d, "tags": ["%s"]}', "o_custkey", F.col("o_orderkey") % 7, F.col("o_orderkey") % 5, "o_orderstatus")
    return catalog.flattened(o.select(F.col("o_orderkey").alias("trial_id"), info.alias("trial_info")))


@query("latest_labels", _T + " SELECT mouse_id, max_by(experiment_group, (start_time, experiment_group)) AS label FROM t GROUP BY mouse_id")
def latest_labels(spark, sf_dir):
    """The label that each mouse's trials got last."""
    return catalog.latest_label(_trials(spark, sf_dir).select("mouse_id", "start_time", F.col("experiment_group").alias("label")), ["mouse_id"], "start_time")


@query("condition_pairs", with_views("sig_short") + f", p AS (SELECT roi, avg(CASE WHEN kind = 'view' THEN value END) f, avg(CASE WHEN kind = 'click' THEN value END) s FROM sig_short GROUP BY roi) SELECT roi, {st('f', 'first')}, {st('s', 'second')} FROM p WHERE f IS NOT NULL AND s IS NOT NULL")
def condition_pairs(spark, sf_dir):
    """Mean values of two conditions side by side."""
    return rounded(catalog.paired_series(views.sig_short(spark, sf_dir), "kind", "view", "click", ["roi"]), "first", "second")


@query("pair_optimally")
def pair_optimally(spark, sf_dir):
    """Pairs of experiments a month apart at most, each in one pair, of least total distance; tests hold it against all pairings."""
    t = views.trials(spark, sf_dir).select("mouse_id", F.col("trial_id").alias("id"), F.col("start_time").alias("time"), "price")
    return catalog.pair_optimally(t.where("price > 200000"), t.where("price <= 200000"), "mouse_id", 2592000)
