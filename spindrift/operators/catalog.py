"""The experiment catalog: trials, mice, attributes; metadata and predicates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_all(trials: DataFrame, attributes: DataFrame, wanted: dict[str, str | None], key: str = "trial_id") -> DataFrame:
    """Trials that have every attribute in ``wanted`` with that value (None: any value), in one aggregation."""
    hit = lambda a, v: F.max((F.col("attribute") == a) & (F.lit(True) if v is None else F.col("value") == v))
    checked = attributes.where(F.col("attribute").isin(*wanted)).groupBy(key).agg(*(F.coalesce(hit(a, v), F.lit(False)).alias(f"_h{i}") for i, (a, v) in enumerate(wanted.items())))
    return trials.join(checked.where(reduce(lambda a, b: a & b, (F.col(f"_h{i}") for i in range(len(wanted))))).select(key), key, "left_semi")


def attributes_as_map(attributes: DataFrame, key: str = "trial_id") -> DataFrame:
    """All attributes of each trial as one map."""
    return attributes.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def annotate(signals: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of metadata; keys are cast to the signals' types."""
    cast = metadata.select(*(F.col(k).cast(signals.schema[k].dataType) if k in keys else F.col(k) for k in metadata.columns))
    return signals.join(cast, keys, "left")


def composed(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata of several files as one: outer joins on ``keys``, each other column once, its first value that is not null."""
    out = tables[0]
    for table in tables[1:]:
        both = [c for c in table.columns if c in out.columns and c not in keys]
        met = out.join(table.withColumnsRenamed({c: f"_2_{c}" for c in both}), keys, "full")
        out = met.withColumns({c: F.coalesce(c, f"_2_{c}") for c in both}).drop(*(f"_2_{c}" for c in both))
    return out


def pair_within(left: DataFrame, right: DataFrame, key: str, seconds: float) -> DataFrame:
    """Pairs of rows of one key whose times are at most ``seconds`` apart, the nearest right row for each left one.

    Columns (key, id, time) on either side; times are bucketed, so that the join is on equality.
    """
    b = lambda c, d=0: F.floor((c.cast("double") + d) / F.lit(float(seconds)))
    l_ = left.select(key, F.col("id").alias("left_id"), F.col("time").cast("timestamp").cast("double").alias("lt"))
    l_ = l_.withColumn("_b", F.explode(F.sequence(b(F.col("lt"), -seconds), b(F.col("lt"), seconds))))
    r_ = right.select(key, F.col("id").alias("right_id"), F.col("time").cast("timestamp").cast("double").alias("rt")).withColumn("_b", b(F.col("rt")))
    met = l_.join(r_, [key, "_b"]).withColumn("apart", F.abs(F.col("lt") - F.col("rt"))).where(F.col("apart") <= seconds)
    return met.groupBy(key, "left_id").agg(F.min(F.struct("apart", "right_id")).alias("x")).select(key, "left_id", F.col("x.right_id").alias("right_id"), F.col("x.apart").alias("apart"))


def newest(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_o", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_o") <= n).drop("_o")


class Filter:
    """A predicate on rows: & or * for both, | or + for either, ^ for one of two, ~ or a leading - for not.

    ``a - b`` is ``a | ~b``, as users of such filters know it; ``a.and_not(b)`` is the difference of sets.
    """

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: Filter) -> Filter:
        return Filter(self.column & other.column)

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.column | other.column)

    def __xor__(self, other: Filter) -> Filter:
        return Filter(self.column != other.column)

    def __invert__(self) -> Filter:
        return Filter(~self.column)

    __mul__, __add__, __neg__ = __and__, __or__, __invert__

    def __sub__(self, other: Filter) -> Filter:
        return self | ~other

    def and_not(self, other: Filter) -> Filter:
        return self & ~other

    def keep(self, df: DataFrame) -> DataFrame:
        """Rows for which it holds."""
        return df.where(self.column)

    def mask(self, df: DataFrame, value: str = "value") -> DataFrame:
        """All rows; ``value`` is null where it does not hold."""
        return df.withColumn(value, F.when(self.column, F.col(value)))


# ---------------------------------------------------------------- search

#: Older names of trial fields. Fixed values.
RENAMED = {"startTime": "start_time", "time": "start_time", "stopTime": "stop_time", "tSeriesDirectory": "tSeries_path", "project_name": "experiment_group"}


def _listed(v) -> list:
    return list(v) if isinstance(v, (list, tuple, set)) else [v]


def fetch_trials(trials: DataFrame, attributes: DataFrame, *required: str, **wanted) -> DataFrame:
    """Trials with all ``required`` fields or attributes, and with one of the values wanted of each.

    A name that is a column of ``trials`` is a field (null: absent), any other an attribute; values may be lists,
    of which one is enough; older names are understood; ``tSeries_path`` is matched by its beginning.
    """
    required, wanted = [RENAMED.get(k, k) for k in required], {RENAMED.get(k, k): v for k, v in wanted.items()}
    own = lambda k: k in trials.columns
    out = trials
    for k in filter(own, required):
        out = out.where(F.col(k).isNotNull())
    for k in filter(own, wanted):
        alternatives = [F.col(k).startswith(v) if k == "tSeries_path" else F.col(k) == F.lit(v).cast(trials.schema[k].dataType) for v in _listed(wanted[k])]
        out = out.where(reduce(lambda a, b: a | b, alternatives))
    tests = [(k, None) for k in required if not own(k)] + [(k, [str(x) for x in _listed(v)]) for k, v in wanted.items() if not own(k)]
    if not tests:
        return out
    # one aggregation for all attributes
    hit = lambda k, v: F.coalesce(F.max((F.col("attribute") == k) & (F.lit(True) if v is None else F.col("value").isin(v))), F.lit(False))
    checked = attributes.where(F.col("attribute").isin([k for k, _ in tests])).groupBy("trial_id").agg(*(hit(k, v).alias(f"_h{i}") for i, (k, v) in enumerate(tests)))
    return out.join(checked.where(reduce(lambda a, b: a & b, (F.col(f"_h{i}") for i in range(len(tests))))).select("trial_id"), "trial_id", "left_semi")


def fetch_mice(mice: DataFrame, trials: DataFrame, trial_attributes: DataFrame, mouse_attributes: DataFrame, *required: str, project: str | None = None, **wanted) -> DataFrame:
    """Mice of which one trial has all the trial fields wanted, and that have each attribute themselves or in a trial.

    ``project`` keeps mice with a trial in that experiment group or with that attribute project_name.
    """
    fields = [c for c in trials.columns]
    out = mice
    of_trials = {k: v for k, v in wanted.items() if k in fields}
    named = [k for k in required if k in fields]
    if of_trials or named:
        out = out.join(fetch_trials(trials, trial_attributes, *named, **of_trials).select("mouse_id").distinct(), "mouse_id", "left_semi")
    own = mouse_attributes.select("mouse_id", "attribute", "value")
    theirs = trial_attributes.join(trials.select("trial_id", "mouse_id"), "trial_id").select("mouse_id", "attribute", "value")
    every = own.unionByName(theirs)
    tests = [(k, None) for k in required if k not in fields] + [(k, [str(x) for x in _listed(v)]) for k, v in wanted.items() if k not in fields]
    if tests:
        hit = lambda k, v: F.coalesce(F.max((F.col("attribute") == k) & (F.lit(True) if v is None else F.col("value").isin(v))), F.lit(False))
        checked = every.where(F.col("attribute").isin([k for k, _ in tests])).groupBy("mouse_id").agg(*(hit(k, v).alias(f"_h{i}") for i, (k, v) in enumerate(tests)))
        out = out.join(checked.where(reduce(lambda a, b: a & b, (F.col(f"_h{i}") for i in range(len(tests))))).select("mouse_id"), "mouse_id", "left_semi")
    if project is not None:
        inside = trials.where(F.col("experiment_group") == project).select("mouse_id").union(own.where((F.col("attribute") == "project_name") & (F.col("value") == project)).select("mouse_id"))
        out = out.join(inside.distinct(), "mouse_id", "left_semi")
    return out


def mouse_id(mice: DataFrame, name: str) -> int:
    """The id of the one mouse of that name; KeyError if there is none or more than one."""
    found = mice.where(F.col("mouse_name") == name).select("mouse_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"no single mouse is named {name}")
    return found[0]["mouse_id"]


def with_mouse(mice: DataFrame, name: str) -> DataFrame:
    """``mice`` with a mouse of that name: a new one, of the next free id, if there is none."""
    if not mice.where(F.col("mouse_name") == name).isEmpty():
        return mice
    new = mice.agg((F.coalesce(F.max("mouse_id"), F.lit(0)) + 1).cast(mice.schema["mouse_id"].dataType).alias("mouse_id")).withColumn("mouse_name", F.lit(name))
    return mice.unionByName(new, allowMissingColumns=True)


def imaged_trials(trials: DataFrame) -> DataFrame:
    """Trials with an imaging series."""
    return trials.where(F.col("tSeries_path").isNotNull() & (F.col("tSeries_path") != ""))


def mouse_trials(trials: DataFrame, mouse: int) -> DataFrame:
    """Trials of one mouse in order of time."""
    return trials.where(F.col("mouse_id") == mouse).orderBy("start_time", "trial_id")


def attribute_values(attributes: DataFrame, attribute: str) -> DataFrame:
    """Distinct values of one attribute, and how many rows have each."""
    return attributes.where(F.col("attribute") == attribute).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def projects(trials: DataFrame) -> DataFrame:
    """Distinct experiment groups."""
    return trials.where("experiment_group is not null").select("experiment_group").distinct()


def without_attributes(attributes: DataFrame, gone: DataFrame) -> DataFrame:
    """``attributes`` without the rows that ``gone`` names by any of its columns (key, or key and attribute)."""
    return attributes.join(gone.distinct(), gone.columns, "left_anti")


def flattened(infos: DataFrame, info: str = "trial_info", key: str = "trial_id") -> DataFrame:
    """Attributes (key, attribute, value) of a trial's JSON info: each context as ``<name>_context``, other objects and
    lists as JSON, controllers left out, names that are fields of the trial left out.
    """
    fields = ["mouse", "start_time", "stop_time", "experiment_group", "controllers"]
    top = infos.select(key, F.explode(F.from_json(info, "map<string,string>")).alias("attribute", "value"))
    plain = top.where(~F.col("attribute").isin(*fields, "contexts"))
    contexts = top.where("attribute = 'contexts'").select(key, F.explode(F.from_json("value", "map<string,string>")).alias("_c", "value"))
    return plain.unionByName(contexts.select(key, F.concat("_c", F.lit("_context")).alias("attribute"), "value"))


def cohorts(trials: DataFrame, mice: DataFrame | None = None) -> DataFrame:
    """One row per mouse with its trials in order of time: mouse_id, trial_ids, n_trials."""
    order = F.sort_array(F.collect_list(F.struct("start_time", "trial_id")))
    out = trials.groupBy("mouse_id").agg(F.transform(order, lambda x: x["trial_id"]).alias("trial_ids"), F.count(F.lit(1)).alias("n_trials"))
    return out if mice is None else mice.join(out, "mouse_id", "left")


def one_mouse(trials: DataFrame) -> DataFrame:
    """``trials``, which must be of one mouse: ValueError if they are of several."""
    if trials.select("mouse_id").distinct().limit(2).count() > 1:
        raise ValueError("trials of several mice")
    return trials


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` as they are: what an edit has to write."""
    return new.select(*old.columns).exceptAll(old) if set(keys) <= set(old.columns) else new


def bind_by_place(signals: DataFrame, values: DataFrame, order: str, name: str) -> DataFrame:
    """Metadata without a key: the i-th region (by ``order``) takes the value at ``place`` i; a single value goes to all.

    ``values`` has (place, value); other numbers of values than regions are an error.
    """
    regions = signals.select(order).distinct()
    n, m = regions.count(), values.count()
    if m == 1:
        return signals.join(F.broadcast(values.select(F.col("value").alias(name))))
    if n != m:
        raise ValueError(f"{m} values for {n} regions")
    # one row per region of an experiment
    placed = regions.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
    return signals.join(placed.join(values.select(F.col("place").cast("int").alias("place"), F.col("value").alias(name)), "place").drop("place"), order)


def paired_series(df: DataFrame, condition: str, first: str, second: str, keys: list[str], value: str = "value") -> DataFrame:
    """Values of two conditions side by side for keys that have both: keys, first, second."""
    side = lambda c, n: F.avg(F.when(F.col(condition) == c, F.col(value))).alias(n)
    return df.where(F.col(condition).isin(first, second)).groupBy(*keys).agg(side(first, "first"), side(second, "second")).where("first is not null and second is not null")


def latest_label(labels: DataFrame, keys: list[str], made: str = "created_at") -> DataFrame:
    """The label that each experiment got last; of several made at once the greatest name."""
    return labels.groupBy(*keys).agg(F.max(F.struct(made, "label")).alias("_x")).select(*keys, F.col("_x.label").alias("label"))


def pair_optimally(left: DataFrame, right: DataFrame, key: str, seconds: float) -> DataFrame:
    """Pairs of rows of one key whose times are at most ``seconds`` apart: as many as can be, each row once, of least total distance."""
    from .models import assigned

    b = lambda c, d=0: F.floor((c + d) / F.lit(float(seconds)))
    l_ = left.select(key, F.col("id").alias("a"), F.col("time").cast("timestamp").cast("double").alias("_lt"))
    l_ = l_.withColumn("_b", F.explode(F.sequence(b(F.col("_lt"), -seconds), b(F.col("_lt"), seconds))))
    r_ = right.select(key, F.col("id").alias("b"), F.col("time").cast("timestamp").cast("double").alias("_rt")).withColumn("_b", b(F.col("_rt")))
    met = l_.join(r_, [key, "_b"]).withColumn("apart", F.abs(F.col("_lt") - F.col("_rt"))).where(F.col("apart") <= seconds)
    found = assigned(met.select(key, "a", "b", "apart"), [key], float(seconds), "apart")
    return found.select(key, F.col("a").alias("left_id"), F.col("b").alias("right_id"), "apart")


# ---------------------------------------------------------------- groups of filters


def all_of(*filters: Filter) -> Filter:
    """All hold; none given: everything does."""
    return reduce(lambda a, b: a & b, filters, everything())


def any_of(*filters: Filter) -> Filter:
    """One holds at least; none given: nothing does."""
    return reduce(lambda a, b: a | b, filters, ~everything())


def everything() -> Filter:
    """Selects all: rows (regions) and columns (frames) alike."""
    return Filter(F.lit(True))


def between(onset: float, offset: float, position: str = "position") -> Filter:
    """Frames strictly between two positions."""
    return Filter((F.col(position) > onset) & (F.col(position) < offset))


def valid_samples(threshold: float = 5.0, iti: str = "iti", velocity: str = "velocity") -> Filter:
    """Frames outside pauses at which the animal runs faster than ``threshold``; unknown counts as not."""
    return Filter(F.coalesce(~F.col(iti), F.lit(False)) & F.coalesce(F.col(velocity) > threshold, F.lit(False)))
