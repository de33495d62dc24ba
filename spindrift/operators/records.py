"""Tables beside the catalog: weights of mice, viruses and the pages of mice, each with attributes in long form."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weight_history(mice: DataFrame, weights: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(mouse_name, weight, date) of all mice or of those named; mice (mouse_id, mouse_name), weights (mouse_id, weight, date)."""
    chosen = mice if names is None else mice.where(F.col("mouse_name").isin(names))
    return chosen.select("mouse_id", "mouse_name").join(weights.select("mouse_id", "weight", "date"), "mouse_id").select("mouse_name", "weight", "date")


def weight_report(history: DataFrame, limit: int = 10) -> DataFrame:
    """The newest ``limit`` records of each mouse (ties: the greater weight), with the mean of all its records: mouse_name, date, weight, average."""
    mean = history.groupBy("mouse_name").agg(F.avg("weight").alias("average"))
    w = Window.partitionBy("mouse_name").orderBy(F.desc("date"), F.desc("weight"))
    newest = history.withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= limit).drop("_o")
    return newest.join(mean, "mouse_name").select("mouse_name", "date", "weight", "average")


def with_weight(weights: DataFrame, mice: DataFrame, name: str, weight: float, date: datetime.datetime | None = None) -> DataFrame:
    """``weights`` with one more record, of now unless dated. A name that no mouse or more than one has is an error."""
    found = mice.where(F.col("mouse_name") == name).select("mouse_id").limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{'no' if not found else 'more than one'} mouse is called {name}")
    at = F.current_timestamp() if date is None else F.lit(date)
    kinds = {f.name: f.dataType for f in weights.schema.fields}
    more = mice.sparkSession.range(1).select(F.lit(found[0][0]).cast(kinds["mouse_id"]).alias("mouse_id"), F.lit(weight).cast(kinds["weight"]).alias("weight"), at.cast(kinds["date"]).alias("date"))
    return weights.unionByName(more, allowMissingColumns=True)


def with_attributes(entities: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Viruses, pages or mice with their attributes as a map; of an attribute set twice the greater value is kept.

    ``attributes`` has (key, attribute, value). An entity without any has an empty map.
    """
    last = attributes.where("attribute is not null").groupBy(key, "attribute").agg(F.max("value").alias("value"))
    maps = last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))
    empty = F.create_map().cast("map<string,string>")
    return entities.join(maps, key, "left").withColumn("attributes", F.coalesce(F.col("attributes").cast("map<string,string>"), empty))


def mouse_page(mice: DataFrame, pages: DataFrame, name: str) -> DataFrame:
    """(attribute, value) of the page of one mouse."""
    return pages.join(mice.where(F.col("mouse_name") == name).select("mouse_id"), "mouse_id", "left_semi").select("attribute", "value")
