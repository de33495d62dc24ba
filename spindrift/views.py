"""The driver's tables as signals, curves, behaviour and catalog, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of one region per user: roi, frame, t (seconds), value, kind."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("roi"), (F.row_number().over(w) - 1).alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value", F.col("event_type").alias("kind"))


def sig_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of one region per supplier: roi, frame, lap, position, raw, npil, value (= raw), discount."""
    w = Window.partitionBy("l_suppkey").orderBy(*TRACE_ORDER)
    e = read(spark, sf_dir, "lineitem").withColumn("frame", F.row_number().over(w) - 1)
    return e.select(
        F.col("l_suppkey").alias("roi"), "frame", F.floor(F.col("frame") / 50).cast("int").alias("lap"), ((F.col("l_quantity") - 1) / F.lit(50.0)).alias("position"),
        F.col("l_extendedprice").alias("raw"), (F.col("l_extendedprice") * F.col("l_discount")).alias("npil"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("discount"),
    )


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning curves of 64 bins: roi, context, bin, value (not negative)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("roi"), F.col("label").alias("context"), F.posexplode("embedding").alias("bin", "v")).select("roi", "context", "bin", F.abs(F.col("v").cast("double")).alias("value"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("mouse_id"), F.col("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("price"))


def trial_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of trials in long form: trial_id, attribute, value."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.unpivot("trial_id", ["status", "priority"], "attribute", "value")


#: The same views for DuckDB.
SQL = {
    "sig_short": "sig_short AS (SELECT user_id roi, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) frame, epoch_us(ts) / 1e6 t, value, event_type kind FROM events)",
    "sig_long": "sig_0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INT) frame FROM lineitem), sig_long AS (SELECT l_suppkey roi, frame, CAST(frame // 50 AS INT) lap, (l_quantity - 1) / 50.0::DOUBLE AS position, l_extendedprice raw, l_extendedprice * l_discount npil, l_extendedprice AS value, l_discount discount FROM sig_0)",
    "curves": "curves AS (SELECT roi, context, CAST(bin - 1 AS INT) bin, abs(CAST(v AS DOUBLE)) AS value FROM (SELECT vec_id roi, label context, unnest(generate_series(1, len(embedding))) bin, unnest(embedding) v FROM embeddings))",
    "trials": "trials AS (SELECT o_orderkey trial_id, o_custkey mouse_id, o_orderdate start_time, o_totalprice price FROM orders)",
    "trial_attributes": "trial_attributes AS (SELECT o_orderkey trial_id, 'status' AS attribute, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders)",
}


def with_views(*names: str) -> str:
    """The WITH clause of these views, open for more."""
    return "WITH " + ", ".join(SQL[n] for n in names)
