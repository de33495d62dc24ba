"""Helpers shared by the training-data operators: shared storage, row ids, gapless ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (driver and executors in one process, as in tests) gets a folder of its own;
    on a cluster that is an error, as executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-checkpoint-")
        where = _own[app]
    return where


#: Folders that the innermost ``scratch`` has staged, if there is one.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: The same of what surrounds that ``scratch``.
_outer: ContextVar[list[str] | None] = ContextVar("outer", default=None)


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; later jobs survive lost executors.

    ``by`` names a column of few values whose rows later steps read one value at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end; results that outlive it are staged after it, from tables that are still there."""
    held: list[str] = []
    outer, token = _outer.set(_scratch.get()), _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(token)
        _outer.reset(outer)
        delete(spark, held)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``staged`` outside the innermost ``scratch``: for a result that outlives it."""
    token = _scratch.set(_outer.get())
    try:
        return staged(df, tag)
    finally:
        _scratch.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to clash with none of ``taken`` (names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def row_copy(docs: DataFrame, tag: str, *columns: Column | str) -> tuple[DataFrame, str]:
    """A staged copy of ``columns`` (all, if none are named) with a row id, and the id's name.

    Ids made while a table is scanned depend on how its files are split, hence on the cluster's size at that
    moment. Operators that read rows more than once and join by id read this copy, whose ids are stored.
    """
    uid = fresh(docs.columns, "uid") if not columns else "uid"
    return staged(docs.select(F.monotonically_increasing_id().alias(uid), *(columns or docs.columns)), tag), uid


def texts_of(docs: DataFrame, tag: str) -> DataFrame:
    """(uid, doc_id, text) of all rows, staged: rows stay apart even where doc_id is null or repeated."""
    return row_copy(docs, tag, F.col("doc_id").cast("long").alias("doc_id"), "text")[0]


def numbered(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` with a row id ``uid`` for use inside one scan; see ``row_copy`` for ids that are joined later."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), *columns)


def gapless_rank(df: DataFrame, key: list[str], order: list[str], name: str, hottest: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within ``key``, without a task that holds all rows of one key.

    Rows of a key are dealt to about sqrt(hottest) hash buckets, ranked inside each bucket, and moved
    by the number of rows in the buckets before. ``hottest`` is the row count of the largest key;
    ``order`` must tell rows apart. ``df`` should be a staged table, as it is read twice.
    """
    buckets = max(1, int(hottest**0.5))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    starts = dealt.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    same = [ranked[c].eqNullSafe(starts[c]) for c in (*key, "_bucket")]
    rest = [ranked[c] for c in df.columns]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return ranked.join(starts, condition).select(*rest, (F.col("_rank") + F.col("_start")).cast("long").alias(name))


def utf8_bytes(text: Column) -> Column:
    """Bytes of a text in UTF-8; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
