"""Log messages of any kind: each key of a message is routed to the handler of that name, unknown keys to a default."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A handler takes (key columns, t, kind, body variant) rows of its kind and returns rows of whatever shape it likes.
Handler = Callable[[DataFrame], DataFrame]


def messages(lines: DataFrame, key: str = "file", text: str = "value", time: str = "time") -> DataFrame:
    """(key, t, message): lines that are JSON objects, as variants; t is null where a message has no time.

    Lines that are no JSON, or JSON but no object, are left out (``unreadable`` lists them). Nothing is said about what a
    message may hold, so a log of a newer program is read without a change here.
    """
    rows = lines.select(key, F.try_parse_json(text).alias("message"))
    rows = rows.where(F.schema_of_variant("message").startswith("OBJECT"))
    return rows.select(key, F.try_variant_get("message", f"$.{time}", "double").alias("t"), "message")


def unreadable(lines: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """(key, broken): the lines that ``messages`` leaves out, but for blank ones."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return lines.where((F.length(F.trim(text)) > 0) & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select(key, F.col(text).alias("broken"))


def parts(found: DataFrame, key: str = "file", skip: Iterable[str] = ("time",)) -> DataFrame:
    """(key, t, kind, body): a row for each key of each message but those to ``skip``; the body is the key's value, as a variant."""
    spark = found.sparkSession
    rows = found.lateralJoin(spark.tvf.variant_explode(F.col("message").outer())).select(key, "t", F.col("key").alias("kind"), F.col("value").alias("body"))
    return rows.where(~F.col("kind").isin(*skip)) if (skip := list(skip)) else rows


def routed(found: DataFrame, handlers: dict[str, Handler], default: Handler | None = None) -> dict[str, DataFrame]:
    """What each handler makes of the rows of its kind, by name; ``default`` takes, under the name "", all kinds without a handler.

    ``found`` is what ``parts`` gives: one plan for each handler, each over the rows of one kind.
    """
    out = {kind: handle(found.where(F.col("kind") == kind)) for kind, handle in handlers.items()}
    if default is not None:
        out[""] = default(found.where(~F.col("kind").isin(*handlers)) if handlers else found)
    return out


def fields(kinds: dict[str, str]) -> Handler:
    """A handler that reads fields of the body: a column for each name in ``kinds``, of its type; null where absent or of another type."""

    def handle(rows: DataFrame) -> DataFrame:
        return rows.select(*(c for c in rows.columns if c not in ("kind", "body")), *(F.try_variant_get("body", f"$.{name}", kind).alias(name) for name, kind in kinds.items()))

    return handle


def trial_info(rows: DataFrame) -> DataFrame:
    """The default handler: (key columns, name, value), the latest value of each name as JSON; ties go to the greater text."""
    keys = [c for c in rows.columns if c not in ("t", "kind", "body")]
    text = F.to_json("body")
    return rows.groupBy(*keys, F.col("kind").alias("name")).agg(F.max(F.struct(F.col("t"), text.alias("v")))["v"].alias("value"))


def leaves(found: DataFrame, key: str = "file") -> DataFrame:
    """(key, kind, path, type, n): which fields occur in the messages of each kind, two levels deep, for a first look at an unknown log."""
    spark = found.sparkSession
    one = parts(found, key, ())
    deep = one.lateralJoin(spark.tvf.variant_explode_outer(F.col("body").outer())).select(key, "kind", F.col("key").alias("path"), F.coalesce(F.col("value"), F.col("body")).alias("leaf"))
    return deep.groupBy(key, "kind", "path", F.schema_of_variant("leaf").alias("type")).agg(F.count(F.lit(1)).alias("n"))
