"""Streams of log messages: windowed counts with late data, and start/stop pairing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Count and sum of ``value`` by kind and time window; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "kind", "n", "value")


def paired_stream(stream: DataFrame, key: str = "roi") -> DataFrame:
    """Intervals (key, onset, offset) from messages (key, t, action): the state is the open start of each key."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_ = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("t")
        for t, action in zip(rows["t"], rows["action"], strict=True):
            if action == "start":
                open_ = float(t)
            elif open_ is not None:
                out.append((keys[0], open_, float(t)))
                open_ = None
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_,))
        yield pd.DataFrame(out, columns=[key, "onset", "offset"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, onset double, offset double", "open double", "append", "NoTimeout")
