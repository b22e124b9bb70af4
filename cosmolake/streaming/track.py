"""Streams of catalogue events: windowed counts, and state along tracks. An extension: the batch operators don't need it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) per tumbling window; events later than ``late`` are dropped."""
    x = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("start"), key, "n")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["time", "id"])
    out = []
    for r in rows.itertuples():
        if before is not None and r.state != before:
            out.append((key[0], r.id, before, r.state))
        before = r.state
    if before is not None:
        state.update((before,))
    yield pd.DataFrame(out, columns=["key", "id", "before", "state"])


def transitions(events: DataFrame) -> DataFrame:
    """(key, id, before, state) of a stream (key, id, time, state): changes of each key's state, in the order of arrival batches, then time."""
    return events.groupBy("key").applyInPandasWithState(_step, "key long, id long, before string, state string", "state string", "append", GroupStateTimeout.NoTimeout)
