"""Windows and running state over event streams; every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by event-time window; rows later than ``late`` are left out of a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    out = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def smoothed_stream(rows: DataFrame, key: str, order: str, value: str, weight: float = 0.6, last: int = 5) -> DataFrame:
    """The smoothing of ``lectern.operators.state`` over an endless stream: the last outputs of a key are its state.

    Rows of a key are taken in ``order`` within a micro-batch.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        got = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in got[value]:
            y = max(-1.0, min(1.0, weight * x + (1 - weight) * sum(past) / len(past) if past else x))
            past = [*past, y][-last:]
            out.append(y)
        state.update((past,))
        yield pd.DataFrame({key: k[0], order: got[order].to_numpy(), "y": out})

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, y double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def analysed_stream(texts: DataFrame, columns: dict[str, Column], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Starts a query that scores each micro-batch by the same expressions as the batch form and hands it to ``sink``."""
    scored = texts.select("*", *(c.alias(k) for k, c in columns.items()))
    return scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def recent(log: DataFrame, n: int = 1000, kind: str | None = None) -> DataFrame:
    """The last ``n`` events of an append-only log."""
    rows = log.where(F.col("event_type") == kind) if kind else log
    return rows.orderBy(F.desc("ts"), "event_id").limit(n)
