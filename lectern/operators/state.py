"""Order-dependent measures: each key's rows are read in order and a small state goes from row to row.

Rows are dealt by key, sorted, and passed on as they come, so neither a task nor the driver holds a key's history; a
key is read by one task, as its order demands. For endless inputs use the streaming forms in ``lectern.streaming``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.shipping import map_arrow


def scanned(df: DataFrame, key: list[str], by: str, values: list[str], start: Callable, step: Callable, outs: str, last_only: bool = False) -> DataFrame:
    """(key, by, outs): ``step(state, *values)`` of every row in the order of ``by`` gives the next state and the outs; with ``last_only`` a key's last."""
    kept = [*key, by]
    own = df.select(*kept, *values)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + f", {outs}"
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, held = None, None, None
        for b in batches:
            rows = []
            for row in zip(*(b.column(c).to_pylist() for c in [*kept, *values]), strict=True):
                own_key = row[: len(key)]
                if state is None or own_key != last:
                    if last_only and held is not None:
                        rows.append(held)
                    last, state = own_key, start()
                state, out = step(state, *row[len(kept) :])
                held = (*row[: len(kept)], *out)
                if not last_only:
                    rows.append(held)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
        if last_only and held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, target, strict=True)], schema=target)

    return map_arrow(own.repartition(*key).sortWithinPartitions(*key, by, *values), run, schema)


def smoothed(df: DataFrame, key: list[str], by: str, value: str, weight: float = 0.6, last: int = 5) -> DataFrame:
    """y: ``value`` drawn to the mean of the last outputs of its key, clipped to -1..1; the first stays as it is, a null has none.

    The key is the scope of the history: a document, or a speaker or a constant for a history that goes on across documents.
    """

    def step(past: deque, x: float | None) -> tuple:
        if x is None:
            return past, (None,)
        y = weight * x + (1 - weight) * (sum(past) / len(past)) if past else x
        past.append(max(-1.0, min(1.0, y)))
        return past, (past[-1],)

    return scanned(df, key, by, [value], lambda: deque(maxlen=last), step, "y double")


def ema(df: DataFrame, key: list[str], by: str, value: str, alpha: float = 0.1, start: float = 0.0) -> DataFrame:
    """The last exponential moving average of each key; nulls are passed over."""

    def step(a: float, x: float | None) -> tuple:
        a = a if x is None else a * (1 - alpha) + x * alpha
        return a, (a,)

    return scanned(df, key, by, [value], lambda: start, step, "ema double", last_only=True).select(*key, "ema")


def breaker(df: DataFrame, key: list[str], by: str, ok: str, seconds: str, failures: int = 5, wait: float = 60.0, successes: int = 3) -> DataFrame:
    """The state of a circuit breaker after each call: closed, open or half_open, and whether the call was let through.

    ``seconds`` is the time of a call. After ``failures`` failures it opens; ``wait`` seconds later a call tries it (half open);
    ``successes`` in a row close it. Failures counted before stay, so one more opens a half-open breaker.
    """

    def step(s: tuple, good_call: bool | None, t: float) -> tuple:
        state, bad, good, since = s
        if state == "open":
            if t - since < wait:
                return s, ("open", False)
            state, good = "half_open", 0
        if good_call:
            good += state == "half_open"
            if state != "half_open" or good >= successes:
                bad = 0
            if state == "half_open" and good >= successes:
                state = "closed"
        else:
            bad, good = bad + 1, 0
            if bad >= failures:
                state, since = "open", t
        return (state, bad, good, since), (state, True)

    return scanned(df, key, by, [ok, seconds], lambda: ("closed", 0, 0, 0.0), step, "state string, passed boolean")


def adaptive_delay(df: DataFrame, key: list[str], by: str, code: str, floor: float = 1.0, cap: float = 300.0) -> DataFrame:
    """The delay of a rate limiter after each response: 429 times 1.5, 5xx times 1.2, others times .95, within floor and cap."""

    def step(delay: float, c: int) -> tuple:
        delay = max(floor, min(cap, delay * (1.5 if c == 429 else 1.2 if c >= 500 else 0.95)))
        return delay, (delay,)

    return scanned(df, key, by, [code], lambda: floor, step, "delay double")


def limited(df: DataFrame, key: list[str], by: str, seconds: str, code: str, rate: float = 1.0, burst: int = 5, cap: float = 300.0) -> DataFrame:
    """When each request of a key goes out, and the delay after its response: a burst window and an adaptive delay.

    ``seconds`` is when a request comes. It waits until fewer than ``burst`` went out in the last ``burst / rate`` seconds, and until the
    delay since the last one is over; the responses change the delay as in ``adaptive_delay``, whose floor is 1 / rate.
    """
    window = burst / rate

    def step(s: tuple, t: float, c: int) -> tuple:
        sent, last, delay = s
        now = t if last is None else max(t, last)
        while sent and now - sent[0] >= window:
            sent.popleft()
        at = now
        if len(sent) >= burst:
            at += max(0.0, sent[0] + window - now)
        if last is not None:
            at += max(0.0, delay - (now - last))
        sent.append(at)
        delay = max(1 / rate, min(cap, delay * (1.5 if c == 429 else 1.2 if c >= 500 else 0.95)))
        return (sent, at, delay), (at, delay)

    return scanned(df, key, by, [seconds, code], lambda: (deque(), None, 1 / rate), step, "sent_at double, delay double")
