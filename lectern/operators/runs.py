"""Runs that go on where they stopped: what is left to do, and failed rows done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remaining(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is left of ``work`` after the keys a checkpoint table says are done."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def done_in_batches(work: DataFrame, done: DataFrame | None, key: list[str], batch: Column, names: list, step: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None]) -> list:
    """Batches of ``work``, by the value of ``batch``, one after the other; those whose keys are all in ``done`` are skipped.

    ``save`` stores what ``step`` makes of the rows left of a batch. Gives the batches that were run; called again after a
    failure with what was stored as ``done``, it goes on with the rest.
    """
    ran = []
    for name in names:
        rows = work.where(batch == F.lit(name))
        rows = rows if done is None else remaining(rows, done, key)
        if not rows.isEmpty():
            save(step(rows))
            ran.append(name)
    return ran


def reprocessed(rows: DataFrame, key: str, status: str, step: Callable[[DataFrame], DataFrame], failed: str = "failed") -> DataFrame:
    """``rows`` with the failed ones replaced by what ``step`` makes of them; rows it doesn't give stay failed."""
    again = step(rows.where(F.col(status) == failed)).select(*rows.columns)
    return rows.join(again.select(key), key, "left_anti").unionByName(again)
