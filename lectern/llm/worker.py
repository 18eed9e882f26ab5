"""What a Python worker keeps between tasks: the tables of one operator, freed when a task of another begins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lectern.functions import shipping

#: Entries at which a worker's table of words, then some 80 MB, starts anew; bounds memory and saves time, not results.
REMEMBERED = 400_000

_kept: dict[tuple, Any] = {}


def _trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps the pages for later use
        pass


def kept(make: Callable, *args) -> Any:
    """``make(*args)``, kept until a task asks for something else."""
    key = (make, args)
    if key not in _kept:
        _kept.clear()
        _trim()
        _kept[key] = make(*args)
    return _kept[key]


class Remembered:
    """What is known of words, kept from block to block for those that a block has more than once."""

    def __init__(self) -> None:
        self.known: dict[str, Any] = {}

    def look_up(self, words: list[str], times: np.ndarray, learn: Callable[[list[str]], Iterable[Any]]) -> list[Any]:
        """What is known of each of ``words``, distinct and met ``times`` times; ``learn`` tells it of new ones."""
        known = self.known
        found = [known.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, learn([words[i] for i in new]), strict=True):
            found[i] = x
        again = np.flatnonzero(times > 1).tolist()
        if len(known) + len(again) > REMEMBERED:
            known = self.known = {}
        known.update((words[i], found[i]) for i in again)
        return found


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow``; unless it ``keeps`` tables, a task first frees those of other operators, and in the end what it took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps and _kept:
            _kept.clear()
            _trim()
        yield from run(batches)
        _trim()

    return shipping.map_arrow(df, task, schema)
