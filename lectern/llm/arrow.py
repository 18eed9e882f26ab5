"""Walking Arrow batches of documents in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text handled at a time; bounds the memory of a Python worker, not the results.
SLICE_ROWS, SLICE_BYTES = 2_000, 8_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice has few rows and, unless one row is longer, few bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (size + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(text), "").to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined until they have at least ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def blocks(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, joined while they have at most ``most`` bytes of text and cut where one has more."""
    held, size = [], 0
    for b in batches:
        n = pc.sum(pc.binary_length(b.column(text))).as_py() or 0
        if held and size + n > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        if n > most:
            yield from slices(iter([b]), text, most, b.num_rows)
        else:
            held.append(b)
            size += n
    if held:
        yield pa.concat_batches(held)


def filled(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The texts as an array, null as empty."""
    return pc.fill_null(batch.column(text), "")


def gap_parts(bodies: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts between spaces of all texts, the number among them of every part in order, and where each text's parts start and end."""
    parts = pc.split_pattern(bodies, " ")
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).copy()
    return coded.dictionary.to_pylist(), codes, np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)])


class Ragged:
    """Byte strings laid end to end, from which many are gathered at once."""

    def __init__(self, items: list[bytes], unit: np.dtype):
        self.flat = np.frombuffer(b"".join(items), unit)
        size = np.fromiter(map(len, items), np.int64, len(items)) // np.dtype(unit).itemsize
        self.size, self.start = size, np.cumsum(size) - size

    def of(self, at: np.ndarray) -> np.ndarray:
        """The items ``at`` these numbers, joined."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(total)]
