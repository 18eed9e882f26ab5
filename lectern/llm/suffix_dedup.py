"""Exact substring duplicates: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document of
smaller doc_id, or earlier in the same one); strings are judged on the input. ``anchors`` brings
together what may be equal; what it leaves open, snippets of text that share an anchor, is
laid end to end in shards. Of a shard only strings whose hash recurs there stay, as others have no equal; the
suffixes of what stays are sorted. In the order of suffixes, the intervals
of common prefixes of l + 1 bytes come from those of l bytes by extending backward over the transform:
two neighbours share l + 1 bytes if the same byte precedes two suffixes of one interval of
l. So common-prefix values are found breadth first, by increasing value; a place whose value is
found takes no further part, and the expansion stops at ``length``. What then still hangs together are the
sets of suffixes that share a string of ``length`` bytes; all but the earliest of each go.

Edge cases: null counts as empty; texts shorter than ``length`` stay whole; rows that share a doc_id
(or have none, which comes first) are documents of their own, in the order of the hashes of their texts; other
columns are ignored; empty tables give no rows; a ``length`` over 500 is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.anchors import MANY, Windows, merged, range_arrays, removed_ranges, snippets
from lectern.llm.arrow import gathered, slices
from lectern.llm.common import identified
from lectern.llm.wordhash import BYTE, POWERS, mix
from lectern.llm.worker import map_arrow

#: Bytes of an anchor; bytes of a shard, exceeded only by snippets of one anchor.
GRAM, SHARD = 32, 500_000


def byte_symbols(text: str) -> np.ndarray:
    return BYTE[np.frombuffer(text.encode(), np.uint8)]


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by at least their first ``depth`` symbols, and the place of each in it."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    size = 8
    while True:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if size >= depth or rank[order[-1]] == n - 1:
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            return order, place
        after = np.concatenate([rank[size:] + 1, np.zeros(min(size, n), np.int64)])[:n]
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        size *= 2


def long_intervals(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and at which of its places a new interval of common prefixes of ``length`` begins."""
    order, place = suffix_order(data, length)
    n = len(data)
    # extension[k]: where the suffix that follows the first byte of the k-th stands; backward
    # extension by that byte leads from there to k. The end of the data extends to no interval.
    extension = np.append(place, n)[order + 1]
    begins = np.ones(n + 1, bool)
    begins[1:n] = data[order[1:]] != data[order[:-1]]
    open_ = np.flatnonzero(~begins)
    for _ in range(length - 1):
        interval = np.cumsum(begins)
        parted = interval[extension[open_]] != interval[extension[open_ - 1]]
        if parted.any():
            begins[open_[parted]] = True
            open_ = open_[~parted]
        if not len(open_):
            break
    return order, begins[:n]


def laid_out(rows: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """The snippets end to end, where each begins, and by snippet the number and the place of each window; the zero between snippets is in none."""
    size = np.array([len(x[2]) + 1 for x in rows])
    data = np.frombuffer(b"\x00".join(x[2] for x in rows) + b"\x00", np.uint8).copy()
    begin = np.cumsum(size) - size
    windows = np.maximum(size - length, 0)
    row = np.repeat(np.arange(len(rows)), windows)
    return data, begin, row, np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[row]


def recurring(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, bytes]]:
    """The parts of the snippets (doc, start, bytes) that have all strings of ``length`` bytes with an equal there; equal ones have one hash."""
    if not rows:
        return rows
    data, begin, row, at = laid_out(rows, length)
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[at + length] - sums[at]) * down[at])
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    stay = np.flatnonzero(twice)
    if not len(stay):
        return []
    new = np.append(True, (np.diff(stay) > 1) | (np.diff(row[stay]) > 0))
    first, last = stay[new], stay[np.append(new[1:], True)]
    off = at - begin[row]
    return [(rows[r][0], rows[r][1] + a, rows[r][2][a : b + length]) for r, a, b in zip(row[first].tolist(), off[first].tolist(), off[last].tolist(), strict=True)]


def later_equals(rows: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every string of ``length`` bytes in the snippets (doc, start, bytes) that has an earlier equal there."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, begin, row, at = laid_out(rows, length)
    order, begins = long_intervals(data, length)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(begins)
    g = group[at]
    doc, start = np.array([x[0] for x in rows])[row], np.array([x[1] for x in rows])[row] + at - begin[row]
    by = np.lexsort((start, doc, g))
    same = np.zeros(len(by), bool)
    same[1:] = g[by][1:] == g[by][:-1]
    # One window may be there twice, in snippets that overlap: then neither is earlier.
    first = np.maximum.accumulate(np.where(~same, np.arange(len(by)), 0))
    gone = by[same & ((doc[by] != doc[by][first]) | (start[by] != start[by][first]))]
    return doc[gone], start[gone]


def resolver(spec: Windows):
    def cut(text: str):
        raw = text.encode()
        return lambda start, end: raw[start:end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            doc, start = later_equals(recurring(shard, spec.length), spec.length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(doc, start, start + spec.length)], ["doc", "start", "end"])

        for b in gathered(batches, 20_000):
            for key, doc, start, snippet in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "start", "snippet")), strict=True):
                if size >= SHARD and key != last:
                    yield solved()
                    shard, size = [], 0
                if len(snippet) >= spec.length:
                    shard.append((doc, start, snippet))
                    size += len(snippet)
                last = key
        if shard:
            yield solved()

    def resolve(open_: DataFrame) -> DataFrame:
        found = snippets(open_, byte_symbols, spec, cut, "binary")
        return map_arrow(found, run, "doc long, start long, end long")

    return resolve


def substring_free(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True, many: int = MANY, carried: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    With ``keep_text`` kept_text, without characters that lost a byte; with ``carried`` a struct of those columns.
    """
    spec = Windows(length, min(GRAM, length), within=True, many=many)
    own, _ = identified(docs, text, doc_id, carried)
    ranges = removed_ranges(own, byte_symbols, spec, resolver(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t, (start, end) in zip(b.column("text").to_pylist(), range_arrays(b), strict=True):
                raw = t.encode()
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                rest = b"".join(kept)
                row = (len(raw), len(raw) - len(rest), len(start), sha256(rest).hexdigest())
                rows.append((*row, b"".join(k.decode(errors="ignore").encode() for k in kept).decode()) if keep_text else row)
            columns = [b.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns + ([b.column("carried")] if carried else []), names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text + ["carried"] * bool(carried)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    if carried:
        schema = StructType(StructType.fromDDL(schema).fields + [own.schema["carried"]])
    return map_arrow(own.hint("merge").join(ranges, "doc", "left"), run, schema)
