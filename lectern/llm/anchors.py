"""Where long passages recur, by anchors: the candidate search of both substring operators.

A document is a sequence of symbols (bytes, or hashes of words). Of every window of ``length``
symbols the ``gram`` neighbours with the least hash, the leftmost of equals, are the anchor; equal
windows have equal anchors at equal places, and a few hundredths of all positions are anchors.
A row stands for one anchor and the windows it anchors, which follow one another; its class is the hash of all
symbols those windows cover.

Rows meet by anchor. Of rows of one class all windows are equal, so all but the earliest are settled
at once, within a task before anything is moved and then over all tasks. Only an anchor with
different classes leaves a question, which of the windows in them are equal; these few
references go to the operator's own method, a class once. An anchor with very many classes is split by blocks of
window places and the symbols all windows of a block have in common, which keeps equal windows together and
bounds a group by what really is alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lectern.llm.arrow import gathered, slices
from lectern.llm.common import small_enough, written
from lectern.llm.wordhash import POWERS, mix
from lectern.llm.worker import map_arrow

#: Symbols and bytes handled at a time; low bits of a key that hold a place; classes of an anchor that is not split.
SEGMENT, SCAN_BYTES, PLACE_BITS, MANY = 2_000_000, 1_500_000, 24, 20_000
#: Window places of a block of a split anchor; rows gathered of sorted batches.
BLOCK, GATHER = 8, 200_000
PLACES = np.uint64((1 << PLACE_BITS) - 1)
#: Longest window: a place's fields hold it, and sums of powers tell so many symbols apart, whatever their order.
LONGEST = 500


@dataclass(frozen=True)
class Windows:
    """``length`` symbols a window, ``gram`` an anchor; ``within``: a window recurs by an earlier start in its own document too;
    ``many``: classes of an anchor that is not split; ``traced``: settled ranges tell which document has them earlier."""

    length: int
    gram: int
    within: bool
    many: int = MANY
    traced: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length <= LONGEST:
            raise ValueError(f"a window has from {self.gram} to {LONGEST} symbols, not {self.length}")

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


def scan(symbols: np.ndarray, lens: np.ndarray, spec: Windows) -> tuple[np.ndarray, ...]:
    """(anchor hash, class hash, document number, first window, anchor, last window) of documents laid end to end."""
    n, none = len(symbols), np.zeros(0, np.int64)
    if n < spec.length or not (lens >= spec.length).any():
        return (none.view(np.uint64), none.view(np.uint64), none, none, none, none)
    up, down = POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=sums[1:])
    grams = mix((sums[spec.gram :] - sums[: -spec.gram]) * down[: n - spec.gram + 1])
    least = (grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= spec.span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < spec.span:
        least = np.minimum(least[: size - spec.span], least[spec.span - size :])
    count = np.maximum(lens - spec.length + 1, 0)
    begin = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + begin[doc]
    anchor = (least[start] & PLACES).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    first, last = start[run], start[np.append(run[1:], len(start)) - 1]
    doc, anchor = doc[run], anchor[run]
    end = last + spec.length
    kind = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    off = begin[doc]
    return grams[anchor], kind, doc, first - off, anchor - off, last - off


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges, those of a document that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) << 40
    reach = np.maximum.accumulate(end + number)
    new = np.ones(len(doc), bool)
    new[1:] = (start + number)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - number)[np.append(first[1:], len(doc)) - 1]


def _pack(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    return anchor << 20 | (anchor - first) << 10 | (anchor - last)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = at >> 20
    return anchor - (at >> 10 & 1023), anchor, anchor - (at & 1023)


def settled(key: np.ndarray, kind: np.ndarray, doc: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: where the first of each row's class is, and which have an earlier equal and so are settled."""
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(key) else np.zeros(0, np.int64)
    return lead, ~first if within else doc > doc[lead]


def merged_by(parts: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges, those that agree in all of ``parts`` and overlap or touch made one; with the parts."""
    if not len(start):
        return (*parts, start, end)
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(order), bool)
    for x in parts:
        new[1:] |= x[order][1:] != x[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    found, start, end = merged(group, start, end)
    some = order[np.concatenate([[0], np.flatnonzero(new)])]
    return (*(x[some][found] for x in parts), start, end)


def anchor_rows(docs: DataFrame, symbols: Callable, spec: Windows) -> DataFrame:
    """(key, kind, doc, at) of every anchor that its task can't settle; a negative ``at`` marks a settled range of doc."""

    names = ["key", "kind", "doc", "at"] + ["src", "shift"] * spec.traced

    def rows(ids: list[int], found: list[np.ndarray], base: list[int]) -> pa.RecordBatch:
        key, kind, d, first, anchor, last = scan(np.concatenate(found), np.array([len(x) for x in found]), spec)
        ids, base = np.array(ids, np.int64), np.array(base, np.int64)
        doc, at = ids[d], _pack(first + base[d], anchor + base[d], last + base[d])
        key, kind = key.view(np.int64), kind.view(np.int64)
        order = np.lexsort((at, doc, kind, key))
        key, kind, doc, at = key[order], kind[order], doc[order], at[order]
        lead, gone = settled(key, kind, doc, spec.within)
        first, _, last = _unpack(at)
        if spec.traced:
            whose = [doc[gone], doc[lead[gone]], first[gone] - first[lead[gone]]]
            g_doc, src, shift, g_start, g_end = merged_by(whose, first[gone], last[gone] + spec.length)
        else:
            g_doc, g_start, g_end = merged(doc[gone], first[gone], last[gone] + spec.length)
        stay = ~gone
        parts = [
            np.concatenate([key[stay], mix((g_doc + g_start).view(np.uint64)).view(np.int64)]),
            np.concatenate([kind[stay], g_start]), np.concatenate([doc[stay], g_doc]), np.concatenate([at[stay], -1 - g_end]),
        ]
        if spec.traced:
            parts += [np.concatenate([np.zeros(stay.sum(), np.int64), x]) for x in (src, shift)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SCAN_BYTES):
            ids, found, base, size = [], [], [], 0
            for i, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = symbols(t)
                for k in range(0, max(1, len(own) - spec.length + 1), SEGMENT):
                    part = own[k : k + SEGMENT + spec.length - 1]
                    if size and size + len(part) > 2 * SEGMENT:
                        yield rows(ids, found, base)
                        ids, found, base, size = [], [], [], 0
                    ids.append(i)
                    found.append(part)
                    base.append(k)
                    size += len(part)
            if ids:
                yield rows(ids, found, base)

    return map_arrow(docs, run, ", ".join(f"{n} long" for n in names))


def references(rows: DataFrame, spec: Windows, partitions: int | None = None) -> DataFrame:
    """(doc, start, end, key, anchor, how): settled ranges (how 0) and references to classes left open (1; 2: of a split anchor).

    Of a settled range that is traced, ``key`` is the document that has it earlier and ``anchor`` how much further on it is here.
    """

    def flush(out: list, how: int, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        first, anchor, last = _unpack(at)
        out.append((doc, first, last + spec.length, key, anchor, np.full(len(doc), how)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Held of the last, perhaps unfinished anchor: a row for each of its classes (more of one class
        # within a document, where those count). ``split`` is the anchor already found to have too many.
        held = [np.zeros(0, np.int64)] * 4
        split = None
        for b in gathered(batches, GATHER):
            key, kind, doc, at = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("key", "kind", "doc", "at"), strict=True))
            out: list[tuple[np.ndarray, ...]] = []
            local = at < 0
            if local.any():
                none = np.zeros(local.sum(), np.int64)
                trace = [np.concatenate([np.zeros(len(held[0]), np.int64), b.column(c).to_numpy()])[local] for c in ("src", "shift")] if spec.traced else [none, none]
                out.append((doc[local], kind[local], -1 - at[local], *trace, none))
                key, kind, doc, at = key[~local], kind[~local], doc[~local], at[~local]
            lead, gone = settled(key, kind, doc, spec.within)
            first, _, last = _unpack(at)
            trace = (doc[lead[gone]], first[gone] - first[lead[gone]]) if spec.traced else (key[gone], key[gone])
            out.append((doc[gone], first[gone], last[gone] + spec.length, *trace, np.zeros(gone.sum(), np.int64)))
            key, kind, doc, at = key[~gone], kind[~gone], doc[~gone], at[~gone]
            held = [np.zeros(0, np.int64)] * 4
            if len(key):
                tail = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
                held = [x[tail:] for x in (key, kind, doc, at)]
                if tail:
                    emit(out, key[:tail], kind[:tail], doc[:tail], at[:tail], split)
                if split is not None and split != int(held[0][0]):
                    split = None
                if len(held[0]) > spec.many:
                    split = int(held[0][0])
                    # The last class stays: more of it may come.
                    keep = int(np.flatnonzero(np.append(True, held[1][1:] != held[1][:-1]))[-1])
                    flush(out, 2, *(x[:keep] for x in (held[0], held[2], held[3])))
                    held = [x[keep:] for x in held]
            if out:
                yield table(out)
        if len(held[0]):
            out = []
            emit(out, *held, split)
            yield table(out)

    def emit(out: list, key: np.ndarray, kind: np.ndarray, doc: np.ndarray, at: np.ndarray, split: int | None) -> None:
        """References of whole anchors: those with more than one class."""
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        varied = np.zeros(len(begin), bool)
        np.logical_or.at(varied, group[1:], (kind[1:] != kind[:-1]) & ~new[1:])
        large = size > spec.many
        if split is not None:
            large |= key[begin] == split
        for how, own in ((1, varied & ~large), (2, large)):
            mine = own[group]
            flush(out, how, key[mine], doc[mine], at[mine])

    def table(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["doc", "start", "end", "key", "anchor", "how"])

    dealt = rows.repartition(partitions, "key") if partitions else rows.repartition("key")
    return map_arrow(dealt.sortWithinPartitions("key", "kind", "doc", "at"), run, "doc long, start long, end long, key long, anchor long, how long")


def parts(start: int, end: int, anchor: int, key: int, how: int, symbols: np.ndarray, spec: Windows) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the parts of a reference by which it meets others: itself, or a part for each block of window places."""
    if how != 2:
        yield key, start, end
        return
    last = end - spec.length
    for k in range((anchor - last) // BLOCK, (anchor - start) // BLOCK + 1):
        low, high = anchor - k * BLOCK - BLOCK + 1, anchor - k * BLOCK
        # What all windows of the block have in common lies in each of them, so every reference can tell it.
        common = pack("<qq", key, k) + symbols[high : low + spec.length].tobytes()
        yield xxh3_64_intdigest(common) - (1 << 63), max(low, start), min(high, last) + spec.length


def snippets(open_: DataFrame, symbols: Callable, spec: Windows, cut: Callable, kind: str) -> DataFrame:
    """(key, doc, start, how, snippet) of the parts of all references of open_(doc, text, refs), dealt out and sorted by key.

    ``cut`` gives the snippet between two places of what ``symbols`` and the text say.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SCAN_BYTES):
            out: list[tuple] = []
            for doc, text, refs in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("refs").to_pylist(), strict=True):
                own = None
                give = cut(text)
                for r in refs:
                    if r["how"] == 2 and own is None:
                        own = symbols(text)
                    for key, start, end in parts(r["start"], r["end"], r["anchor"], r["key"], r["how"], own, spec):
                        out.append((key, doc, start, r["how"], give(start, end)))
            if out:
                *numbers, snippet = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(snippet)], ["key", "doc", "start", "how", "snippet"])

    found = map_arrow(open_, run, f"key long, doc long, start long, how long, snippet {kind}")
    return found.repartition("key").sortWithinPartitions("key", "doc", "start")


#: Windows of a source that one key stands for; symbols of passages of one key before it is dealt to more tasks.
SOURCE, SALTED = 8_000, 400_000


def passages(found: DataFrame, spec: Windows) -> DataFrame:
    """(doc, start, end, key, anchor, how): traced ranges made whole (how 3), and their sources (how 4), by key.

    What a document shares with one source at one distance is one passage, cut where blocks of the source's windows end.
    A key is a source's block; of those with many passages a document's goes to one of several tasks, each of which gets the source.
    """
    gone = found.where("how = 0").groupBy("doc").agg(F.collect_list(F.struct(F.col("key").alias("src"), F.col("anchor").alias("shift"), "start", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = np.repeat(b.column("doc").to_numpy(), pc.list_value_length(b.column("ranges")).to_numpy(zero_copy_only=False))
            flat = b.column("ranges").flatten()
            src, shift, start, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            doc, src, shift, start, end = merged_by([doc, src, shift], start, end)
            low, high = (start - shift) // SOURCE, (end - shift - spec.length) // SOURCE
            n = high - low + 1
            at = np.repeat(np.arange(len(doc)), n)
            block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
            move = shift[at]
            first = np.maximum(start[at], block * SOURCE + move)
            last = np.minimum(end[at] - spec.length, block * SOURCE + SOURCE - 1 + move)
            columns = (doc[at], first, last + spec.length, src[at], move, block)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "start", "end", "src", "shift", "block"])

    own = written(map_arrow(gone, run, "doc long, start long, end long, src long, shift long, block long"))
    place = own.groupBy("src", "block").agg((F.floor(F.sum(F.col("end") - F.col("start")) / SALTED) + 1).alias("salts"), F.min(F.col("start") - F.col("shift")).alias("start"), F.max(F.col("end") - F.col("shift")).alias("end"))
    name = lambda salt: F.xxhash64("src", "block", salt)
    hot = written(place.where("salts > 1").select("src", "block", "salts"))
    dealt = own.join(F.broadcast(hot) if small_enough(hot) else hot.hint("merge"), ["src", "block"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("salts")), F.lit(0)))
    mine = dealt.select("doc", "start", "end", name(F.col("salt")).alias("key"), F.lit(3).cast("long").alias("how"))
    # All that lies between the outermost windows that passages have of a block; it has no window that isn't the source's.
    theirs = place.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(F.col("src").alias("doc"), "start", "end", name(F.col("salt")).alias("key"), F.lit(4).cast("long").alias("how"))
    return mine.unionByName(theirs).select("doc", "start", "end", "key", F.lit(0).cast("long").alias("anchor"), "how")


def removed_ranges(own: DataFrame, symbols: Callable, spec: Windows, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, ranges) of all symbols to remove from own(doc, text); documents without any are missing.

    ``resolve`` gets (doc, text, refs) of references left open, and of traced passages, and gives (doc, start, end).
    """
    own = own.select("doc", "text")
    found = written(references(anchor_rows(own, symbols, spec), spec))
    refs = found.where("how > 0")
    if spec.traced:
        refs = refs.unionByName(passages(found, spec))
    refs = refs.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "key", "anchor", "how")).alias("refs"))
    gone = resolve(refs.join(own.hint("merge"), "doc"))
    if not spec.traced:
        gone = found.where("how = 0").select("doc", "start", "end").unionByName(gone)
    return gone.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def range_arrays(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the merged ranges of each row; a null list has none."""
    column = b.column("ranges")
    flat = column.flatten()
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    doc, start, end = merged(np.repeat(np.arange(len(counts)), counts), start, end)
    at = np.searchsorted(doc, np.arange(len(counts) + 1))
    return [(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]) for i in range(len(counts))]
