"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document costs ``linear`` times its tokens plus ``quadratic`` times their square, as attention within
it does. Documents longer than a sequence give whole sequences first. What is left is packed block by
block: as many sequences are open as the block fills, and documents in descending length go to the
open sequence of least cost that has room; one that fits nowhere whole is cut into the least
costly room. What exceeds the block's whole sequences waits for the next block; at a partition's end the
last tokens go to sequences of lengths that are powers of two, which need no padding. So no
sequence is padded, whatever the input.

Blocks follow the rows of a partition, nothing is shuffled, and a task that is run again gives the
same rows; ``sequence_id`` holds the partition's number above a running number.

Edge cases: null and empty texts have the end token alone; a document of very many tokens gives many
sequences; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from struct import pack
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import Ragged, blocks, filled, gap_parts
from lectern.llm.worker import Remembered, kept, map_arrow

#: Tokens of short documents packed together.
BLOCK_TOKENS = 4_000_000
#: Bytes of text whose distinct words are encoded together.
BLOCK_BYTES = 24_000_000
#: Texts that are not cut at spaces: with what may be a special string, or with combining characters after a space.
ODD = r"<\|| [\p{M}]|[\x1c-\x1f]"
#: Marks between new words, the first that does is used; marks that end words; words encoded in one text.
MARKS, ENDS, TOGETHER = ("|", "~", "^", "="), ".,;:!?()#%$&*", 500


class WordTokenizer:
    """A tokenizers model that drops white space, run once for each distinct word.

    New words are encoded many in one text, parted by a mark that always is one id of its own.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.memory = Remembered()
        self.mark, self.mark_id = None, -1
        for mark in MARKS:
            ids = self._ids(f"a {mark} b {mark} .")
            own = self._ids(mark)
            if len(own) == 1 and ids == self._ids("a") + own + self._ids("b") + own + self._ids("."):
                self.mark, self.mark_id = mark, own[0]
                break
        # Whether a letter or digit and a mark after it are never in one token.
        self.parts_ends = all(self._ids(x + e) == self._ids(x) + self._ids(e) for x in ("ab", "7", "é") for e in (*ENDS, "..", "),"))

        self.lowers = self._ids("ABCXYZ Qu") == self._ids("abcxyz qu")

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _encode(self, bodies: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(bodies, add_special_tokens=False)
        return [pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in found)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        if self.mark is None:
            return self._encode(words)
        out: list[bytes] = []
        for k in range(0, len(words), TOGETHER):
            own = words[k : k + TOGETHER]
            [found] = self.model.encode_batch_fast([f" {self.mark} ".join(own)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            if len(ends) != len(own) - 1:  # a word has the mark's id
                out += self._encode(own)
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)]
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word, marks at its end apart from what is before them."""
        if not self.parts_ends:
            return self._encode_words(words)
        cores = [w.rstrip(ENDS) for w in words]
        cores = [c if c and c[-1].isalnum() else w for c, w in zip(cores, words, strict=True)]
        if self.lowers:
            cores = [c.lower() if c.isascii() else c for c in cores]
        tails = [w[len(c) :] for c, w in zip(cores, words, strict=True)]  # lower case changes no length here
        found = {w: self.memory.known.get(w) for w in {*cores, *tails}}
        single = [w for w, ids in found.items() if ids is None]
        found.update(zip(single, self._encode_words(single), strict=True))
        return [found[c] + found[t] if t else found[c] for c, t in zip(cores, tails, strict=True)]

    def encode(self, bodies: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        odd = pc.match_substring_regex(bodies, ODD).to_numpy(zero_copy_only=False)
        parts, codes, edges = gap_parts(pc.replace_substring(bodies.filter(pa.array(~odd)), "\n", " "))
        table, regular = Ragged(self.memory.look_up(parts, np.bincount(codes, minlength=len(parts)), self._learn), np.dtype("<u4")), 0
        for i, whole in enumerate(odd.tolist()):
            if whole:
                yield np.array(self._ids(bodies[i].as_py()), "<u4")
            else:
                yield table.of(codes[edges[regular] : edges[regular + 1]])
                regular += 1


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Fills floor(sum / capacity) sequences: pieces (item, start, length, sequence), and what is left (item, start)."""
    rooms = sum(lengths) // capacity
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room, cost = np.full(rooms, capacity, np.int64), np.zeros(rooms)
    pieces, left = [], []
    for i in order:
        n, start = lengths[i], 0
        while n:
            k = int(np.where(room >= n, cost, np.inf).argmin()) if rooms else -1
            if k < 0 or room[k] < n:  # nowhere whole: into the cheapest room there is
                k = int(np.where(room > 0, cost, np.inf).argmin()) if rooms else -1
                if k < 0 or room[k] <= 0:
                    left.append((i, start))
                    break
            took = min(n, int(room[k]))
            pieces.append((i, start, took, k))
            room[k] -= took
            cost[k] += linear * took + quadratic * took * took
            n, start = n - took, start + took
    return pieces, left


class Packer:
    """Collects documents and gives pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first_id: int):
        self.capacity, self.linear, self.quadratic, self.next_id = capacity, linear, quadratic, first_id
        self.waiting: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids, start, doc_tokens
        self.tokens = 0

    def _piece(self, doc: tuple, start: int, length: int, sequence: int, offset: int) -> tuple:
        doc_id, ids, base, total = doc
        return doc_id, base + start, length, crc32(ids[start : start + length].tobytes()), total, sequence, offset

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        doc = (doc_id, ids, 0, total)
        whole = total - total % self.capacity
        for s in range(0, whole, self.capacity):
            yield self._piece(doc, s, self.capacity, self.next_id, 0)
            self.next_id += 1
        if total > whole:
            self.waiting.append((doc_id, ids[whole:].copy(), whole, total))
            self.tokens += total - whole
        if self.tokens >= BLOCK_TOKENS:
            yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[tuple]:
        docs = self.waiting
        pieces, left = assign([len(d[1]) for d in docs], self.capacity, self.linear, self.quadratic)
        filled: dict[int, int] = {}
        for i, start, n, k in pieces:
            yield self._piece(docs[i], start, n, self.next_id + k, filled.get(k, 0))
            filled[k] = filled.get(k, 0) + n
        self.next_id += len(filled)
        self.waiting = [(docs[i][0], docs[i][1][s:], docs[i][2] + s, docs[i][3]) for i, s in left]
        self.tokens = sum(len(d[1]) for d in self.waiting)
        if last:
            yield from self._tail()

    def _tail(self) -> Iterator[tuple]:
        """The last tokens, fewer than a sequence holds, as sequences of powers of two, the longest first."""
        rest, i, start = self.tokens, 0, 0
        while rest:
            room = size = 1 << (rest.bit_length() - 1)
            while room:
                n = min(room, len(self.waiting[i][1]) - start)
                yield self._piece(self.waiting[i], start, n, self.next_id, size - room)
                room, start = room - n, start + n
                if start == len(self.waiting[i][1]):
                    i, start = i + 1, 0
            self.next_id += 1
            rest -= size
        self.waiting, self.tokens = [], 0


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(
    docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1.0 / 4096,
    text: str = "text", doc_id: str = "doc_id", make: Callable[[str], WordTokenizer] = WordTokenizer,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = pa.schema([(n, pa.int64()) for n in NAMES])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(make, tokenizer_file)
        packer = Packer(capacity, linear, quadratic, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4")
        for b in blocks(batches, BLOCK_BYTES):
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), own.encode(filled(b)), strict=True):
                rows += packer.add(d, np.concatenate([ids, end]))
            if rows:
                yield table(rows)
        if rows := list(packer.flush(last=True)):
            yield table(rows)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(own, run, ", ".join(f"{n} long" for n in NAMES), keeps=True)
