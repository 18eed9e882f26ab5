"""Token counts of a sentencepiece BPE model by rank-synchronous merging of numpy arrays.

A text is cut before each run of word marks (a piece never has a mark after another
character, or the text stays whole). The distinct pre-tokens of a slice are held as
ragged arrays, one rectangle per length: in each round every sequence applies its
best-scored pair, the leftmost of equals, all sequences at once, so that each rectangle loses one
column a round. Sequences without a pair left leave; their surviving symbols are counted.
Characters no piece has count as their UTF-8 bytes, as byte fallback does. Counts of
pre-tokens are kept in a bounded table per worker.

Edge cases: null and empty texts have no tokens; a text of white space has the tokens of its marks;
sequences longer than ``LONG`` symbols (one pre-token of thousands of characters) are merged with a
heap instead, with the same order; repeated rows count each; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import blocks, filled, gap_parts
from lectern.llm.worker import Remembered, kept, map_arrow

MARK = "▁"
#: Symbols from which a sequence is merged alone; elements of a rectangle.
LONG, RECTANGLE = 400, 1_000_000
NONE = np.int64(1) << 40
#: Bytes of text whose distinct words are merged together; gaps that are not single, or at the start, and marks.
BLOCK_BYTES, ODD_GAP = 24_000_000, f"^$|^ |  |{MARK}"


class PieceCounter:
    """Counts the tokens that ``model_file`` gives a text."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): i for i in normal}
        scores = {i: model.get_score(i) for i in normal}
        self.fallback = any(model.is_byte(i) for i in range(n))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.chars = {c: i for c, i in symbols.items() if len(c) == 1}
        self.width = max(symbols.values()) + 6  # the last five: unknown characters of 1 to 4 bytes
        self.cost = np.ones(self.width, np.int64)
        for c, i in self.chars.items():
            if i >= n:
                self.cost[i] = len(c.encode()) if self.fallback else 1
        for k in range(1, 5):
            self.cost[self.width - 6 + k] = k if self.fallback else 1
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    pairs[a * self.width + b] = (order[scores[i]], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.memory = Remembered()

    def _symbols(self, word: str) -> list[int]:
        last = self.width - 6
        return [self.chars.get(c) or last + len(c.encode()) for c in word]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _rectangle(self, sym: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        """Merges all rows of ``sym`` in step; writes each row's count to ``out``."""
        rank, new = self._look_up(sym[:, :-1], sym[:, 1:])
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(sym), np.int64)
            live = rank[np.arange(len(sym)), best] < NONE if rank.shape[1] else np.zeros(len(sym), bool)
            if not live.all():
                out[rows[~live]] = self.cost[sym[~live]].sum(axis=1)
                sym, rank, new, best, rows = sym[live], rank[live], new[live], best[live], rows[live]
            if not len(sym):
                return
            at, width = np.arange(len(sym)), sym.shape[1]
            sym[at, best] = new[at, best]
            keep = np.ones(sym.shape, bool)
            keep[at, best + 1] = False
            sym = sym[keep].reshape(len(sym), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[at, best] = False
            rank, new = rank[keep].reshape(len(sym), width - 2), new[keep].reshape(len(sym), width - 2)
            for where, left in ((best > 0, best - 1), (best < width - 2, best)):
                i, j = at[where], left[where]
                rank[i, j], new[i, j] = self._look_up(sym[i, j], sym[i, j + 1])

    def _alone(self, sym: list[int]) -> int:
        """One long sequence: the same order, by a heap of pairs."""
        n = len(sym)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := self.pairs.get(sym[i] * self.width + sym[after[i]])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[after[i]], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return int(sum(self.cost[s] for s in sym if s >= 0))

    def count_words(self, words: list[str]) -> list[int]:
        """The counts of pre-tokens."""
        out = np.zeros(len(words), np.int64)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, own in by_length.items():
            if n == 0:
                continue
            if n > LONG:
                for i in own:
                    out[i] = self._alone(self._symbols(words[i]))
                continue
            step = max(1, RECTANGLE // n)
            for k in range(0, len(own), step):
                rows = np.array(own[k : k + step])
                self._rectangle(np.array([self._symbols(words[i]) for i in own[k : k + step]], np.int64), out, rows)
        return out.tolist()

    def count(self, bodies: pa.Array) -> np.ndarray:
        """The counts of whole texts."""
        # Between single gaps a word stands for itself and the mark before it.
        odd = pc.match_substring_regex(bodies, ODD_GAP).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(bodies), bool)
        parts, codes, edges = gap_parts(bodies.filter(pa.array(~odd)))
        words = [MARK + w for w in parts]
        marked = [(MARK + t).replace(" ", MARK) if t else "" for t in bodies.filter(pa.array(odd)).to_pylist()]
        cut = [re.findall(f"{MARK}+[^{MARK}]*", t) if self.splits else [t] * bool(t) for t in marked]
        words += (more := list(set().union(*cut) - set(words)))
        times = np.bincount(codes, minlength=len(words))
        times[len(words) - len(more) :] = 2
        n = np.array(self.memory.look_up(words, times, self.count_words), np.int64)
        sums = np.concatenate([[0], np.cumsum(n[codes])])
        out = np.zeros(len(bodies), np.int64)
        out[~odd] = sums[edges[1:]] - sums[edges[:-1]]
        known = dict(zip(words, n.tolist(), strict=True)) if cut else {}
        out[odd] = [sum(known[w] for w in x) for x in cut]
        return out


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(PieceCounter, model_file)
        for b in blocks(batches, BLOCK_BYTES):
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            n = pa.array(own.count(filled(b)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(own, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keeps=True)
