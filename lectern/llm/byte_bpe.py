"""Byte-level BPE encoding and decoding by replaying merges over all distinct pre-tokens at once.

The pre-tokens of a whole partition (of blocks of it, where it is large) that the worker does not remember
are laid out in one array of symbols; an inverted index leads from each mergeable pair (named by the rank of what it
makes) to the positions where it stands, and a heap gives the ranks in order. A merge visits just its
positions and looks anew at the two pairs beside each of them. A pair of lower rank that a
merge brings about comes first again in its own pre-token, as it would if the pre-token
were merged alone. The corpus is sharded by partition; nothing is sent between shards.

Edge cases: null counts as empty; an empty text has no ids (digest of the empty string);
special strings are ordinary text; very long pre-tokens take time in proportion to their length
(times its logarithm); repeated rows are encoded each; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import Ragged, blocks, filled, gap_parts
from lectern.llm.worker import Remembered, kept, map_arrow

#: Bytes of text whose pre-tokens are indexed together; bounds memory only.
BLOCK_BYTES = 24_000_000
#: Rows given at a time.
OUT_ROWS = 1_000
#: Places of a pair from which they are merged as arrays.
MANY = 32
#: Patterns by which a single gap between other characters starts a pre-token.
STARTS_AT_GAPS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: Gaps that are not single, or beside other white space or a control character, or at an end.
ODD_GAP = r"^ | $|^$|[\s\p{Z}\p{C}] | [\s\p{Z}\p{C}]"


class ByteBpe:
    """Encodes and decodes by the ranks in ``ranks_file``; ``pattern`` splits text before merging."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex

        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.cuts_at_gaps = pattern in STARTS_AT_GAPS
        self.vocab = {i: b for b, i in self.ranks.items()}
        size = self.size = max(self.vocab) + 1
        self.starts = np.zeros(size + 1, np.int64)
        self.starts[1:] = np.cumsum([len(self.vocab.get(i, b"")) for i in range(size)])
        self.flat = np.frombuffer(b"".join(self.vocab.get(i, b"") for i in range(size)), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.first = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        #: The rank that two neighbours make, by size * left + right.
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, made in self.ranks.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    self.pairs[a * size + b] = made
        key, made = np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int64)
        left, right, symbols = key // size, key % size, np.arange(size + 1)
        #: Of the pairs by left symbol, by right symbol and by what they make: the other column, what they make, where a symbol's begin.
        self.by_left, self.by_right, self.by_made = (
            (other[o], made[o], np.searchsorted(one[o], symbols)) for one, other in ((left, right), (right, left), (made, key)) for o in (np.lexsort((other, one)),)
        )
        self.memory = Remembered()
        self.decimal = [str(i) for i in range(size)]

    @staticmethod
    def _made(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], symbol: int, others: np.ndarray) -> np.ndarray:
        """What ``symbol`` makes with each of ``others``; -1 for nothing."""
        other, made, start = pairs
        a, b = start[symbol], start[symbol + 1]
        if a == b:
            return np.full(len(others), -1)
        at = np.minimum(np.searchsorted(other[a:b], others), b - a - 1)
        return np.where(other[a:b][at] == others, made[a:b][at], -1)

    def _merge_many(self, r: int, places: np.ndarray, sym: np.ndarray, after: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges at the first of ``places`` in each word; gives the ranks of new pairs, with r for places left over, and where they are."""
        n = len(sym)
        p = np.unique(places)
        p = p[after[p] < n]
        q = after[p]
        key, _, start = self.by_made
        own = sym[p].astype(np.int64) * self.size + sym[q]
        p = p[(own[:, None] == key[start[r] : start[r + 1]]).any(axis=1)]
        of = word[p]
        first = np.ones(len(p), bool)
        first[1:] = of[1:] != of[:-1]
        rest, p = p[~first], p[first]
        q = after[p]
        z = after[q]
        sym[p], sym[q], after[p] = r, -1, z
        inside = z < n
        before[z[inside]] = p[inside]
        y = before[p]
        y = y[y >= 0]
        ranks = np.concatenate([self._made(self.by_left, r, sym[z[inside]]), self._made(self.by_right, r, sym[y]), np.full(len(rest), r)])
        at = np.concatenate([p[inside], y, rest])
        return ranks[ranks >= 0], at[ranks >= 0]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, none of them empty, as little-endian unsigned 32-bit numbers."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        n = len(raw)
        ends = np.cumsum([len(w) for w in words])
        inner = np.ones(max(n - 1, 0), bool)
        inner[ends[:-1] - 1] = False  # no pair reaches over a word's end
        first = np.where(inner, self.first[raw[:-1] * 256 + raw[1:]], -1)
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        found, begin = np.unique(first[at], return_index=True)
        index = {r: array("i", x.astype(np.int32).tobytes()) for r, x in zip(found.tolist(), np.split(at, begin[1:]), strict=False)}
        queue = list(index)
        heapq.heapify(queue)
        sym = array("i", self.byte_ids[raw].tobytes())
        word = array("i", np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0)).tobytes())
        links = np.arange(-1, n, dtype=np.int32)
        links[ends[:-1]] = -1  # nothing before a word's first symbol
        before = array("i", links[:n].tobytes())
        links = np.arange(1, n + 1, dtype=np.int32)
        links[ends - 1] = n
        after = array("i", links.tobytes())
        views = tuple(np.frombuffer(x, np.int32) for x in (sym, after, before, word))
        size, made = self.size, self.pairs.get
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            r = pop(queue)
            places = index.pop(r)
            if len(places) >= MANY:
                ranks, at = self._merge_many(r, np.frombuffer(places, np.int32), *views)
                order = np.argsort(ranks, kind="stable")
                found, begin = np.unique(ranks[order], return_index=True)
                for new, x in zip(found.tolist(), np.split(at[order], begin[1:]), strict=False):
                    if new in index:
                        index[new].frombytes(x.tobytes())
                    else:
                        index[new] = array("i", x.tobytes())
                        push(queue, new)
                continue
            late: set[int] = set()  # words in which a lower rank has come up
            again = []
            for p in sorted(places) if len(places) > 1 else places:
                q = after[p]
                if q >= n or made(sym[p] * size + sym[q]) != r:  # a symbol that is gone, -1, has no pair
                    continue
                if late and word[p] in late:
                    again.append(p)
                    continue
                sym[p], sym[q] = r, -1
                after[p] = z = after[q]
                if z < n:
                    before[z] = p
                    new = made(r * size + sym[z])
                    if new is not None:
                        if new == r:
                            again.append(p)
                        elif new in index:
                            index[new].append(p)
                        else:
                            index[new] = array("i", (p,))
                            push(queue, new)
                        if new < r:
                            late.add(word[p])
                y = before[p]
                if y >= 0:
                    new = made(sym[y] * size + r)
                    if new is not None:
                        if new == r:
                            again.append(y)
                        elif new in index:
                            index[new].append(y)
                        else:
                            index[new] = array("i", (y,))
                            push(queue, new)
                        if new < r:
                            late.add(word[y])
            if again:
                index[r] = array("i", again)
                push(queue, r)
        left = np.frombuffer(sym, np.int32)
        stays = left >= 0
        flat = left[stays].astype("<u4").tobytes()
        upto = (np.cumsum(stays)[ends - 1] * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def _learn(self, chunks: list[str]) -> Iterator[bytes]:
        """The ids of chunks and of pre-tokens; a chunk is split by the pattern before its pre-tokens are merged."""
        split = {c: self.pattern.findall(c) for c in chunks if not (c.isalpha() or (c[:1] == " " and c[1:].isalpha()))} if self.cuts_at_gaps else {}
        words = list(set().union((c for c in chunks if c not in split), *split.values()))
        raw = [w.encode() for w in words]
        ids = {w: pack("<I", i) for w, b in zip(words, raw, strict=True) if (i := self.ranks.get(b)) is not None}
        rest = [k for k, w in enumerate(words) if w not in ids]
        if rest:
            ids.update(zip((words[k] for k in rest), self.replay([raw[k] for k in rest]), strict=True))
        get = ids.__getitem__
        return (b"".join(map(get, split[c])) if c in split else get(c) for c in chunks)

    def encode(self, bodies: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
        """For each text its ids, as decimals joined by commas and as an array."""
        # At a single gap between other characters such a pattern starts anew, gap included; other texts are split whole.
        odd = pc.match_substring_regex(bodies, ODD_GAP).to_numpy(zero_copy_only=False) if self.cuts_at_gaps else np.ones(len(bodies), bool)
        parts, codes, edges = gap_parts(bodies.filter(pa.array(~odd)))
        first: dict[str, int] = {}  # the first part of a text has no gap before it
        for k in edges[:-1].tolist():
            codes[k] = len(parts) + first.setdefault(parts[codes[k]], len(first))
        chunks = [" " + c for c in parts] + list(first)
        cut = {i: self.pattern.findall(bodies[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        more = list(set().union(*cut.values()) - set(chunks)) if cut else []
        number = {w: k for k, w in enumerate(chunks + more)} if cut else {}
        words = chunks + more
        times = np.bincount(codes, minlength=len(words))
        times[len(chunks) :] = 2
        table, regular = Ragged(self.memory.look_up(words, times, self._learn), np.dtype("<u4")), 0
        for i, whole in enumerate(odd.tolist()):
            if whole:
                own = np.array([number[w] for w in cut[i]], np.int64)
            else:
                own = codes[edges[regular] : edges[regular + 1]]
                regular += 1
            ids = table.of(own)
            yield ",".join(map(self.decimal.__getitem__, ids.tolist())), ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for."""
        if not len(ids):
            return b""
        begin = self.starts[ids]
        size = self.starts[ids.astype(np.int64) + 1] - begin
        to = np.cumsum(size)
        return self.flat[np.arange(to[-1]) + np.repeat(begin - to + size, size)].tobytes()


def encoded(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document, and with ``keep_ids`` the ids themselves."""
    kind = pa.list_(pa.int32())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(ByteBpe, ranks_file, pattern)
        for b in blocks(batches, BLOCK_BYTES):
            found = own.encode(filled(b))
            for k in range(0, b.num_rows, OUT_ROWS):
                rows = [(len(ids), sha256(s.encode()).hexdigest(), sha256(own.decode(ids)).hexdigest(), ids) for s, ids in islice(found, OUT_ROWS)]
                n, encoded_, decoded, ids = zip(*rows, strict=True)
                columns = [b.column("doc_id").slice(k, len(rows)), pa.array(n, pa.int64()), pa.array(encoded_), pa.array(decoded)]
                if keep_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in ids], kind))
                yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(own, run, schema, keeps=True)
