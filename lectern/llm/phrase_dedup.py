"""Repeated phrases: windows of words that an earlier document has too, found by sharded automata.

A word goes if a window of ``length`` consecutive words that covers it has a word sequence which also
starts in a document of smaller doc_id; windows are judged on the input. ``anchors`` finds recurring passages: what a
document seems to share with an earlier one goes to a shard of that source, and what only
shares an anchor to one of that anchor, so a shard gets all passages that may share a window. Each shard compiles the windows
of its sources into one Aho-Corasick automaton, a window's value being the smallest document that has it, and
streams its passages through it: every occurrence in a document larger than that value is marked. Nothing is removed but
by an occurrence, word by word, so no hash decides.

Edge cases: null texts have no words; texts of fewer than ``length`` words stay whole; repeats within one
document stay; rows that share a doc_id (or have none, which comes first) are documents of their own, in the order of the
hashes of their texts; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.anchors import MANY, Windows, merged, range_arrays, removed_ranges, snippets
from lectern.llm.arrow import gathered, slices
from lectern.llm.common import identified
from lectern.llm.wordhash import words_of
from lectern.llm.worker import map_arrow

#: Words of an anchor; words of a shard, exceeded only by passages of one anchor.
GRAM, SHARD = 6, 40_000


def word_symbols(text: str) -> np.ndarray:
    return words_of([text.encode()])[0]


class Letters(dict):
    """Distinct words as characters, one each, none of them a surrogate."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = letter = chr(n if n < 0xD800 else n + 0x800)
        return letter


def marked(sources: list[tuple[int, int, bytes]], rows: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every window in the passages ``rows``, (doc, first word, words), that has an occurrence in a smaller document of ``sources``."""
    import ahocorasick

    spell = Letters().__getitem__
    met: dict[int, str] = {}
    least: dict[str, int] = {}
    for row in sources:
        doc, _, body = row
        s = met[id(row)] = "".join(map(spell, body.split()))
        for window in (s[i : i + length] for i in range(len(s) - length + 1)):
            known = least.get(window)
            if known is None or doc < known:
                least[window] = doc
    if not least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for window, doc in least.items():
        automaton.add_word(window, doc)
    automaton.make_automaton()
    docs, starts = [], []
    for row in rows:
        doc, first, body = row
        s = met.get(id(row)) or "".join(map(spell, body.split()))
        hits = [end for end, smallest in automaton.iter(s) if smallest < doc]
        if hits:
            docs.append(np.full(len(hits), doc))
            starts.append(np.array(hits) + (first - length + 1))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(starts)


def resolver(spec: Windows):
    def cut(text: str):
        words = text.encode().split()  # at 0x09-0x0D and 0x20, as words are defined
        return lambda start, end: b" ".join(words[start:end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Passages of a source (how 3) need only the source's patterns (how 4), which come first; others compare with one another.
        sources: list[tuple[int, int, bytes]] = []
        shard: list[tuple[int, int, bytes]] = []
        size, last, begin = 0, None, 0

        def solved() -> pa.RecordBatch:
            doc, start = marked(sources, shard, spec.length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(doc, start, start + spec.length)], ["doc", "start", "end"])

        for b in gathered(batches, 5_000):
            for key, doc, start, how, snippet in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "start", "how", "snippet")), strict=True):
                if size >= SHARD and (key != last or how >= 3):
                    yield solved()
                    shard, size = [], 0
                    sources = sources[begin:] if key == last else []
                    begin = 0
                if key != last:
                    last, begin = key, len(sources)
                row = (doc, start, snippet)
                if how != 3:
                    sources.append(row)
                if how != 4:
                    shard.append(row)
                size += snippet.count(b" ") + 1
        if shard:
            yield solved()

    def resolve(open_: DataFrame) -> DataFrame:
        return map_arrow(snippets(open_, word_symbols, spec, cut, "binary"), run, "doc long, start long, end long")

    return resolve


def phrase_free(docs: DataFrame, length: int = 13, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True, many: int = MANY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and with ``keep_text`` kept_text, the words left joined by spaces."""
    spec = Windows(length, min(GRAM, length), within=False, many=many, traced=True)
    own, _ = identified(docs, text, doc_id)
    ranges = removed_ranges(own, word_symbols, spec, resolver(spec))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t, (start, end) in zip(b.column("text").to_pylist(), range_arrays(b), strict=True):
                words = t.encode().split()
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                rest = b" ".join(kept)
                row = (len(words), len(words) - len(kept), sha256(rest).hexdigest())
                rows.append((*row, rest.decode()) if keep_text else row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return map_arrow(own.hint("merge").join(ranges, "doc", "left"), run, schema)
