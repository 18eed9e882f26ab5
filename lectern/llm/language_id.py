"""Language identification by rank-order profiles of character n-grams.

A profile is the ``top`` most frequent n-grams of one to three characters, by descending count
(ties: smaller code first); white space, digits and marks act as one word boundary. Profiles of
languages are counted over all training texts; a text goes to the language whose profile is nearest
by the out-of-place distance: the sum over the text's n-grams of the difference of ranks, ``top`` for one
that the profile lacks. ``score`` is the nearness of the predicted language over the sum of
all, nearness being one less the distance over its greatest value.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing
could be learned; ties of distance go to the language that sorts first; rows with null lang teach
nothing; repeated rows count each; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import slices, texts
from lectern.llm.worker import map_arrow

EDGE, SHIFT = 1, 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(sys.maxunicode + 1)])


def grams(text: str) -> np.ndarray:
    """The n-grams of ``text`` as numbers, in no order; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[EDGE], np.where(letter, codes, EDGE), [EDGE]])
    edge = codes == EDGE
    codes = codes[~(edge & np.concatenate([[False], edge[:-1]]))]
    edge = codes == EDGE
    two = (codes[:-1] << SHIFT) | codes[1:]
    three = (two[:-1] << SHIFT) | codes[2:]
    return np.concatenate([codes[~edge], two, three[~edge[1:-1]]])


def profile(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` n-grams by descending count, ties by number."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:top]]


class Profiles:
    """Profiles of languages, in the order of their names."""

    def __init__(self, ranked: dict[str, list[int]], top: int):
        self.top, self.names = top, sorted(ranked)
        self.tables = []
        for n in self.names:
            keys = np.array(ranked[n], np.int64)
            order = np.argsort(keys)
            self.tables.append((keys[order], order))

    def predict(self, text: str) -> tuple[str, float]:
        own = grams(text)
        if not len(own) or not self.names:
            return "und", 0.0
        mine = profile(*np.unique(own, return_counts=True), self.top)
        rank, far = np.arange(len(mine)), []
        for keys, order in self.tables:
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            far.append(int(np.where(keys[at] == mine, np.abs(order[at] - rank), self.top).sum()))
        near = [1 - d / (self.top * len(mine)) for d in far]
        best = int(np.argmin(far))
        return self.names[best], near[best] / sum(near) if sum(near) else 0.0


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column("lang").to_pylist(), texts(b), strict=True):
                by.setdefault(name, []).append(grams(t))
            for name, found in by.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    own = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = map_arrow(own, run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, top: int = 300, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages of ``docs``: ``top`` rows a language come to the driver."""
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = gram_counts(docs, text, lang).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    ranked: dict[str, list[int]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["rank"])):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, top)


def languages(docs: DataFrame, teaches: Column, top: int = 300, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned where ``teaches`` holds."""
    known = learn(docs.where(teaches), top, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [known.predict(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(~teaches, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(own, run, "doc_id long, held_out boolean, lang_pred string, score double")
