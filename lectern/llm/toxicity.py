"""Toxicity by class-conditional Kneser-Ney models of words given their stems.

A word is generated in two steps, first its stem (its first bytes), then the whole word among those of
that stem. Each class (toxic, ordinary) keeps its absolutely discounted counts of stems and words; the
discounted mass goes to a backoff that both classes share, made of continuation counts (in
how many texts a word was seen, however often in each), so a rare expression, seen too
seldom in a class, is judged by what the classes have in common, and a new word of a known stem
by its stem. Toxic texts are ordinary texts with a small share of toxic expressions: their likelihood of a word is
the mixture of both models by that share, the one of ``SHARES`` that parts a fold best. A text's value is the mean over its words of the
difference of the two log-likelihoods; a logistic curve, put where it parts the classes of a fold of
the learning rows that gave no counts, turns it into a score.

Counts come from all learning rows, whole texts, and are kept for each distinct word and stem by its 64-bit
hash; nothing is capped. What reaches the driver and the workers grows with the vocabulary: all stems, and the
words that a class has more than ``DISCOUNT`` times. The discount leaves nothing of a rarer
word's own count, so it scores the same without a row, by its stem.

Edge cases: null and empty texts score as the mean ordinary text; rows with a null mark or doc_id
teach nothing; a doc_id marked more than once counts as toxic if one mark says so; where a class
has no learning rows every score is 0; repeated rows score each; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.shipping import ship
from lectern.llm.arrow import gathered, slices, texts
from lectern.llm.common import fold, joined_to_labels
from lectern.llm.wordhash import GAP, words_of
from lectern.llm.worker import map_arrow

#: Bytes of a stem; absolute discount of class counts.
STEM_BYTES, DISCOUNT = 5, 2
#: Shares of toxic expressions in a toxic text that are tried.
SHARES = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1)
#: Words end at ASCII bytes that are neither letters nor digits.
NO_WORD = GAP | np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
GATHERED = 500_000
#: Bytes of text handled at a time.
SLICE = 3_000_000


def hashes(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each lower-case word, the hash of its stem, and the number of words of each text."""
    raw = [t.lower().encode() for t in bodies]
    word, counts = words_of(raw, NO_WORD)
    stem, _ = words_of(raw, NO_WORD, STEM_BYTES)
    return word.view(np.int64), stem.view(np.int64), counts


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of the values of each."""
    found, at = np.unique(key, return_inverse=True)
    out = [np.zeros(len(found), np.int64) for _ in values]
    for o, v in zip(out, values, strict=True):
        np.add.at(o, at, v)
    return found, *out


def summed_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each is there, and the sums of their values."""
    found, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return found, n, np.bincount(at, value, len(found))


def places_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` is in the sorted ``keys``; their number where it isn't."""
    at = np.searchsorted(keys, wanted)
    return np.where(np.append(keys, 0)[at] == wanted, at, len(keys))


@dataclass
class Model:
    """Counts by class of words and stems, the mass discounted of each stem's words, and shared texts.

    Rows are in the order of the sorted keys; one more, of zeros, is for what has no key.
    """

    word_keys: np.ndarray
    word_n: np.ndarray
    word_texts: np.ndarray
    stem_keys: np.ndarray
    stem_n: np.ndarray
    freed: np.ndarray
    stem_texts: np.ndarray
    share: float = SHARES[2]
    cut: float = 0.0
    steep: float = 0.0
    ordinary: float = 0.0

    def __post_init__(self) -> None:
        base = (self.stem_texts + 1) / (self.stem_texts.sum() + len(self.stem_texts))
        self.stem_p = [(np.maximum(n - DISCOUNT, 0) + np.minimum(n, DISCOUNT).sum() * base) / n.sum() for n in self.stem_n]

    def ratios(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Of words by their hashes and those of their stems, the toxic over the ordinary likelihood."""
        word, stem = places_in(self.word_keys, word), places_in(self.stem_keys, stem)
        shared, p = (self.word_texts[word] + 0.1) / (self.stem_texts[stem] + 1), []
        for c in (0, 1):
            n = self.stem_n[c][stem]
            # Relative to the shared backoff, which both classes have as a factor.
            ending = (np.maximum(self.word_n[c][word] - DISCOUNT, 0) / shared + self.freed[c][stem]) / np.maximum(n, 1)
            p.append(self.stem_p[c][stem] * np.where(n > 0, ending, 1))
        return p[1] / p[0]

    def values(self, bodies: list[str], shares: tuple[float, ...] | None = None) -> np.ndarray:
        """The mean log-likelihood difference of each text, NaN without words; with ``shares`` a row for each of them."""
        word, stem, counts = hashes(bodies)
        ratio, ends, out = self.ratios(word, stem), np.cumsum(counts), []
        for share in shares or (self.share,):
            sums = np.concatenate([[0.0], np.cumsum(np.log(1 - share + share * ratio))])
            out.append(np.where(counts > 0, (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1), np.nan))
        return np.stack(out) if shares else out[0]

    def scores(self, bodies: list[str]) -> np.ndarray:
        x = self.values(bodies)
        x = np.where(np.isnan(x), self.ordinary, x)
        return 1 / (1 + np.exp(-np.clip(self.steep * (x - self.cut), -500, 500)))


COUNTS = ("plain", "toxic", "texts")


def word_counts(train: DataFrame) -> DataFrame:
    """(stem, word, plain, toxic, texts) of train(text, toxic): hashes; occurrences in both classes; texts with the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            word, stem, counts = hashes(texts(b))
            text = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((text, word))
            first = np.append(True, np.diff(word[order]) != 0)[: len(word)]
            new = (first | (np.diff(text[order], prepend=-1) != 0)).astype(np.int64)
            toxic = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False) == 1, counts)[order].astype(np.int64)
            at = np.flatnonzero(first)
            if len(at):
                parts = [stem[order][at], word[order][at], *(np.add.reduceat(x, at) for x in (1 - toxic, toxic, new))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["stem", "word", *COUNTS])

    rows = map_arrow(train.select("text", "toxic"), run, "stem long, word long, plain long, toxic long, texts long")
    return rows.groupBy("stem", "word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def table_rows(counts: DataFrame) -> DataFrame:
    """(is_word, key, plain, toxic, texts, freed_plain, freed_toxic): words with more than ``DISCOUNT`` occurrences in a class, and all stems."""
    names = ["is_word", "key", *COUNTS, "freed_plain", "freed_toxic"]

    def rows(stem: np.ndarray, word: np.ndarray, *n: np.ndarray) -> pa.RecordBatch:
        values = [*n, np.minimum(n[0], DISCOUNT), np.minimum(n[1], DISCOUNT)]
        own = np.maximum(n[0], n[1]) > DISCOUNT
        words, stems = [word[own], *(x[own] for x in values)], summed(stem, *values)
        kind = np.repeat([True, False], [len(words[0]), len(stems[0])])
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x)) for x in zip(words, stems, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, GATHERED):
            yield rows(*(b.column(c).to_numpy() for c in ("stem", "word", *COUNTS)))

    parts = map_arrow(counts, run, "is_word boolean, " + ", ".join(f"{c} long" for c in names[1:]))
    return parts.groupBy("is_word", "key").agg(*(F.sum(c).alias(c) for c in names[2:]))


def learn(train: DataFrame) -> Model | None:
    """The model of train(text, toxic); None if a class is missing. The rows of ``table_rows`` come here."""
    found = table_rows(word_counts(train)).toArrow()
    column = {c: found.column(c).to_numpy() for c in found.column_names}

    def table(at: np.ndarray, *names: str) -> np.ndarray:
        return np.stack([np.append(column[c][at], 0).astype(np.float64) for c in names])

    word, stem = (x[np.argsort(column["key"][x])] for x in (np.flatnonzero(column["is_word"]), np.flatnonzero(~column["is_word"])))
    stem_n = table(stem, "plain", "toxic")
    if not stem_n.sum(axis=1).all():
        return None
    key = column["key"]
    return Model(key[word], table(word, "plain", "toxic"), table(word, "texts")[0], key[stem], stem_n, table(stem, "freed_plain", "freed_toxic"), table(stem, "texts")[0])


#: Bins of the histograms by which the curve is placed; they are of the cube root of a value, so small values have narrow ones.
BINS = 8192


def bin_of(x: np.ndarray) -> np.ndarray:
    return np.clip(((np.cbrt(x) / 2 + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def placed(model: Model, held: DataFrame) -> Model:
    """``model`` with the share and the place of its curve that part the classes of held(text, toxic) best."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) == 1
            for k, x in enumerate(shared.value.values(texts(b), SHARES)):
                ok = ~np.isnan(x)
                key, n, total = summed_by(bin_of(x[ok]) + BINS * toxic[ok] + 2 * BINS * k, x[ok])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(total)], ["bin", "n", "total"])

    counts, sums = np.zeros(2 * BINS * len(SHARES)), np.zeros(2 * BINS * len(SHARES))
    found = map_arrow(held.select("text", "toxic"), run, "bin long, n long, total double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in found.collect():  # a row a bin
        counts[r["bin"]], sums[r["bin"]] = r["n"], r["total"]
    best = -1.0
    for share, n, total in zip(SHARES, counts.reshape(-1, 2, BINS), sums.reshape(-1, 2, BINS), strict=True):
        if not n.sum(axis=1).all():
            model.cut, model.steep, model.ordinary = 0.0, 4.0, -1.0
            continue
        # F1 of calling a bin and those above it toxic; the middle of the first run of best cuts.
        hit, false = (x[::-1].cumsum()[::-1] for x in (n[1], n[0]))
        f1 = 2 * hit / (hit + false + n[1].sum())
        if f1.max() > best + 1e-12:
            best = f1.max()
            low, high = total.sum(axis=1) / n.sum(axis=1)
            at = np.flatnonzero(f1 >= best - 1e-12)
            end = at[np.append(np.flatnonzero(np.diff(at) > 1), len(at) - 1)[0]]
            model.share, model.ordinary = share, float(low)
            model.cut = float(((at[0] + end) / BINS - 1) * 2) ** 3
            model.steep = 8.0 / max(1e-6, float(high - low))
    return model


def fitted(docs: DataFrame, marks: DataFrame, teaches: Column, places: Column, text: str = "text", doc_id: str = "doc_id") -> Model | None:
    """The model that the rows of ``docs`` marked in marks(doc_id, toxic) give.

    Rows where ``teaches`` holds teach; those of them where ``places`` holds give no counts but
    place the curve. Both are conditions on ``doc_id``.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    one = marks.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    one = one.where(teaches).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = learn(joined_to_labels(known, one.where(~places), "inner"))
    return model if model is None else placed(model, joined_to_labels(known, one.where(places), "inner"))


def toxic_scores(docs: DataFrame, marks: DataFrame, teaches: Column, places: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by the model ``fitted`` gives."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, marks, teaches, places, text, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            score = shared.value.scores(texts(b)) if shared.value else np.zeros(b.num_rows)
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = own.select("doc_id", F.coalesce(~teaches, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, marks: DataFrame, teaches: Column, places: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that score below one half. Rows pass as they are; nothing is joined."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, marks, teaches, places, text, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, SLICE):
            yield b.filter(pa.array(shared.value.scores(texts(b, text)) < 0.5)) if shared.value else b

    return map_arrow(docs, run, docs.schema)


def default_folds() -> dict[str, Column]:
    """Fold 0 of 5 by doc_id is held out, fold 4 places the curve."""
    return {"teaches": fold("doc_id", 5) != 0, "places": fold("doc_id", 5) == 4}
