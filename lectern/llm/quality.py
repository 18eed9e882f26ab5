"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and pairs of neighbours are hashed into ``cells`` cells. Two multinomials over the cells,
of the trusted target (texts marked good) and of the raw corpus, give each cell a weight, the
log of their ratio; a text's value is the mean weight of its words and pairs. A text is kept
if it passes the base rules and its value is at least ``least``, the same for every text.

The counts take one pass with partial sums: ``cells`` numbers a task are shuffled, and ``cells`` numbers reach the
driver, whatever the corpus. The second pass scores without a shuffle.

Edge cases: null texts have no words; texts without words fail the base rules and have value 0;
without target texts every weight is 0; repeated rows count each; other columns are ignored; empty
tables give no rows; rows with a null mark or doc_id aren't trusted.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD_GAP, joined_to_labels

GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Features a cell that the target borrows from the raw corpus; steadies the weights of a small target.
PRIOR = 20


def words(text: Column) -> Column:
    """The words of ``text`` in order; null and blank texts have none."""
    bare = F.btrim(text, F.lit(GAPS))
    return F.when(F.length(bare) > 0, F.split(bare, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def places(first: int, last: Column) -> Column:
    """first, first + 1, ... last; none if last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def with_hashes(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with w, the words of ``text``, and h, their hashes."""
    return docs.withColumn("w", words(F.col(text))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def word_cell(x: Column, cells: int) -> Column:
    return F.pmod(x, F.lit(cells)).cast("int")


def pair_cell(h: Column, i: Column, cells: int) -> Column:
    """The cell of the words at i - 1 and i."""
    return F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(cells)).cast("int")


def cell_weights(docs: DataFrame, trusted: DataFrame, cells: int) -> list[float]:
    """The weight of every cell: the log of target over raw share, the target drawn to the corpus by PRIOR."""
    marked = joined_to_labels(docs, trusted.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("target", F.lit(1)), "left")
    rows = with_hashes(marked, "text").select("target", "h")
    h = F.col("h")
    found = F.concat(F.transform(h, lambda x: word_cell(x, cells)), F.transform(places(1, F.size(h) - 1), lambda i: pair_cell(h, i, cells)))
    counts = rows.select("target", F.explode(found).alias("cell")).groupBy("cell").agg(F.count("*").alias("raw"), F.count("target").alias("good"))
    raw, good = [0] * cells, [0] * cells
    for r in counts.collect():  # one row a cell
        raw[r["cell"]], good[r["cell"]] = r["raw"], r["good"]
    n, m, prior = sum(raw) + cells, sum(good), PRIOR * cells
    share = [(a + 1) / n for a in raw]
    return [round(math.log((g + prior * q) / (m + prior) / q), 6) for g, q in zip(good, share, strict=True)]


def ruled(docs: DataFrame, trusted: DataFrame, cells: int = 1 << 14, least: float = -0.05, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr for every document.

    ``trusted`` names the target's documents by doc_id.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = F.from_json(F.lit(json.dumps(cell_weights(own, trusted, cells))), "array<double>")
    t, w, h, n = F.col("text"), F.col("w"), F.col("h"), F.col("n_words")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(GAPS))) > 0)
    rows = with_hashes(own, "text").select(
        "doc_id", "w", "h", F.size("w").alias("n_words"), lines.alias("lines"),
        F.length(F.regexp_replace(t, WORD_GAP, "")).alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
    )
    triples = F.transform(places(0, n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    rows = rows.select(
        "doc_id", "w", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        triples.alias("triples"),
        F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(weights, word_cell(x, cells))).alias("by_word"),
        F.aggregate(places(1, n - 1), F.lit(0.0), lambda a, i: a + F.get(weights, pair_cell(h, i, cells))).alias("by_pair"),
    )
    # Most texts repeat no window: their window hashes all differ, which proves it. Of the others the windows
    # themselves are sorted with their places; equal ones are then neighbours.
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    window = F.transform(places(0, n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(some, F.sort_array(window)).otherwise(F.array().cast("array<struct<s:string,i:int>>")))
    s = F.col("sorted")
    same = F.filter(
        places(0, F.size(s) - 1),
        lambda j: (F.get(s, j)["s"] == F.coalesce(F.get(s, j - 1)["s"], F.lit(""))) | (F.get(s, j)["s"] == F.coalesce(F.get(s, j + 1)["s"], F.lit(""))),
    )
    inside = F.array_distinct(F.flatten(F.transform(same, lambda j: F.sequence(F.get(s, j)["i"], F.get(s, j)["i"] + 2))))
    rows = rows.withColumn("n_repeat_words", F.size(inside))
    rows = rows.select(
        "doc_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ((n < 50) | (F.col("n_repeat_words") * F.lit(100) > n * F.lit(50))).alias("base_failed"),
        F.when(n > 0, (F.col("by_word") + F.col("by_pair")) / (n * 2 - 1)).otherwise(F.lit(0.0)).alias("llr"),
    )
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))
