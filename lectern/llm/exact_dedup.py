"""Exact duplicates through content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so: after at least ``shortest`` characters at
the next gap between words that follows one of a few letters, after ``longest`` at the
latest. Equal chunks get one identifier, a 64-bit hash, once the dictionary of distinct
chunks has shown that no two different chunks share it; the few hashes for which that fails are
told apart by the chunk's sha256. A text then is the ordered list of its chunk
identifiers, a few bytes a kilobyte, and only these recipes are grouped: long texts move
once, into the dictionary, and copies of a chunk are merged before they move.

Edge cases: null counts as empty; an empty text has an empty recipe; repeated rows with
one doc_id count as rows; ties keep the largest doc_id, a null one only
where there is no other; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(text: Column, shortest: int = 512, longest: int = 4096) -> Column:
    """The content-defined chunks of ``text``; joined they give it back. An empty text has none."""
    cut = rf"(?s).{{{shortest},{longest}}}?(?<=[aeioust.] )|.{{1,{longest}}}"
    return F.when(F.length(text) <= shortest, F.filter(F.array(text), lambda c: c != "")).otherwise(
        F.regexp_extract_all(text, F.lit(cut), F.lit(0))
    )


def clashing(docs: DataFrame, text: str = "text", **cut: int) -> DataFrame:
    """Chunk hashes that stand for more than one chunk: column ``h``. Expected to be empty."""
    one = docs.select(F.explode(chunks(F.coalesce(F.col(text), F.lit("")), **cut)).alias("chunk"))
    # Grouping by the chunk itself is what verifies; copies merge before the shuffle.
    distinct = one.groupBy(F.xxhash64("chunk").alias("h"), "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **cut: int) -> DataFrame:
    """(doc_id, recipe array of chunk identifiers, text_sha256)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("body"))
    bad = clashing(docs, text, **cut)
    if not bad.isEmpty():
        # The hash names more than one chunk somewhere: names get the chunk's digest as well.
        ids = F.transform(chunks(F.col("body"), **cut), lambda c: F.concat_ws(":", F.xxhash64(c).cast("string"), F.sha2(c, 256)))
    else:
        ids = F.transform(chunks(F.col("body"), **cut), lambda c: F.xxhash64(c))
    return base.select("doc_id", ids.alias("recipe"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **cut: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    # The key names both the list and its length; the join below is on key and list, so a
    # hot group's documents can be split over tasks by the adaptive skew join.
    own = recipes(docs, text, doc_id, **cut).withColumn("key", F.xxhash64(F.size("recipe"), "recipe"))
    groups = own.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(
        F.xxhash64(F.size("recipe"), "recipe").alias("g_key"), F.col("recipe").alias("g_recipe"), "keep_id", "group_size"
    )
    hit = own.join(groups.hint("merge"), (F.col("key") == F.col("g_key")) & (F.col("recipe") == F.col("g_recipe")))
    return hit.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
