"""What the training-data operators share: scratch tables, folds, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.scratch import discard, scratch_dir, written  # noqa: F401

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows of a two-column side that may be broadcast (some 16 bytes a row), unless a caller says otherwise.
BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def identified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carried: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(doc, doc_id, text) of every row, and where asked for the struct ``carried`` of other columns; whether ``doc`` is the doc_id.

    ``doc`` is a row's own number and follows the order of doc_ids, null first. Where doc_ids are unique and none is null, it is
    the doc_id. Otherwise rows are numbered by doc_id and text and written, so that numbers stay as they are.
    """
    more = [F.struct(*(F.col(f"`{c}`") for c in carried)).alias("carried")] if carried else []
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)
    if own.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return own.withColumn("doc", F.col("doc_id")), True
    dealt = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").withColumn("doc", F.monotonically_increasing_id())), False


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``folds``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def joined_to_labels(docs: DataFrame, marks: DataFrame, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``marks`` (doc_id and columns no document has); broadcast only when counted small, else a shuffle join."""
    return docs.join(F.broadcast(marks) if small_enough(marks, rows) else marks.hint("merge"), "doc_id", how)
