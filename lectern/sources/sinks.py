"""Writing: upserts, deletes and exports over Parquet tables, by rewriting to a new folder.

There is no table format here, so a change writes a whole new table and the caller switches to it; on a table
format the same frames go into MERGE and DELETE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep_when_null: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``key``; of the named columns, nulls do not overwrite."""
    kept = old.join(new.select(*key), key, "left_anti")
    if not keep_when_null:
        return kept.unionByName(new)
    before = old.select(*key, *(F.col(c).alias(f"_{c}") for c in keep_when_null))
    filled = new.join(before, key, "left")
    return kept.unionByName(filled.select(*(F.coalesce(c, f"_{c}").alias(c) if c in keep_when_null else F.col(c) for c in new.columns)))


def checked_insert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` if none of its keys is there or comes twice; otherwise ValueError, and nothing is written."""
    if not new.groupBy(*key).count().where("count > 1").isEmpty() or not new.join(old, key, "left_semi").isEmpty():
        raise ValueError(f"duplicate {', '.join(key)}")
    return new


def deleted(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows of ``keys``; KeyError if one isn't there."""
    if not keys.join(old, key, "left_anti").isEmpty():
        raise KeyError(f"no such {', '.join(key)}")
    return old.join(keys, key, "left_anti")


def cascaded(children: DataFrame, gone: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children of deleted parents leave, or lose their parent."""
    if not set_null:
        return children.join(gone.select(key), key, "left_anti")
    marked = children.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*children.columns)


def with_hashes(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({"content_sha256": F.sha2(text, 256), "content_md5": F.md5(text), "content_length": F.length(text)})


def content_addressed(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row per content hash: the last in ``order``."""
    rest = [c for c in df.columns]
    got = df.groupBy(F.sha2(text, 256).alias("content_sha256")).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return got.select("content_sha256", "x.*")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in that order, missing ones empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def write_speeches(df: DataFrame, path: str) -> None:
    """Parquet by institution and year, by date within files."""
    out = df.withColumn("year", F.year("speech_date"))
    out.repartition("institution_code", "year").sortWithinPartitions("speech_date").write.mode("overwrite").partitionBy("institution_code", "year").parquet(path)


def append_log(df: DataFrame, path: str, text: str = "text") -> None:
    df.withColumn("text_hash", F.md5(text)).drop(text).write.mode("append").parquet(path)
