"""Lookups over speeches, speakers, institutions and analyses: declarative filters with explicit order.

Descending order puts nulls first and ascending order last; ties are broken by ``id``. A limit of 0
or None means none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: str = "speech_date", limit: int | None = None, id_: str = "id") -> DataFrame:
    out = df.orderBy(F.col(by).desc_nulls_first(), id_)
    return out.limit(limit) if limit else out


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(F.col(name).asc_nulls_last())


def page(df: DataFrame, number: int, size: int = 100, by: str = "speech_date", id_: str = "id") -> DataFrame:
    """One page in ascending order."""
    return df.orderBy(F.col(by).asc_nulls_last(), id_).offset(number * size).limit(size)


def stream_rows(df: DataFrame, by: str = "speech_date", id_: str = "id"):
    """The rows in ascending order, partition by partition."""
    return df.orderBy(F.col(by).asc_nulls_last(), id_).toLocalIterator(prefetchPartitions=True)


def find_by(df: DataFrame, where: Column | dict, limit: int | None = None, by: str = "speech_date") -> DataFrame:
    """The newest rows that match a condition or equal values."""
    if isinstance(where, dict):
        cond = F.lit(True)
        for k, v in where.items():
            cond = cond & (F.col(k) == F.lit(v))
        where = cond
    return newest(df.where(where), by, limit)


def by_speaker_name(speeches: DataFrame, speakers: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Speeches whose speaker's name has ``pattern`` in it, % and _ standing for what they do in ILIKE."""
    return newest(speeches.join(speakers.where(F.col("name").ilike(f"%{pattern}%")).select("speaker_id", "name"), "speaker_id"), limit=limit)


def unprocessed(speeches: DataFrame, limit: int | None = None, text: str = "url") -> DataFrame:
    out = speeches.where(F.col("score").isNull() & F.col(text).isNotNull() & (F.col(text) != "")).orderBy(F.col("speech_date").asc_nulls_last(), "id")
    return out.limit(limit) if limit else out


def exists(df: DataFrame, where: Column) -> bool:
    return not df.where(where).limit(1).isEmpty()


def current(speakers: DataFrame, as_of: str) -> DataFrame:
    return by_name(speakers.where(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(as_of).cast("date"))))


#: Rows of the second side of ``overlapping`` that are sent to every executor; rows of it that are met at a time.
BROADCAST_ROWS, BLOCK = 1_000_000, 256


def overlapping(a: DataFrame, b: DataFrame, key: str, salts: int = 16, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All pairs of a(key, s, e) and b(key, s2, e2) whose closed ranges overlap; a null bound overlaps nothing.

    The pairs are far more than the rows, so what they take where they are written counts most. Where ``b`` is counted small, only ``a`` is moved, once, and
    a task's rows meet ``b`` a block of a key after the other: a pair's first column then comes in runs and its second repeats at short distance, which
    files encode well. Otherwise rows of ``b`` are dealt over ``salts`` parts of a key, which those of ``a`` all visit, so a frequent key is shared by several tasks.
    """
    if b.limit(broadcast_rows + 1).count() > broadcast_rows:
        every = a.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = b.withColumn("_salt", F.pmod(F.xxhash64(*b.columns), F.lit(salts)).cast("int"))
        return every.join(dealt.hint("merge"), [key, "_salt"]).where("s <= e2 AND e >= s2").drop("_salt")
    sizes = b.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = a.join(F.broadcast(sizes), key).repartitionByRange(parts, key, *(c for c in a.columns if c != key)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # A sort below a join is dropped by the optimizer unless a condition that it may not move stands between.
    ordered = every.drop("_blocks").sortWithinPartitions(key, "_block").where(F.monotonically_increasing_id() >= 0)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(c for c in b.columns if c != key)))
    blocks = b.withColumn("_block", F.floor((place - 1) / BLOCK).cast("int"))
    return ordered.join(F.broadcast(blocks), [key, "_block"]).where("s <= e2 AND e >= s2").drop("_block")


def by_alternate_name(speakers: DataFrame, name: str) -> DataFrame:
    return by_name(speakers.where(F.array_contains("alternate_names", name) | F.array_join("alternate_names", " ").ilike(f"%{name}%")))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-case words, each between two blanks and one."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def fuzzy_name(speakers: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    out = speakers.withColumn("similarity", trigram_similarity(F.col("name"), F.lit(name)))
    return out.where(F.col("name").ilike(f"%{name}%") | (F.col("similarity") > least)).orderBy(F.desc("similarity"), "speaker_id")


def latest_per(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The row with the largest ``by`` for each key, by partial aggregation rather than a sort."""
    rest = [c for c in df.columns if c != key and c not in by]
    return df.groupBy(key).agg(F.max(F.struct(*by, *rest)).alias("x")).select(key, "x.*")
