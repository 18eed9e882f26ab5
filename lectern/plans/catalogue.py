"""Every verified query of the engine, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans import extracts, finders, more, rollups, texts  # noqa: F401
from lectern.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = QUERIES["lexicon_scores"](spark, sf_dir)
    places = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    return scored.join(places, "doc_id").groupBy("lang", "source", "stance").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("avg_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
