"""The domain tables, as they stand in the test tables, for Spark and for SQL.

institutions: nation and region; speakers: customer; speeches: orders; analyses: lineitem;
processing logs: events; contents: documents; pages: pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(c: Column) -> Column:
    """``c`` to six digits as the SQL's round gives it, which rounds the product of doubles: a tie in decimals may be none there."""
    x = c.cast("double")
    return F.coalesce(F.round(x * 1e6).try_cast("long") / 1e6, x)


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind = F.when(F.col("n_regionkey") == 0, "central_bank").when(F.col("n_regionkey") == 1, "treasury").otherwise("international")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("inst_id"), F.col("n_name").alias("code"), F.col("r_name").alias("country"), kind.alias("inst_type")
    )


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ends = F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("date")).otherwise(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")))
    return c.select(
        F.col("c_custkey").alias("speaker_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("inst_id"), F.col("c_mktsegment").alias("role"),
        (F.col("c_acctbal") > 0).alias("voting_member"), ends.alias("end_date"),
        F.array("c_name", F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string"))).alias("alternate_names"),
    )


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("o_totalprice") - 250000) / 250000))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("speaker_id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("speech_date"),
        F.col("o_orderpriority").alias("stance"), F.when(F.col("o_orderstatus") != "O", score).alias("score"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("word_count"),
        F.concat(F.lit("https://bank.example/speech/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.array(F.lower("o_orderpriority"), F.lower("o_orderstatus")).alias("tags"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of speeches; the key (speech_id, version) is made unique by a total order of all that is used."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("speech_id"), F.col("l_linenumber").cast("long").alias("version"), F.col("l_shipdate").alias("ts"), F.col("l_discount").alias("score"), F.col("l_tax").alias("confidence"))
    return rows.groupBy("speech_id", "version").agg(F.max(F.struct("ts", "score", "confidence")).alias("x")).select("speech_id", "version", "x.ts", "x.score", "x.confidence")


# The same tables in SQL, as common table expressions.
INSTITUTIONS = """institutions AS (SELECT n_nationkey::BIGINT AS inst_id, n_name AS code, r_name AS country,
  CASE n_regionkey WHEN 0 THEN 'central_bank' WHEN 1 THEN 'treasury' ELSE 'international' END AS inst_type
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
SPEAKERS = """speakers AS (SELECT c_custkey AS speaker_id, c_name AS name, c_nationkey::BIGINT AS inst_id, c_mktsegment AS role, c_acctbal > 0 AS voting_member,
  CASE WHEN c_custkey % 3 <> 0 THEN DATE '1996-01-01' + (c_custkey % 2000)::INTEGER END AS end_date,
  [c_name, c_mktsegment || ' ' || c_custkey] AS alternate_names FROM customer)"""
SPEECHES = """speeches AS (SELECT o_orderkey AS id, o_custkey AS speaker_id, o_orderstatus AS status, o_orderdate::DATE AS speech_date, o_orderpriority AS stance,
  CASE WHEN o_orderstatus <> 'O' THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (o_totalprice - 250000) / 250000)) END AS score,
  floor(o_totalprice / 100)::BIGINT AS word_count, 'https://bank.example/speech/' || o_orderkey AS url,
  [lower(o_orderpriority), lower(o_orderstatus)] AS tags FROM orders)"""
ANALYSES = """analyses AS (SELECT l_orderkey AS speech_id, l_linenumber::BIGINT AS version, l_shipdate AS ts, l_discount AS score, l_tax AS confidence FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_discount DESC, l_tax DESC) = 1)"""
