"""Checked queries on features, derived statuses, keys, upserts and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import extraction as ex
from lectern.functions import features as fe
from lectern.functions import text as tx
from lectern.functions import validation as va
from lectern.functions import values
from lectern.operators.batches import dependency_levels
from lectern.operators.rollups import percent
from lectern.plans.domain import SPEECHES, analyses, number, speeches, table
from lectern.plans.registry import query
from lectern.plans.texts import PARTS, SENT
from lectern.sources import sinks

WORDS = r"CASE WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') END"


@query(rf"""WITH {PARTS}, w AS (SELECT doc_id, text, n_sentences, {WORDS} AS ws, {SENT} AS sn FROM parts)
 SELECT doc_id, length(text) AS text_length, len(ws)::BIGINT AS word_count, n_sentences AS sentence_count, round(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::DOUBLE / greatest(len(ws), 1), 6) AS avg_word_length,
 round(len(ws)::DOUBLE / greatest(n_sentences, 1), 6) AS avg_sentence_length, round(coalesce(len(list_filter(ws, lambda x: length(x) > 6))::DOUBLE / nullif(len(ws), 0), 0), 6) AS long_word_ratio,
 round(len(list_filter(sn, lambda s: len(regexp_split_to_array(s, '\s+')) > 20))::DOUBLE / greatest(n_sentences, 1), 6) AS complex_sentence_ratio FROM w""")
def hybrid_text_features(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumns({"ws": tx.space_words(F.col("text")), "sn": tx.sentences(F.col("text"))})
    return docs.select("doc_id", *((number(c) if k.startswith("avg") or k.endswith("ratio") else c.cast("long")).alias(k) for k, c in fe.text_features(F.col("text"), F.col("ws"), F.col("sn")).items()))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment ILIKE '%machinery%' THEN 1.0 WHEN c_mktsegment ILIKE '%build%' THEN 0.8 ELSE 0.5 END::DOUBLE AS authority FROM customer""")
def speaker_authority(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", fe.authority(F.col("c_mktsegment"), {"machinery": 1.0, "build": 0.8}).alias("authority"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 20 - 1 AS s, 0.7::DOUBLE AS c, l_tax * 10 - 0.4 AS t, 0.6::DOUBLE AS d FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, round((s * 0.6 * c + t * 0.8 * d) / (0.6 * c + 0.8 * d), 6)::DOUBLE AS score, round(least(1.0, (c + d) / 2 + greatest(0.0, 0.2 - abs(s - t) / 2)), 6)::DOUBLE AS confidence FROM x""")
def rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    score, sure = fe.rule_ensemble([(F.col("l_discount") * 20 - 1, F.lit(0.7), 0.6), (F.col("l_tax") * 10 - 0.4, F.lit(0.6), 0.8)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", number(score).alias("score"), number(sure).alias("confidence"))


@query("""WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber, l_discount * 5 AS pos, l_tax * 5 AS neg, l_quantity / 50 + 0.00137 AS conf, l_partkey % 2 = 0 AS fin FROM lineitem)
 SELECT doc_id, round(sum((pos - neg) * CASE WHEN fin THEN 1 ELSE 0.5 END * conf) / sum(conf), 5)::DOUBLE AS score, round(least(1.0, avg(conf) + least(0.1, 0.05 * (count(*) - 1))), 5)::DOUBLE AS confidence FROM m GROUP BY doc_id""")
def model_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Given class scores of models, combined; no model runs here."""
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") * 5).alias("pos"), (F.col("l_tax") * 5).alias("neg"), (F.col("l_quantity") / 50 + 0.00137).alias("confidence"), (F.col("l_partkey") % 2 == 0).alias("financial"))
    return fe.model_ensemble(rows).select("doc_id", F.round("score", 5).alias("score"), F.round("confidence", 5).alias("confidence"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 20 - 1 AS s, CASE WHEN l_partkey % 3 = 0 THEN l_tax * 10 - 0.4 END AS t FROM lineitem), y AS (SELECT *, CASE WHEN t IS NOT NULL AND t <> 0 THEN 0.3 * s + 0.7 * t ELSE s END AS z FROM x)
 SELECT l_orderkey, l_linenumber, l_partkey, round(z, 6)::DOUBLE AS score, CASE WHEN t IS NOT NULL AND t <> 0 THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence, CASE WHEN t IS NOT NULL AND t <> 0 THEN 'ensemble' ELSE 'lexicon_only' END AS method FROM y""")
def pipeline_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    score, sure, method = fe.pipeline_sentiment(F.col("l_discount") * 20 - 1, F.when(F.col("l_partkey") % 3 == 0, F.col("l_tax") * 10 - 0.4))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", number(score).alias("score"), sure.alias("confidence"), method.alias("method"))


@query(f"""WITH {SPEECHES}, v AS (SELECT id, CASE WHEN coalesce(score BETWEEN -1 AND 1, false) THEN 1.0 ELSE 0.5 END * CASE WHEN abs(score) > 0.3 AND stance = '3-MEDIUM' THEN 0.8 ELSE 1 END AS c FROM speeches) SELECT id, round(c, 6)::DOUBLE AS confidence, c > 0.5 AS ok FROM v""")
def validate_analysis(spark: SparkSession, sf: str) -> DataFrame:
    c = va.result_confidence(F.col("score"), F.lit(0.9), F.lit(0.1), F.when(F.col("stance") == "3-MEDIUM", "neutral").otherwise("hawkish"))
    return speeches(spark, sf).withColumn("c", c).select("id", number(F.col("c")).alias("confidence"), (F.col("c") > 0.5).alias("ok"))


@query("""SELECT event_id, round(CASE WHEN value / 100 < 0.2 THEN 0.6 ELSE 1 END * CASE WHEN value > 120 THEN 0.9 ELSE 1 END * CASE WHEN event_type = 'error' THEN 0.4 ELSE 1 END * CASE WHEN event_type = 'view' THEN 0.5 ELSE 1 END, 6)::DOUBLE AS confidence FROM events""")
def validate_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    done = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    return table(spark, sf, "events").select("event_id", number(va.pipeline_confidence(F.col("value") / 100, F.col("value"), done, F.col("event_type") != "view")).alias("confidence"))


@query(f"""WITH {SPEECHES}, v AS (SELECT id, list_filter([CASE WHEN year(speech_date) < 1900 THEN 'date too early' END, CASE WHEN speech_date > DATE '2000-01-01' THEN 'date in the future' END, CASE WHEN status = 'P' THEN 'institution unknown' END], lambda x: x IS NOT NULL) AS i FROM speeches)
 SELECT id, array_to_string(i, ',') AS issues FROM v""")
def validate_metadata(spark: SparkSession, sf: str) -> DataFrame:
    i = va.metadata_issues(F.col("stance"), F.col("status"), F.col("speech_date"), F.col("url"), F.col("status") != "P", "2000-01-01")
    return speeches(spark, sf).select("id", F.array_join(F.transform(i, lambda x: x["message"]), ",").alias("issues"))


@query("SELECT user_id, count(*) AS requests, round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_percent, count(*) FILTER (event_type = 'error') * 2 >= count(*) AS open FROM events GROUP BY user_id")
def domain_statistics(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") != "error").alias("ok"))
    return one.select("user_id", "requests", number(percent(F.col("ok"), F.col("requests"))).alias("success_percent"), ((F.col("requests") - F.col("ok")) * 2 >= F.col("requests")).alias("open"))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (event_type = 'error') * 5 < count(*) AS ok FROM events GROUP BY user_id)
 SELECT count(*) FILTER (ok) AS healthy, count(*) AS total, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 6) AS healthy_percent, array_to_string(list_sort(list(user_id) FILTER (NOT ok)), ',') AS unhealthy FROM h""")
def health_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") * 5 < F.count("*")).alias("ok"))
    bad = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("user_id"))))
    return per.agg(F.count_if("ok").alias("healthy"), F.count("*").alias("total"), number(F.count_if("ok") * 100.0 / F.count("*")).alias("healthy_percent"), F.array_join(F.transform(bad, lambda x: x.cast("string")), ",").alias("unhealthy"))


@query(f"""WITH {SPEECHES} SELECT id, left(regexp_replace(speech_date || '_' || lower(stance) || '_' || left(sha256(url), 12), '[^A-Za-z0-9_\\-]+', '_', 'g'), 100) AS key, 'FED_' || (id % 7) || ':' || lpad(id::VARCHAR, 8, '0') AS sid, least(60.0, pow(2.0, id % 9))::DOUBLE AS wait FROM speeches""")
def keys_and_backoff(spark: SparkSession, sf: str) -> DataFrame:
    sid = values.speech_id(F.concat(F.lit("FED_"), (F.col("id") % 7).cast("string")), F.lpad(F.col("id").cast("string"), 8, "0"))
    return speeches(spark, sf).select("id", values.file_key(F.col("speech_date"), F.col("stance"), F.col("url")).alias("key"), sid.alias("sid"), values.backoff(F.col("id") % 9).alias("wait"))


@query(f"WITH {SPEECHES} SELECT id, CASE WHEN score IS NOT NULL THEN 'analyzed' WHEN status = 'P' THEN 'validated' ELSE 'failed' END AS next, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT *, [tags[1], tags[2]] AS list_distinct_ordered FROM speeches)")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    s = speeches(spark, sf)
    messy = F.concat(F.transform("tags", lambda t: F.concat(F.lit(" "), F.upper(t))), F.col("tags"))
    return s.select("id", values.next_status(F.col("status"), F.lit(True), F.col("status") == "P", F.col("score").isNotNull()).alias("next"), F.array_join(values.clean_tags(messy), ",").alias("tags"))


@query(f"""WITH {SPEECHES} SELECT id, CASE WHEN id % 10 = 0 THEN 'X' ELSE status END AS status, CASE WHEN id % 20 = 0 THEN 'new' ELSE stance END AS stance FROM speeches""")
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    old = speeches(spark, sf).select("id", "status", "stance")
    new = old.where("id % 10 = 0").select("id", F.lit("X").alias("status"), F.when(F.col("id") % 20 == 0, "new").alias("stance"))
    return sinks.upserted(old, new, ["id"], ["stance"])


@query(f"WITH {SPEECHES} SELECT l_orderkey AS speech_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey NOT IN (SELECT id FROM speeches WHERE status = 'F') GROUP BY l_orderkey")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = speeches(spark, sf).where("status = 'F'").select(F.col("id").alias("speech_id"))
    return sinks.cascaded(analyses(spark, sf), gone, "speech_id").groupBy("speech_id").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS content_sha256, max(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def content_addressed_files(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.content_addressed(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("content_sha256", "doc_id")


@query("SELECT page_id, length(html) BETWEEN 200 AND 10000000 AND NOT (length(html) < 1000 AND contains(lower(html), '404 error')) AS ok FROM pages")
def page_checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", va.page_ok(F.col("html")).alias("ok"))


@query("""SELECT page_id, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda l: CASE WHEN regexp_matches(l, '^https?://') THEN l WHEN starts_with(l, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || l ELSE regexp_replace(url, '[^/]*$', '') || l END)) AS link FROM pages""")
def absolute_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(ex.links(F.col("html"))).alias("l"))
    return rows.select("page_id", ex.absolute(F.col("l"), F.col("url")).alias("link"))


@query(f"WITH {SPEECHES} SELECT count(*) AS n, count(*) FILTER (status = 'F') AS completed, count(score) AS analysed, round(avg(score), 6) AS mean_score, date_diff('day', min(speech_date), max(speech_date)) AS span, count(DISTINCT speaker_id) AS n_speakers FROM speeches")
def collection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("completed"), F.count("score").alias("analysed"), number(F.avg("score")).alias("mean_score"),
        F.datediff(F.max("speech_date"), F.min("speech_date")).cast("long").alias("span"), F.countDistinct("speaker_id").alias("n_speakers"),
    )


@query("SELECT n_nationkey AS node, CASE WHEN n_nationkey = 0 THEN 0 ELSE floor(log2(n_nationkey + 1)) END::INTEGER AS level FROM nation")
def dependency_batches(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    needs = n.where("node > 0").select("node", F.floor((F.col("node") - 1) / 2).cast("int").alias("needs"))
    return dependency_levels(n, needs)
