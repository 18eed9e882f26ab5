"""Checked joins, roll-ups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.finders import latest_per, overlapping
from lectern.operators.rollups import as_map, bins, cumulative_buckets, histogram, nonzero, percent, zero_filled
from lectern.plans.domain import ANALYSES, INSTITUTIONS, SPEAKERS, SPEECHES, analyses, institutions, number, speakers, speeches, table
from lectern.plans.registry import query


@query(f"""WITH {SPEECHES}, {SPEAKERS}, {INSTITUTIONS} SELECT s.id, s.speech_date, s.stance, p.name, i.code, i.country FROM speeches s
 LEFT JOIN speakers p ON p.speaker_id = s.speaker_id AND p.voting_member LEFT JOIN institutions i ON i.inst_id = p.inst_id""")
def summary_view(spark: SparkSession, sf: str) -> DataFrame:
    own = speakers(spark, sf).where("voting_member").select("speaker_id", "name", "inst_id")
    out = speeches(spark, sf).join(own, "speaker_id", "left").join(institutions(spark, sf), "inst_id", "left")
    return out.select("id", "speech_date", "stance", "name", "code", "country")


@query(f"""WITH {SPEECHES}, {SPEAKERS}, {INSTITUTIONS} SELECT i.code, count(s.id) AS n_speeches, count(DISTINCT s.speaker_id) AS n_speakers, min(s.speech_date) AS first_date, max(s.speech_date) AS last_date,
 round(avg(s.score), 6) AS avg_score, round(avg(s.word_count), 6) AS avg_words, count(CASE WHEN s.score IS NOT NULL THEN 1 END) AS n_analysed
 FROM institutions i LEFT JOIN speakers p ON p.inst_id = i.inst_id LEFT JOIN speeches s ON s.speaker_id = p.speaker_id GROUP BY i.code""")
def institution_statistics(spark: SparkSession, sf: str) -> DataFrame:
    # Speeches are summed by speaker first, so only a row a speaker goes on.
    per = speeches(spark, sf).groupBy("speaker_id").agg(
        F.count("*").alias("n"), F.min("speech_date").alias("lo"), F.max("speech_date").alias("hi"), F.sum("score").alias("s"), F.count("score").alias("m"), F.sum("word_count").alias("w")
    )
    rows = institutions(spark, sf).join(speakers(spark, sf).select("speaker_id", "inst_id"), "inst_id", "left").join(per, "speaker_id", "left")
    return rows.groupBy("code").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_speeches"), F.count("n").alias("n_speakers"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"),
        number(F.sum("s") / F.nullif(F.sum("m"), F.lit(0))).alias("avg_score"), number(F.sum("w") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_words"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_analysed"),
    )


@query(f"""WITH {SPEECHES}, h AS (SELECT speaker_id, stance, count(*) AS n FROM speeches GROUP BY ALL),
 st AS (SELECT speaker_id, array_to_string(list_sort(list(stance || ':' || n)), ',') AS stances FROM h GROUP BY speaker_id),
 a AS (SELECT speaker_id, count(*) AS n, min(speech_date) AS first_date, max(speech_date) AS last_date, avg(word_count) AS w, avg(score) AS s FROM speeches GROUP BY speaker_id)
 SELECT speaker_id, n, first_date, last_date, CASE WHEN w <> 0 THEN round(w, 2) END AS avg_words, CASE WHEN s <> 0 THEN round(s, 3) END AS avg_score, stances FROM a JOIN st USING (speaker_id)""")
def speaker_statistics(spark: SparkSession, sf: str) -> DataFrame:
    base = speeches(spark, sf)
    one = base.groupBy("speaker_id").agg(F.count("*").alias("n"), F.min("speech_date").alias("first_date"), F.max("speech_date").alias("last_date"), F.avg("word_count").alias("w"), F.avg("score").alias("s"))
    kinds = as_map(base.groupBy("speaker_id", "stance").agg(F.count("*").alias("n")), ["speaker_id"], "stance")
    text = F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["stance"], x["n"].cast("string"))), ",")
    return one.join(kinds, "speaker_id").select("speaker_id", "n", "first_date", "last_date", nonzero(F.col("w"), 2).alias("avg_words"), nonzero(F.col("s"), 3).alias("avg_score"), text.alias("stances"))


@query(f"WITH {SPEECHES}, {SPEAKERS} SELECT p.speaker_id, p.name, count(s.id) AS n FROM speakers p LEFT JOIN speeches s ON s.speaker_id = p.speaker_id AND s.status = 'P' GROUP BY ALL HAVING count(s.id) >= 0")
def speakers_by_count_having(spark: SparkSession, sf: str) -> DataFrame:
    per = speeches(spark, sf).where("status = 'P'").groupBy("speaker_id").agg(F.count("*").alias("n"))
    rows = speakers(spark, sf).join(per, "speaker_id", "left").select("speaker_id", "name", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.where("n >= 0").orderBy(F.desc("n"), "speaker_id")


@query(f"WITH {SPEAKERS}, {INSTITUTIONS} SELECT code, country FROM institutions WHERE inst_id IN (SELECT inst_id FROM speakers WHERE speaker_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000))")
def institutions_with_speeches(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 495000").select(F.col("o_custkey").alias("speaker_id"))
    own = speakers(spark, sf).join(big, "speaker_id", "left_semi")
    return institutions(spark, sf).join(own, "inst_id", "left_semi").select("code", "country")


@query(f"WITH {SPEECHES} SELECT count(*) AS total, count(score) AS analysed, round(coalesce(count(score) * 100.0::DOUBLE / nullif(count(*), 0), 0), 6) AS percent_analysed FROM speeches")
def processing_metrics(spark: SparkSession, sf: str) -> DataFrame:
    one = speeches(spark, sf).agg(F.count("*").alias("total"), F.count("score").alias("analysed"))
    return one.withColumn("percent_analysed", number(percent(F.col("analysed"), F.col("total"))))


@query(f"WITH {SPEECHES} SELECT status, count(*) AS n FROM speeches GROUP BY status")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(speeches(spark, sf), "status")


@query("WITH v AS (SELECT unnest(['P', 'F', 'O', 'X']) AS status) SELECT status, count(o_orderkey) AS n FROM v LEFT JOIN orders ON o_orderstatus = status GROUP BY status")
def status_histogram_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return zero_filled(speeches(spark, sf), "status", ["P", "F", "O", "X"])


@query(f"WITH {SPEECHES} SELECT count(*) AS n FROM speeches WHERE status = 'F' AND speech_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def count_by_range(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where((F.col("status") == "F") & F.col("speech_date").between("1996-01-01", "1996-12-31")).agg(F.count("*").alias("n"))


@query(f"""WITH {ANALYSES} SELECT count(*) AS n, round(avg(score), 3) AS mean, round(stddev_samp(score), 3) AS std, min(score) AS low, max(score) AS high FROM analyses""")
def analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).agg(F.count("*").alias("n"), nonzero(F.avg("score"), 3).alias("mean"), nonzero(F.stddev_samp("score"), 3).alias("std"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"WITH {SPEECHES} SELECT stance, count(*) AS n FROM speeches WHERE score IS NOT NULL GROUP BY stance")
def stance_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(speeches(spark, sf).where("score IS NOT NULL"), "stance")


@query("""SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 0.8::DOUBLE WHEN l_discount * 10 >= 0.6 THEN 0.6::DOUBLE WHEN l_discount * 10 >= 0.4 THEN 0.4::DOUBLE WHEN l_discount * 10 >= 0.2 THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS bin, count(*) AS n
 FROM lineitem GROUP BY 1""")
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(bins(F.col("l_discount") * 10, [0.0, 0.2, 0.4, 0.6, 0.8]).alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""WITH {SPEECHES}, e AS (SELECT unnest([-1, -0.5, -0.1, 0, 0.1, 0.5, 1])::DOUBLE AS le) SELECT le, (SELECT count(*) FROM speeches WHERE score <= le) AS n FROM e""")
def sentiment_bucket_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return cumulative_buckets(speeches(spark, sf), "score", [-1.0, -0.5, -0.1, 0.0, 0.1, 0.5, 1.0])


@query(f"WITH {ANALYSES} SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY speech_id ORDER BY ts DESC, version DESC, score DESC, confidence DESC) = 1")
def latest_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per(analyses(spark, sf), "speech_id", ["ts", "version", "score", "confidence"]).select("speech_id", "version", "ts", "score", "confidence")


@query(f"WITH {ANALYSES} SELECT * FROM analyses WHERE version = 2")
def analysis_by_version(spark: SparkSession, sf: str) -> DataFrame:
    return analyses(spark, sf).where("version = 2")


@query(f"WITH {SPEECHES} SELECT speaker_id, id, speech_date, round(avg(score) OVER (PARTITION BY speaker_id ORDER BY speech_date, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS running FROM speeches WHERE score IS NOT NULL")
def speaker_time_series(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("speaker_id").orderBy("speech_date", "id").rowsBetween(-4, 0)
    return speeches(spark, sf).where("score IS NOT NULL").select("speaker_id", "id", "speech_date", number(F.avg("score").over(w)).alias("running"))


@query("""SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / greatest(count(*), 1), 6) AS success_percent, round(avg(value), 6) AS avg_time,
 round(count(*) / greatest(sum(value), 0.001::DOUBLE), 6) AS throughput FROM events GROUP BY event_type""")
def batch_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.count_if(F.col("event_type") != "error")
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), number(ok * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("success_percent"), number(F.avg("value")).alias("avg_time"), number(F.count("*") / F.greatest(F.sum("value"), F.lit(0.001))).alias("throughput")
    )


@query(f"""WITH {SPEAKERS}, {SPEECHES}, {INSTITUTIONS} SELECT code, date_diff('day', max(speech_date), DATE '2002-01-01') AS days_old FROM institutions JOIN speakers USING (inst_id) JOIN speeches USING (speaker_id) GROUP BY code""")
def data_freshness(spark: SparkSession, sf: str) -> DataFrame:
    last = speeches(spark, sf).groupBy("speaker_id").agg(F.max("speech_date").alias("last"))
    rows = last.join(speakers(spark, sf).select("speaker_id", "inst_id"), "speaker_id").join(institutions(spark, sf), "inst_id")
    return rows.groupBy("code").agg(F.datediff(F.lit("2002-01-01").cast("date"), F.max("last")).cast("long").alias("days_old"))


@query("""WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, sum(value) AS t FROM events GROUP BY user_id)
 SELECT user_id, array_to_string(list_filter([CASE WHEN bad * 100.0 > 30 * n THEN 'failures' END, CASE WHEN (n - bad) * 100.0 < 70 * n THEN 'efficiency' END, CASE WHEN t > 600 THEN 'time' END], lambda x: x IS NOT NULL), ',') AS bottlenecks,
 bad * 2 < n AS healthy FROM b""")
def bottleneck_rules(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.sum("value").alias("t"))
    n, bad = F.col("n"), F.col("bad")
    rules = F.array(F.when(bad * 100 > n * 30, F.lit("failures")), F.when((n - bad) * 100 < n * 70, F.lit("efficiency")), F.when(F.col("t") > 600, F.lit("time")))
    return base.select("user_id", F.array_join(F.filter(rules, lambda x: x.isNotNull()), ",").alias("bottlenecks"), (bad * 2 < n).alias("healthy"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, sum(n)::BIGINT AS found, sum(n) FILTER (event_type <> 'error')::BIGINT AS stored FROM p GROUP BY user_id)
 SELECT count(*) AS n_groups, sum(found)::BIGINT AS found, sum(stored)::BIGINT AS stored, round(sum(stored) * 100.0::DOUBLE / greatest(sum(found), 1), 6) AS success_percent FROM u""")
def cross_group_totals(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(F.col("event_type") != "error").alias("stored"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("found").alias("found"), F.sum("stored").alias("stored"), number(F.sum("stored") * 100.0 / F.greatest(F.sum("found"), F.lit(1))).alias("success_percent"))


@query(f"""WITH {SPEAKERS} SELECT a.speaker_id AS a_id, b.speaker_id AS b_id FROM (SELECT *, DATE '1996-01-01' AS s, coalesce(end_date, DATE '1996-03-01') AS e FROM speakers) a
 JOIN (SELECT *, DATE '1996-01-01' + (speaker_id % 60)::INTEGER AS s, DATE '1996-01-20' + (speaker_id % 60)::INTEGER AS e FROM speakers) b ON a.inst_id = b.inst_id AND a.s <= b.e AND a.e >= b.s""")
def date_range_overlap_all(spark: SparkSession, sf: str) -> DataFrame:
    """All speakers of an institution against each other."""
    return _terms_met(speakers(spark, sf))


def _terms_met(own: DataFrame) -> DataFrame:
    """(a_id, b_id): speakers of an institution whose terms overlap."""
    day = lambda d: F.lit(d).cast("date")
    a = own.select(F.col("speaker_id").alias("a_id"), "inst_id", day("1996-01-01").alias("s"), F.coalesce("end_date", day("1996-03-01")).alias("e"))
    move = (F.col("speaker_id") % 60).cast("int")
    b = own.select(F.col("speaker_id").alias("b_id"), "inst_id", F.date_add(day("1996-01-01"), move).alias("s2"), F.date_add(day("1996-01-20"), move).alias("e2"))
    return overlapping(a, b, "inst_id").select("a_id", "b_id")


@query(f"WITH {SPEECHES}, {SPEAKERS}, {INSTITUTIONS} SELECT code, stance, count(*) AS n FROM speeches JOIN speakers USING (speaker_id) JOIN institutions USING (inst_id) GROUP BY ROLLUP (code, stance)")
def rollup_institution_stance(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the finders and reports: subtotals by institution."""
    rows = speeches(spark, sf).join(speakers(spark, sf).select("speaker_id", "inst_id"), "speaker_id").join(institutions(spark, sf), "inst_id")
    return rows.rollup("code", "stance").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, list_cosine_similarity(q.embedding, e.embedding)::DOUBLE AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
 SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 5) DESC, vec_id) <= 5""")
def embedding_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the finders and reports: a stated query set against all vectors; each task keeps the best five of a query."""
    from lectern.operators.vectors import cosine_top_k

    own = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return cosine_top_k(own.where("vec_id % 20 = 0"), own, 5).select("query_id", "vec_id")
