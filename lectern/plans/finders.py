"""Checked finder and predicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import finders as find
from lectern.operators import specs as s
from lectern.operators.dedup import first_per, new_only
from lectern.plans.domain import INSTITUTIONS, SPEAKERS, SPEECHES, institutions, number, speakers, speeches, table
from lectern.plans.registry import query

ROW = ["id", "speaker_id", "status", "speech_date", "stance"]
SQL_ROW = "id, speaker_id, status, speech_date, stance"


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE id = 7")
def find_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), {"id": 7}).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE url = 'https://bank.example/speech/12'")
def find_by_url(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), {"url": "https://bank.example/speech/12"}).select(*ROW)


@query("SELECT doc_id, lang FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 3)")
def find_by_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    wanted = docs.where("doc_id = 3").select(F.sha2("text", 256).alias("h")).scalar()
    return docs.where(F.sha2("text", 256) == wanted).select("doc_id", "lang")


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE speaker_id = 1 ORDER BY speech_date DESC NULLS FIRST, id LIMIT 5")
def find_by_speaker_topk(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), {"speaker_id": 1}, limit=5).select(*ROW)


@query(f"WITH {SPEECHES}, {SPEAKERS} SELECT {SQL_ROW}, name FROM speeches JOIN speakers USING (speaker_id) WHERE name ILIKE '%mer#000000_1%' ORDER BY speech_date DESC NULLS FIRST, id LIMIT 50")
def find_by_name_ilike(spark: SparkSession, sf: str) -> DataFrame:
    return find.by_speaker_name(speeches(spark, sf), speakers(spark, sf), "mer#000000_1", 50).select(*ROW, "name")


@query(f"WITH {SPEECHES}, {SPEAKERS}, {INSTITUTIONS} SELECT {SQL_ROW}, code FROM speeches JOIN speakers USING (speaker_id) JOIN institutions USING (inst_id) WHERE inst_id = 3 ORDER BY speech_date DESC NULLS FIRST, id LIMIT 20")
def find_by_institution(spark: SparkSession, sf: str) -> DataFrame:
    inst = institutions(spark, sf).where("inst_id = 3")
    own = speakers(spark, sf).select("speaker_id", "inst_id").join(inst, "inst_id")
    return find.newest(speeches(spark, sf).join(own, "speaker_id"), limit=20).select(*ROW, "code")


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE speech_date BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'")
def find_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), F.col("speech_date").between("1996-01-01", "1996-02-15")).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE status = 'P' ORDER BY speech_date DESC NULLS FIRST, id LIMIT 100")
def find_status(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), {"status": "P"}, limit=100).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE stance = '1-URGENT' AND speech_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def find_stance_range(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), (F.col("stance") == "1-URGENT") & F.col("speech_date").between("1997-01-01", "1997-06-30")).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW}, round(score, 6) AS score FROM speeches WHERE score BETWEEN 0.2 AND 0.5")
def find_score_range(spark: SparkSession, sf: str) -> DataFrame:
    return find.find_by(speeches(spark, sf), F.col("score").isNotNull() & F.col("score").between(0.2, 0.5)).select(*ROW, number(F.col("score")).alias("score"))


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE score IS NULL AND url <> '' ORDER BY speech_date ASC NULLS LAST, id LIMIT 100")
def unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    return find.unprocessed(speeches(spark, sf), 100).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches ORDER BY speech_date ASC NULLS LAST, id LIMIT 100 OFFSET 200")
def page_of_speeches(spark: SparkSession, sf: str) -> DataFrame:
    return find.page(speeches(spark, sf), 2).select(*ROW)


@query(f"WITH {SPEECHES}, {SPEAKERS} SELECT speaker_id, name FROM speakers WHERE EXISTS (SELECT 1 FROM speeches s WHERE s.speaker_id = speakers.speaker_id AND status = 'P')")
def exists_semi(spark: SparkSession, sf: str) -> DataFrame:
    return speakers(spark, sf).join(speeches(spark, sf).where("status = 'P'"), "speaker_id", "left_semi").select("speaker_id", "name")


@query(f"WITH {SPEECHES} SELECT id, url FROM speeches WHERE url NOT IN (SELECT url FROM speeches WHERE status = 'F')")
def new_urls_anti(spark: SparkSession, sf: str) -> DataFrame:
    own = speeches(spark, sf).select("id", "url", "status")
    return new_only(own, own.where("status = 'F'"), "url").select("id", "url")


TRIGRAMS_SQL = r"list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH {SPEAKERS}, g AS (SELECT speaker_id, name, {TRIGRAMS_SQL.format("name")} AS x, {TRIGRAMS_SQL.format("'Customer#000000012'")} AS y FROM speakers),
 s AS (SELECT speaker_id, name, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS sim FROM g)
 SELECT speaker_id, name, round(sim, 6) AS similarity FROM s WHERE name ILIKE '%Customer#000000012%' OR sim > 0.7""")
def speaker_fuzzy_trigram(spark: SparkSession, sf: str) -> DataFrame:
    return find.fuzzy_name(speakers(spark, sf), "Customer#000000012", 0.7).select("speaker_id", "name", number(F.col("similarity")).alias("similarity"))


@query(f"WITH {SPEAKERS} SELECT speaker_id, name, role FROM speakers WHERE list_contains(alternate_names, 'MACHINERY 8') OR array_to_string(alternate_names, ' ') ILIKE '%MACHINERY 8%'")
def speaker_alt_names(spark: SparkSession, sf: str) -> DataFrame:
    return find.by_alternate_name(speakers(spark, sf), "MACHINERY 8").select("speaker_id", "name", "role")


@query(f"WITH {SPEAKERS} SELECT speaker_id, name, end_date FROM speakers WHERE end_date IS NULL OR end_date >= DATE '2000-01-01'")
def current_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return find.current(speakers(spark, sf), "2000-01-01").select("speaker_id", "name", "end_date")


@query(f"WITH {SPEAKERS} SELECT speaker_id, name FROM speakers WHERE voting_member AND role ILIKE '%build%'")
def voting_members(spark: SparkSession, sf: str) -> DataFrame:
    return find.by_name(speakers(spark, sf).where(F.col("voting_member") & F.col("role").ilike("%build%"))).select("speaker_id", "name")


@query(f"WITH {INSTITUTIONS} SELECT code, country, inst_type FROM institutions WHERE country ILIKE '%a%' AND inst_type = 'international'")
def institutions_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return find.by_name(institutions(spark, sf).where(F.col("country").ilike("%a%") & (F.col("inst_type") == "international")), "code").select("code", "country", "inst_type")


@query(f"""WITH {SPEECHES}, {SPEAKERS} SELECT {SQL_ROW} FROM speeches JOIN speakers USING (speaker_id)
 WHERE (coalesce(stance = '2-HIGH', false) AND coalesce(score BETWEEN -0.5 AND 0.9, false) OR contains(lower(name), '0007')) AND NOT coalesce(score > 0.5, false)""")
def spec_and_or_not(spark: SparkSession, sf: str) -> DataFrame:
    spec = ((s.stance("2-HIGH") & s.score_range(-0.5, 0.9)) | s.speaker_name("0007")) & ~s.Spec(F.coalesce(F.col("score") > 0.5, F.lit(False)))
    return speeches(spark, sf).join(speakers(spark, sf).select("speaker_id", "name"), "speaker_id").where(spec.column).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE len(list_filter(tags, lambda t: contains(t, 'urg'))) > 0 AND word_count BETWEEN 100 AND 900")
def spec_tag_contains(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where((s.tag("URG") & s.word_count(100, 900)).column).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE speech_date >= DATE '2001-08-01' - 30 AND NOT coalesce(status = 'P', false)")
def spec_recent(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where((s.recent(30, "2001-08-01") & ~s.status("P")).column).select(*ROW)


@query(f"WITH {SPEECHES} SELECT {SQL_ROW} FROM speeches WHERE score IS NOT NULL AND stance = '5-LOW' AND speech_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def spec_presets(spark: SparkSession, sf: str) -> DataFrame:
    return speeches(spark, sf).where((s.analysed() & s.stance("5-LOW") & s.date_range("1998-01-01", "1998-12-31")).column).select(*ROW)


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def dedup_url_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return first_per(docs, ["lang", "source"], ["doc_id"]).select("lang", "source", "doc_id")


@query("SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def dedup_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {SPEAKERS} SELECT speaker_id, end_date IS NULL OR end_date >= DATE '2000-01-01' AS is_current, name || ' (' || role || ')' AS display_name,
 round(date_diff('day', DATE '1990-01-01', coalesce(end_date, DATE '2000-01-01')) / 365.25::DOUBLE, 6) AS tenure_years FROM speakers""")
def derived_properties(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2000-01-01").cast("date")
    days = F.datediff(F.coalesce("end_date", as_of), F.lit("1990-01-01").cast("date"))
    return speakers(spark, sf).select(
        "speaker_id", (F.col("end_date").isNull() | (F.col("end_date") >= as_of)).alias("is_current"), F.concat("name", F.lit(" ("), "role", F.lit(")")).alias("display_name"), number(days / 365.25).alias("tenure_years")
    )


@query("SELECT doc_id, list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'that') AS found FROM documents")
def full_text_search(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.functions.text import search_tokens

    return table(spark, sf, "documents").select("doc_id", F.array_contains(search_tokens(F.col("text")), "that").alias("found"))
