"""Checked dates, urls, names, pages and ordered state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import extraction as ex
from lectern.functions import values as va
from lectern.functions import validation as vd
from lectern.operators.dedup import gathered, title_date_url_dedup
from lectern.operators.people import alias_map, contained, get_or_create
from lectern.operators.runs import remaining, reprocessed
from lectern.operators.state import adaptive_delay, breaker, ema, limited
from lectern.plans.domain import number, table
from lectern.plans.registry import query


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, url LIKE 'https://%' AS is_https, lower(url) LIKE '%.pdf' AS is_pdf, regexp_matches(url, '^https?://[^/?#]+') AS is_valid FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", *(c.alias(k) for k, c in va.url_parts(F.col("url")).items()))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS url_date FROM orders""")
def url_date(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://x.example/name"), stamp, F.lit("a.htm"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://x.example/name_"), stamp, F.lit(".htm"))).otherwise(F.lit("https://x.example/invalid.htm"))
    return table(spark, sf, "orders").select("o_orderkey", va.url_date(url).alias("url_date"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE ELSE o_orderdate::DATE END AS d FROM orders")
def multi_format_date(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("invalid date"))
    return table(spark, sf, "orders").select("o_orderkey", va.parsed_date(text).alias("d"))


@query("SELECT c_custkey, trim(c_name) AS name FROM customer")
def clean_speaker_name(spark: SparkSession, sf: str) -> DataFrame:
    titled = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("Governor ")).otherwise(F.lit("Dr. ")), F.col("c_name"), F.lit(", Board member"))
    return table(spark, sf, "customer").select("c_custkey", va.clean_speaker(titled).alias("name"))


PARTS = "list_distinct(list_filter(string_split({0}, ' '), lambda t: length(replace(t, '.', '')) > 1))"


@query(f"""WITH p AS (SELECT p_partkey AS id, list_sort({PARTS.format('p_name')}) AS t FROM part), g AS (SELECT t, min(id) AS id FROM p WHERE len(t) > 0 GROUP BY t)
 SELECT p.id AS a_id, g.id AS b_id, true AS same FROM p JOIN g ON p.t = g.t
 UNION ALL SELECT least(x.id, y.id), greatest(x.id, y.id), false FROM g x JOIN g y ON x.id < y.id AND len(list_intersect(x.t, y.t)) >= CASE WHEN len(x.t) <= 2 AND len(y.t) <= 2 THEN least(len(x.t), len(y.t)) ELSE 2 END""")
def names_match_all(spark: SparkSession, sf: str) -> DataFrame:
    """All parts against all parts: groups of equal names, and the pairs of groups that match."""
    return va.names_matched(table(spark, sf, "part"), "p_partkey", "p_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'exact' WHEN c_custkey % 3 = 1 THEN 'last_name' END AS source, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS role FROM customer")
def speaker_lookup_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    roles = c.select(F.col("c_name").alias("known"), F.col("c_mktsegment").alias("role"), F.col("c_custkey").alias("ord"))
    k = F.col("c_custkey") % 3
    found = c.select("c_custkey", F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat(F.lit("A. B "), F.lower("c_name"))).otherwise(F.lit("Nobody Known")).alias("name"))
    return va.speaker_cascade(found, roles).select("c_custkey", "source", "role")


@query("""WITH k AS (SELECT DISTINCT lower(regexp_extract(text, '^[\\p{L}]{6,}')) AS w FROM documents), n AS (SELECT w FROM k WHERE w <> '')
 SELECT doc_id, arg_max(w, (length(w), w)) AS longest FROM documents JOIN n ON contains(lower(text), w) GROUP BY doc_id""")
def longest_name_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """The longest of the long words that begin documents, as known names, in every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.select(F.regexp_extract("text", r"^[\p{L}]{6,}", 0).alias("name"))
    return contained(docs, "doc_id", "text", known, "name", longest=True).select("doc_id", F.col("found").alias("longest"))


DATED = """CASE o_orderkey % 4 WHEN 0 THEN 'Given on ' || strftime(o_orderdate, '%-d %B %Y') || ' in 1999' WHEN 1 THEN 'On ' || strftime(o_orderdate, '%B %-d, %Y') || '.' WHEN 2 THEN 'x 2024-13-45 ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'May 2020' END"""


@query(rf"""WITH t AS (SELECT o_orderkey, {DATED} AS s FROM orders) SELECT o_orderkey, coalesce(try_strptime(nullif(regexp_extract(s, '\b(\d{{1,2}} [A-Z][a-z]+ \d{{4}})\b', 1), ''), '%d %B %Y'), try_strptime(nullif(regexp_extract(s, '\b([A-Z][a-z]+ \d{{1,2}}, \d{{4}})\b', 1), ''), '%B %d, %Y'),
 try_strptime(nullif(regexp_extract(s, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), ''), '%Y-%m-%d'))::DATE AS d FROM t""")
def content_date(spark: SparkSession, sf: str) -> DataFrame:
    """The date a text names; the SQL parses the same texts by itself."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.concat(F.lit("Given on "), F.date_format(day, "d MMMM yyyy"), F.lit(" in 1999"))).when(k == 1, F.concat(F.lit("On "), F.date_format(day, "MMMM d, yyyy"), F.lit(".")))
        .when(k == 2, F.concat(F.lit("x 2024-13-45 "), F.date_format(day, "yyyy-MM-dd"))).otherwise(F.lit("May 2020"))
    )
    return table(spark, sf, "orders").select("o_orderkey", va.content_date(text).alias("d"))


FORMS = ("%B %-d, %Y", "%b %-d, %Y", "%-m/%-d/%Y", "%-m-%-d-%Y", "%Y-%-m-%-d", "%B %-d %Y", "%b %-d %Y", "%Y%m%d")
JAVA_FORMS = ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "MMMM d yyyy", "MMM d yyyy", "yyyyMMdd")


@query("WITH t AS (SELECT o_orderkey, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(FORMS)) + " ELSE '15.1.2025' END AS s FROM orders) SELECT o_orderkey, try_strptime(s, ["
       + ", ".join(f"'{f.replace('%-', '%')}'" for f in FORMS) + "])::DATE AS d FROM t")
def eight_date_formats(spark: SparkSession, sf: str) -> DataFrame:
    """All eight formats; the SQL parses the same texts by itself."""
    k, text = F.col("o_orderkey") % 9, F.lit("15.1.2025")
    for i, f in enumerate(JAVA_FORMS):
        text = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", va.parsed_date(text).alias("d"))


@query("""SELECT o_orderkey, round((x + 1) / 2, 6) AS normalized, round(abs(x), 6) AS strength, abs(x) < 0.01 AS is_neutral, x > 0 AS is_positive, x < 0 AS is_negative
 FROM (SELECT o_orderkey, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (o_totalprice - 250000) / 250000)) AS x FROM orders)""")
def scaled_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("o_totalprice") - 250000) / 250000))
    got = va.scaled(x)
    return table(spark, sf, "orders").select("o_orderkey", number(got["normalized"]).alias("normalized"), number(got["strength"]).alias("strength"), *(got[k].alias(k) for k in ("is_neutral", "is_positive", "is_negative")))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'FED:' || o_orderkey || ':20240101' WHEN 1 THEN 'fed:20240101' WHEN 2 THEN 'A' || o_orderkey || ':' || o_orderkey ELSE 'F:longenough' END AS s FROM orders)
 SELECT o_orderkey, CASE WHEN ok THEN code END AS code, CASE WHEN ok THEN uid END AS uid FROM (SELECT o_orderkey, split_part(s, ':', 1) AS code, substr(s, strpos(s, ':') + 1) AS uid,
 regexp_full_match(split_part(s, ':', 1), '[A-Z0-9_]{2,}') AND length(substr(s, strpos(s, ':') + 1)) >= 8 AS ok FROM t)""")
def parsed_ids(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("FED:"), i, F.lit(":20240101"))).when(k == 1, "fed:20240101").when(k == 2, F.concat(F.lit("A"), i, F.lit(":"), i)).otherwise("F:longenough")
    return table(spark, sf, "orders").withColumn("x", va.parsed_id(text)).select("o_orderkey", "x.code", "x.uid")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN (c_acctbal::DECIMAL(28,10) - 0.1::DECIMAL(28,10))::VARCHAR END AS less, (c_acctbal::DECIMAL(19,8) * 3)::DECIMAL(38,10)::VARCHAR AS times, (c_acctbal::DECIMAL(19,8) * 0.25::DECIMAL(18,8))::DECIMAL(38,10)::VARCHAR AS quarter FROM customer""")
def money_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    other, own = F.when(F.col("c_custkey") % 4 == 0, "EUR").otherwise("USD"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", va.money_subtract(own, F.lit("0.1"), F.lit("USD"), other).cast("string").alias("less"), va.money_times(own, F.lit(3)).cast("string").alias("times"), va.money_divided(own, F.lit(4)).cast("string").alias("quarter")
    )


@query("""SELECT o_orderkey, date_trunc('year', o_orderdate)::DATE AS start, (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE AS "end",
 date_diff('day', date_trunc('year', o_orderdate)::DATE, (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR)::DATE)::INTEGER AS days, round((date_diff('day', date_trunc('year', o_orderdate)::DATE, o_orderdate::DATE) + 1) / 7.0::DOUBLE, 6) AS weeks,
 round((date_diff('day', date_trunc('year', o_orderdate)::DATE, o_orderdate::DATE) + 1) / 30.44::DOUBLE, 6) AS months FROM orders""")
def year_ranges(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    length = va.range_lengths(F.trunc(day, "year"), day)
    return table(spark, sf, "orders").withColumn("y", va.year_range(day)).select("o_orderkey", "y.*", number(length["weeks"]).alias("weeks"), number(length["months"]).alias("months"))


@query("""WITH s AS (SELECT c_custkey, 'Person ' || c_name AS name FROM customer), a AS (SELECT DISTINCT unnest([lower(regexp_extract(name, '[^ ]+$')), regexp_replace(lower(name), '[ .]', '', 'g')]) AS alias, c_custkey, name FROM s)
 SELECT alias, array_to_string(list(name ORDER BY c_custkey), '|') AS names FROM a GROUP BY alias""")
def speaker_aliases(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Person "), "c_name").alias("name"))
    return alias_map(people, "name", "c_custkey").select("alias", F.array_join("names", "|").alias("names"))


@query("""WITH people AS (SELECT DISTINCT c_name AS name, c_mktsegment AS role FROM customer), stored AS (SELECT c_custkey AS speaker_id, 'Sir ' || c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY'),
 found AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Nobody' ELSE upper(c_name) END AS name FROM orders JOIN customer ON o_custkey = c_custkey),
 w AS (SELECT DISTINCT p.name FROM found f JOIN people p ON lower(p.name) = lower(f.name)), old AS (SELECT w.name, arg_min(s.speaker_id, (s.name, s.speaker_id)) AS speaker_id FROM w JOIN stored s ON s.name = 'Sir ' || w.name GROUP BY w.name),
 made AS (SELECT name, (SELECT max(speaker_id) FROM stored) + row_number() OVER (ORDER BY name) AS speaker_id FROM w ANTI JOIN old USING (name))
 SELECT o_orderkey, found.name, speaker_id FROM found LEFT JOIN (SELECT * FROM old UNION ALL SELECT * FROM made) x ON lower(found.name) = lower(x.name)""")
def speaker_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    people = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    stored = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("speaker_id"), F.concat(F.lit("Sir "), "c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    found = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "Nobody").otherwise(F.upper("c_name")).alias("name"))
    return get_or_create(found, people, stored)[0].select("o_orderkey", "name", "speaker_id")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'jane doe' WHEN 1 THEN 'mary ann' ELSE 'events' END AS name FROM orders""")
def path_speaker(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest name of three shapes of paths."""
    k, i = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://x.example/news/speech-by-jane-doe"), F.lit("?id="), i)).when(k == 1, F.lit("https://x.example/2024/mary-ann.pdf")).otherwise(F.concat(F.lit("https://x.example/events/"), i))
    return table(spark, sf, "orders").select("o_orderkey", F.get(va.path_names(url), F.lit(0)).alias("name"))


@query("""SELECT page_id, length(trim(regexp_replace(html, '\\s+', ' ', 'g'))) >= 100 AND NOT contains(lower(html), 'lorem ipsum') AND NOT contains(lower(html), 'page not found') AND NOT contains(lower(html), 'placeholder') AND url LIKE 'https%' AS ok FROM pages""")
def storable_records(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("url").startswith("https"), F.col("url"))
    return table(spark, sf, "pages").select("page_id", vd.record_ok(F.col("html"), F.lit("A title"), F.lit("x"), F.lit("2024-01-01"), url).alias("ok"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'undated' END AS d FROM orders) SELECT o_orderkey FROM t WHERE coalesce(try_cast(substr(d, 1, 4) AS INTEGER) >= 1996, true)""")
def since_year(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, "undated")
    return table(spark, sf, "orders").where(va.from_year(text, 1996)).select("o_orderkey")


@query()
def url_title_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in order, refused where a kept one has the url (the customer's) or the title and date (clerk-like key and day); beyond SQL."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("https://x.example/"), F.col("o_custkey").cast("string")).alias("url"), F.concat(F.lit("Title "), F.col("o_orderkey") % 50).alias("title"), F.to_date("o_orderdate").alias("date"))
    return title_date_url_dedup(o, ["o_orderkey"]).select("o_orderkey")


@query("""WITH u AS (SELECT o_orderkey AS id, o_custkey AS k, NULL::VARCHAR AS part FROM orders UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_partkey, 'line' FROM lineitem) SELECT k, min(id) AS id FROM u GROUP BY k""")
def sources_gathered(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources with different columns, the first row of each key."""
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    b = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_partkey").alias("k"), F.lit("line").alias("part"))
    return gathered([a, b], ["k"], ["id"]).select("k", "id")


@query("""SELECT o_orderkey AS page_id, 'https://x.example/' || CASE o_orderkey % 2 WHEN 0 THEN 'powell' || strftime(o_orderdate, '%Y%m%d') || 'a.htm' ELSE 'talk.htm' END AS link, 'Talk ' || o_orderkey AS title,
 CASE o_orderkey % 2 WHEN 0 THEN 'powell' ELSE 'Ann' END AS speaker, o_orderdate::DATE AS speech_date FROM orders WHERE length('Talk ' || o_orderkey) >= 5""")
def page_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Links of listings with title, speaker and date, from the link and from what is around it; a page of two links for each order."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey").cast("string")
    dated = F.concat(F.lit('<li><a href="/powell'), F.date_format(day, "yyyyMMdd"), F.lit('a.htm">Talk '), key, F.lit("</a></li>"))
    beside = F.concat(F.lit('<li><a href="talk.htm">Talk '), key, F.lit("</a> <i>By Ann</i>, "), F.date_format(day, "MMMM d, yyyy"), F.lit("</li>"))
    html = F.concat(F.lit("<html><body><ul>"), F.when(F.col("o_orderkey") % 2 == 0, dated).otherwise(beside), F.lit('</ul><a href="x">more</a></body></html>'))
    return ex.listing(table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://x.example/list").alias("url"), html.alias("html")))


@query()
def page_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Every page by the profiles of all kinds of sites; beyond SQL."""
    pages, out = table(spark, sf, "pages"), None
    for name in ex.PROFILES:
        part = ex.extracted(pages, name).withColumn("profile", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_work(spark: SparkSession, sf: str) -> DataFrame:
    """What a run that has done the labelled documents has left to do."""
    docs = table(spark, sf, "documents")
    return remaining(docs, table(spark, sf, "labels"), ["doc_id"]).select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'validated' ELSE o_orderstatus END AS status FROM orders")
def failed_again(spark: SparkSession, sf: str) -> DataFrame:
    """Failed rows done again; those the step refuses stay failed."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    return reprocessed(rows, "o_orderkey", "status", lambda d: d.where("o_totalprice > 100000").withColumn("status", F.lit("validated")), "F").select("o_orderkey", "status")


@query()
def burst_limit_fold(spark: SparkSession, sf: str) -> DataFrame:
    """When each request goes out under a burst window and an adaptive delay; beyond SQL."""
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 429).otherwise(200)
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), code.alias("code"))
    return limited(e, ["user_id"], "event_id", "t", "code", rate=0.01)


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '')) AS title FROM pages""")
def html_title_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", ex.title(F.col("html")).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def html_links_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(ex.links(F.col("html"))).alias("link"))


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), lambda p: length(p) > 20), chr(10)) AS body FROM pages""")
def html_paragraph_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_join(ex.paragraphs(F.col("html"), 20), "\n").alias("body"))


@query()
def page_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The tag parser; beyond SQL."""
    return ex.extracted(table(spark, sf, "pages"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 3 AND NOT regexp_matches(s, '^\d+$') AND NOT regexp_matches(s, '^[^\p{L}\p{N}]+$')), lambda s: regexp_replace(s, '[ \t]+', ' ', 'g')), chr(10))) AS clean FROM documents""")
def line_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(ex.clean_lines(F.col("text"), 3, [r"^\d+$", r"^[^\p{L}\p{N}]+$"])).alias("clean"))


GROUPS = {"rates": ["tion", "rate"], "prices": ["heit", "price"], "growth": ["ment"]}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in GROUPS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def content_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(ex.tags(F.col("text"), GROUPS), ",").alias("tags"))


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def event_recent_topk(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id", "ts", "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), r AS (SELECT user_id, n, value * 0.1::DOUBLE AS x FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, r.x * 0.9::DOUBLE + e.value * 0.1::DOUBLE FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, round(arg_max(x, n), 6) AS ema FROM r GROUP BY user_id""")
def ema_processing_time(spark: SparkSession, sf: str) -> DataFrame:
    return ema(table(spark, sf, "events"), ["user_id"], "ts", "value").select("user_id", number(F.col("ema")).alias("ema"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type <> 'error' AND event_type <> 'view' AS ok, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 r AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 'closed' AS state, 0 AS bad, 0 AS good, 0::DOUBLE AS since, true AS passed FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, n, event_id, CASE WHEN NOT passed THEN 'open' WHEN NOT ok AND bad >= 5 THEN 'open' WHEN ok AND st = 'half_open' AND good >= 3 THEN 'closed' ELSE st END, bad, good,
   CASE WHEN passed AND NOT ok AND bad >= 5 THEN t ELSE since END, passed FROM (
    SELECT user_id, n, event_id, ok, t, st, since, passed, CASE WHEN NOT passed THEN bad0 WHEN ok THEN CASE WHEN st = 'half_open' AND good0 + 1 < 3 THEN bad0 ELSE 0 END ELSE bad0 + 1 END AS bad,
     CASE WHEN passed AND ok AND st = 'half_open' THEN good0 + 1 WHEN passed AND NOT ok THEN 0 ELSE good0 END AS good FROM (
      SELECT e.user_id, e.n, e.event_id, e.ok, e.t, r.since, r.bad AS bad0, CASE WHEN r.state = 'open' AND e.t - r.since >= 60 THEN 'half_open' ELSE r.state END AS st,
       NOT (r.state = 'open' AND e.t - r.since < 60) AS passed, CASE WHEN r.state = 'open' AND e.t - r.since >= 60 THEN 0 ELSE r.good END AS good0 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
 SELECT user_id, event_id, state, passed FROM r WHERE n > 0""")
def circuit_breaker_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", ((F.col("event_type") != "error") & (F.col("event_type") != "view")).alias("ok"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return breaker(e, ["user_id"], "event_id", "ok", "t").select("user_id", "event_id", "state", "passed")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 429 ELSE 200 END AS code, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 r AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 1::DOUBLE AS delay FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT e.user_id, e.n, e.event_id, greatest(1::DOUBLE, least(300::DOUBLE, delay * CASE WHEN code = 429 THEN 1.5::DOUBLE WHEN code >= 500 THEN 1.2::DOUBLE ELSE 0.95::DOUBLE END)) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, event_id, floor(delay * 1000)::BIGINT AS delay FROM r WHERE n > 0""")
def rate_limit_fold(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 429).otherwise(200)
    e = table(spark, sf, "events").select("user_id", "event_id", code.alias("code"))
    return adaptive_delay(e, ["user_id"], "event_id", "code").select("user_id", "event_id", F.floor(F.col("delay") * 1000).cast("long").alias("delay"))


@query("""SELECT p_partkey, p_size % 3 AS major, p_size % 5 AS minor, p_size % 7 AS patch, CASE WHEN p_size % 2 = 0 THEN 'rc.1' ELSE '~' END AS pre FROM part""")
def semver_order(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_size")
    text = F.concat(F.concat_ws(".", *((p % k).cast("string") for k in (3, 5, 7))), F.when(p % 2 == 0, "-rc.1").otherwise(""))
    return table(spark, sf, "part").withColumn("v", va.semver(text)).select("p_partkey", "v.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN (c_acctbal::DECIMAL(28,10) + 0.1::DECIMAL(28,10))::DECIMAL(38,10)::VARCHAR END AS total FROM customer")
def money_decimal(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("c_custkey") % 4 == 0, "EUR").otherwise("USD")
    return table(spark, sf, "customer").select("c_custkey", va.money_add(F.col("c_acctbal"), F.lit("0.1"), F.lit("USD"), other).cast("string").alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 >= 0.9 THEN 'very_high' WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.5 THEN 'medium' WHEN l_discount * 10 >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM lineitem")
def confidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", va.confidence_level(F.col("l_discount") * 10).alias("level"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS start, last_day(o_orderdate)::DATE AS \"end\", (date_diff('day', date_trunc('month', o_orderdate)::DATE, last_day(o_orderdate)::DATE) + 1)::INTEGER AS days FROM orders")
def month_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("m", va.month_range(F.to_date("o_orderdate"))).select("o_orderkey", "m.*")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the reports: event-time windows, the batch form of the stream in ``lectern.streaming``."""
    from lectern.streaming.events import tumbling

    return tumbling(table(spark, sf, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", number(F.col("total")).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
 SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.streaming.events import sessions

    return sessions(table(spark, sf, "events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def lda_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The three likeliest of ten topics of each document above .05, fitted on the corpus; rows only."""
    from lectern.operators.topics import lda

    return lda(table(spark, sf, "documents").select("doc_id", "text"))
