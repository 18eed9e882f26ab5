"""Checked text measures, scores and validators, on the fixture lexicon and phrase families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scoring as sc
from lectern.functions import text as tx
from lectern.functions import validation as va
from lectern.functions.lexicons import FIXTURE_LEXICON, FIXTURE_MODIFIERS, FIXTURE_STANCES, FIXTURE_TOPICS, FIXTURE_UNCERTAINTY, UNCERTAINTY_WEIGHTS, weight_map
from lectern.operators.state import smoothed
from lectern.plans.domain import number, table
from lectern.plans.registry import query

LEX = ", ".join(f"'{w}': {p * k:.2f}" for w, (p, k) in FIXTURE_LEXICON.items())
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
SPACED = r"CASE WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END"


def cnt(words: list[str], t: str = "low") -> str:
    return "(" + " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) // {len(w)}" for w in words) + ")"


#: Parts of a text, as ``with_text_parts`` makes them, and its lexicon hits.
PARTS = f"""parts AS (SELECT doc_id, text, lower(text) AS low, {TOK} AS toks, len({TOK})::BIGINT AS n_tokens, ({SPACED})::BIGINT AS n_words, len({SENT})::BIGINT AS n_sentences FROM documents),
 lex AS (SELECT MAP {{{LEX}}} AS m), hits AS (SELECT parts.*, list_filter(list_transform(toks, lambda t: {{'word': t, 'value': m[t]::DOUBLE}}), lambda h: h.value IS NOT NULL) AS hit FROM parts, lex)
 """
SUM = "coalesce(list_sum(list_transform({0}, lambda h: h.value)), 0)"
RAW = f"CASE WHEN len(hit) > 0 THEN {SUM.format('hit')} / sqrt(n_tokens) ELSE 0 END"
CLIP = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {0}))"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return sc.with_text_parts(table(spark, sf, "documents").select("doc_id", "text"))


def hit_docs(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).withColumn("hit", sc.hits(F.col("toks"), weight_map(FIXTURE_LEXICON)))


def lexicon_score() -> Column:
    return sc.clipped(sc.raw_lexicon_score(F.col("hit"), F.col("n_tokens")))


@query(f"WITH {PARTS} SELECT doc_id, n_tokens, len(list_distinct(toks))::BIGINT AS n_types FROM parts")
def tokens_count(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_types"))


@query(f"WITH {PARTS} SELECT doc_id, n_sentences, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length(s) > 10))::BIGINT AS n_raw FROM parts")
def sentence_count(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.size(tx.raw_sentences(F.col("text"))).cast("long").alias("n_raw"))


@query(rf"""WITH {PARTS} SELECT doc_id, length(text) AS n_chars, n_words, n_sentences, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '\s+', '', 'g') <> ''))::BIGINT AS n_paragraphs,
 round(coalesce(n_words::DOUBLE / nullif(n_sentences, 0), 0), 6) AS words_per_sentence, n_words > 500 AS is_substantial, n_words < 100 AS is_short,
 CASE WHEN coalesce(n_words::DOUBLE / nullif(n_sentences, 0), 0) < 15 THEN 'simple' WHEN coalesce(n_words::DOUBLE / nullif(n_sentences, 0), 0) < 25 THEN 'moderate' ELSE 'complex' END AS complexity_level FROM parts""")
def text_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = tx.statistics(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *((v.cast("long") if k.startswith("n_") else v).alias(k) for k, v in stats.items()))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md, left(sha256(text), 8) AS short, length(text) AS n FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.md5(t).alias("md"), F.left(F.sha2(t, 256), F.lit(8)).alias("short"), F.length(t).cast("long").alias("n"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean, md5(array_to_string(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:12], ' ')) AS head FROM documents")
def whitespace_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.collapsed(F.col("text"))).alias("clean"), F.md5(tx.first_words(F.col("text"), 12)).alias("head"))


@query(f"WITH {PARTS}, s AS (SELECT doc_id, n_tokens, len(hit)::BIGINT AS n_hits, {CLIP.format(RAW)} AS x FROM hits) SELECT doc_id, n_tokens, n_hits, round(x, 6) AS score, CASE WHEN x <= -0.05 THEN 'hawkish' WHEN x >= 0.05 THEN 'dovish' ELSE 'neutral' END AS stance FROM s")
def lexicon_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = hit_docs(spark, sf).withColumn("x", lexicon_score())
    return x.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.size("hit").cast("long").alias("n_hits"), number(F.col("x")).alias("score"), sc.label(F.col("x")).alias("stance"))


UP, DOWN = SUM.format("list_filter(hit, lambda h: h.value > 0)"), "-" + SUM.format("list_filter(hit, lambda h: h.value < 0)")


@query(f"""WITH {PARTS} SELECT doc_id, round(CASE WHEN n_tokens > 0 THEN least(1.0, least(1.0, len(hit)::DOUBLE / n_tokens * 3) * 0.4 + coalesce(abs({UP} - ({DOWN})) / nullif({UP} + ({DOWN}), 0), 0) * 0.3
 + least(1.0, n_tokens / 100.0) * 0.2 + least(1.0, n_sentences / 10.0) * 0.1) ELSE 0 END, 6)::DOUBLE AS confidence FROM hits""")
def lexicon_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return hit_docs(spark, sf).select("doc_id", number(sc.lexicon_confidence(F.col("hit"), F.col("n_tokens"), F.col("n_sentences"))).alias("confidence"))


ADJUST = CLIP.format(RAW)
for _family, _most, _each, _sign in (("negations", 0.8, 0.2, "-"), ("hedging", 0.5, 0.1, "-"), ("intensifiers", 0.3, 0.1, "+"), ("forward_guidance", 0.2, 0.05, "+"), ("backward_looking", 0.3, 0.05, "-")):
    ADJUST = f"({ADJUST}) * (1 {_sign} least({_most}::DOUBLE, {cnt(FIXTURE_MODIFIERS[_family])} * {_each}::DOUBLE))"


@query(f"WITH {PARTS} SELECT doc_id, round({CLIP.format(ADJUST)}, 6) AS score FROM hits")
def context_adjusted_score(spark: SparkSession, sf: str) -> DataFrame:
    return hit_docs(spark, sf).select("doc_id", number(sc.adjusted(lexicon_score(), F.col("low"), FIXTURE_MODIFIERS)).alias("score"))


@query(f"""WITH {PARTS}, p AS (SELECT doc_id, unnest(hit) AS h, generate_subscripts(hit, 1) AS i FROM hits), r AS (SELECT doc_id, h.word AS w, h.value AS v, i, row_number() OVER (PARTITION BY doc_id ORDER BY abs(h.value) DESC, i) AS n FROM p)
 SELECT doc_id, array_to_string(list(w ORDER BY n), ',') AS words FROM r WHERE n <= 10 GROUP BY doc_id""")
def contributing_words_top10(spark: SparkSession, sf: str) -> DataFrame:
    return hit_docs(spark, sf).where(F.size("hit") > 0).select("doc_id", F.array_join(F.transform(sc.top_words(F.col("hit")), lambda h: h["word"]), ",").alias("words"))


@query(f"WITH {PARTS} SELECT doc_id, " + ", ".join(f"{cnt(p)}::BIGINT AS {k}" for k, p in FIXTURE_MODIFIERS.items()) + " FROM parts")
def modifier_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = sc.modifier_counts(F.col("low"), FIXTURE_MODIFIERS)
    return docs(spark, sf).withColumn("m", m).select("doc_id", *(F.col("m")[k].alias(k) for k in FIXTURE_MODIFIERS))


@query("""WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, 'm' || l_linenumber AS method, l_discount * 20 - 1 AS score, l_tax * 7 + 0.0137 AS confidence FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_discount, l_tax) = 1),
 a AS (SELECT doc_id, count(*) AS n, avg(score) AS mean_score, median(score)::DOUBLE AS median_score, stddev_pop(score) AS std_score, sum(score * confidence) / (sum(confidence) + 1e-8) AS weighted, avg(confidence) AS base,
  arg_max(method, (confidence, -ord)) AS dominant_method FROM m GROUP BY doc_id),
 b AS (SELECT *, least(1.0, base + CASE WHEN n > 1 THEN greatest(0.0, 0.2 - std_score) ELSE 0 END) AS c FROM a), d AS (SELECT *, CASE WHEN c > 0.3 THEN weighted ELSE mean_score END AS f FROM b)
 SELECT doc_id, n, round(mean_score, 5) AS mean_score, round(median_score, 5) AS median_score, round(std_score, 5) AS std_score, round(c, 5) AS confidence_score, round(f, 5) AS final_score, dominant_method FROM d""")
def method_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min(F.struct("l_discount", "l_tax")).alias("x"))
    rows = li.select("doc_id", "ord", F.concat(F.lit("m"), F.col("ord").cast("string")).alias("method"), (F.col("x.l_discount") * 20 - 1).alias("score"), (F.col("x.l_tax") * 7 + 0.0137).alias("confidence"))
    out = sc.ensemble(rows)
    return out.select("doc_id", "n", *(F.round(c, 5).alias(c) for c in ("mean_score", "median_score", "std_score", "confidence_score", "final_score")), "dominant_method")


UNC = "(" + " + ".join(f"{cnt(w)} * {UNCERTAINTY_WEIGHTS[k]}::DOUBLE" for k, w in FIXTURE_UNCERTAINTY.items()) + ")"


@query(f"WITH {PARTS}, u AS (SELECT doc_id, CASE WHEN n_tokens > 0 THEN least(1.0::DOUBLE, {UNC} / n_tokens * 100) ELSE 0 END AS x FROM parts) SELECT doc_id, round(x, 6) AS score, CASE WHEN x >= 0.7 THEN 'High' WHEN x >= 0.4 THEN 'Medium' ELSE 'Low' END AS level FROM u")
def uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    x = docs(spark, sf).withColumn("x", sc.uncertainty(F.col("low"), F.col("n_tokens"), FIXTURE_UNCERTAINTY, UNCERTAINTY_WEIGHTS))
    return x.select("doc_id", number(F.col("x")).alias("score"), sc.uncertainty_level(F.col("x")).alias("level"))


ALL_UNCERTAIN = [w for k in FIXTURE_UNCERTAINTY.values() for w in k]


@query("SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in ALL_UNCERTAIN) + "], lambda w: w IS NOT NULL)), ',') AS found FROM documents")
def uncertainty_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.array_join(sc.present(F.col("low"), ALL_UNCERTAIN), ",").alias("found"))


STANCE = {k: f"CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, {cnt(p)}::DOUBLE / n_words * 100) ELSE 0 END" for k, p in FIXTURE_STANCES.items()}


@query(f"WITH {PARTS}, d AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in STANCE.items()) + " FROM parts), g AS (SELECT *, greatest(" + ", ".join(STANCE) + ") AS best FROM d) SELECT doc_id, CASE "
       + " ".join(f"WHEN {k} = best THEN '{k}'" for k in STANCE) + " END AS dominant, round(best, 6) AS strength, " + ", ".join(f"round({k}, 6) AS {k}" for k in STANCE) + " FROM g")
def stance_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    scores = sc.stance_scores(F.col("low"), F.col("n_words"), FIXTURE_STANCES)
    rows = docs(spark, sf).withColumns(scores)
    named = {k: F.col(k) for k in scores}
    return rows.select("doc_id", sc.first_largest(named).alias("dominant"), number(F.greatest(*named.values())).alias("strength"), *(number(c).alias(k) for k, c in named.items()))


TOPIC = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{p}')" for p in ps) + f" THEN '{k}' END" for k, ps in FIXTURE_TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {PARTS}, t AS (SELECT doc_id, n_words, {TOPIC} AS f FROM parts) SELECT doc_id, array_to_string(f, ',') AS topics, CASE WHEN len(f) = 0 THEN 0.0 WHEN n_words < 100 THEN 0.4 WHEN n_words < 500 THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence FROM t")
def keyword_topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).withColumn("f", sc.topics(F.col("low"), FIXTURE_TOPICS))
    return rows.select("doc_id", F.array_join("f", ",").alias("topics"), sc.topic_confidence(F.col("f"), F.col("n_words")).alias("confidence"))


SYL = "list_sum(list_transform(toks, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' THEN 1 ELSE 0 END)))"
READ = f"CASE WHEN n_tokens > 0 AND n_sentences > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (100 - (206.835::DOUBLE - 1.015::DOUBLE * (n_tokens::DOUBLE / n_sentences) - 84.6::DOUBLE * ({SYL}::DOUBLE / n_tokens))) / 100)) ELSE 0.5 END"


@query(f"WITH {PARTS} SELECT doc_id, round({READ}, 6)::DOUBLE AS readability FROM parts")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", number(sc.readability(F.col("toks"), F.col("n_sentences"))).alias("readability"))


@query(f"""WITH {PARTS}, c AS (SELECT doc_id, {READ} AS r, coalesce(n_tokens::DOUBLE / nullif(n_sentences, 0), 0) AS asl, coalesce(len(list_distinct(toks))::DOUBLE / nullif(n_tokens, 0), 0) AS ttr FROM parts)
 SELECT doc_id, round(asl, 6) AS sentence_length, round(ttr, 6) AS type_token_ratio, round(r * 0.4::DOUBLE + least(1.0::DOUBLE, asl / 30) * 0.3::DOUBLE + ttr * 0.3::DOUBLE, 6) AS complexity FROM c""")
def complexity(spark: SparkSession, sf: str) -> DataFrame:
    asl = F.coalesce(F.col("n_tokens") / F.nullif(F.col("n_sentences"), F.lit(0)), F.lit(0.0))
    rows = docs(spark, sf).withColumns({"r": sc.readability(F.col("toks"), F.col("n_sentences")), "asl": asl, "ttr": sc.type_token_ratio(F.col("toks"))})
    return rows.select("doc_id", number(F.col("asl")).alias("sentence_length"), number(F.col("ttr")).alias("type_token_ratio"), number(sc.complexity(F.col("r"), F.col("asl"), F.col("ttr"))).alias("complexity"))


@query(f"""WITH {PARTS}, x AS (SELECT doc_id, {CLIP.format(RAW)} AS s, CASE WHEN n_tokens > 0 THEN least(1.0::DOUBLE, {UNC} / n_tokens * 100) ELSE 0 END AS u, {TOPIC} AS f, n_words, {READ} AS r FROM hits)
 SELECT doc_id, round(s, 6) AS score, CASE WHEN s <= -0.05 THEN 'hawkish' WHEN s >= 0.05 THEN 'dovish' ELSE 'neutral' END AS stance, round(u, 6) AS uncertainty, array_to_string(f[1:10], ',') AS topics, round(r, 6)::DOUBLE AS readability,
 round((0.65::DOUBLE + CASE WHEN len(f) = 0 THEN 0.0 WHEN n_words < 100 THEN 0.4 WHEN n_words < 500 THEN 0.6 ELSE 0.8 END::DOUBLE + 0.75::DOUBLE) / 3, 6) AS confidence FROM x""")
def pipeline_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """All processors of the default pipeline on each document, lexicon only, and their mean confidence."""
    rows = hit_docs(spark, sf).withColumns(
        {"s": lexicon_score(), "u": sc.uncertainty(F.col("low"), F.col("n_tokens"), FIXTURE_UNCERTAINTY, UNCERTAINTY_WEIGHTS), "f": sc.topics(F.col("low"), FIXTURE_TOPICS), "r": sc.readability(F.col("toks"), F.col("n_sentences"))}
    )
    sure = (F.lit(0.65) + sc.topic_confidence(F.col("f"), F.col("n_words")) + F.lit(0.75)) / 3
    return rows.select("doc_id", number(F.col("s")).alias("score"), sc.label(F.col("s")).alias("stance"), number(F.col("u")).alias("uncertainty"), F.array_join(F.slice(F.array_distinct("f"), 1, 10), ",").alias("topics"), number(F.col("r")).alias("readability"), number(sure).alias("confidence"))


#: Gauge patterns of words the test tables have.
PATTERNS = {"negation": "no|not", "qualifier": "that|they", "intensifier": "und|with", "forward": "from", "backward": "was|had", "data": "this"}
MARK = {k: rf"regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])')" for k, p in PATTERNS.items()}
GAUGE = f"""sents AS (SELECT doc_id, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: length(x) > 10) AS q FROM documents)),
 lex AS (SELECT MAP {{{LEX}}} AS m), st AS (SELECT doc_id, i, s, {TOK.replace('text', 's')} AS toks FROM sents), sv AS (SELECT doc_id, i, s, len(toks) AS n, list_filter(list_transform(toks, lambda t: m[t]::DOUBLE), lambda v: v IS NOT NULL) AS v FROM st, lex),
 g0 AS (SELECT doc_id, i, s, CASE WHEN len(v) > 0 THEN list_sum(v) / sqrt(n) ELSE 0 END * CASE WHEN {MARK["negation"]} THEN -0.8 ELSE 1 END * CASE WHEN {MARK["qualifier"]} THEN 0.7 ELSE 1 END AS x FROM sv),
 g1 AS (SELECT doc_id, i, s, x * CASE WHEN {MARK["intensifier"]} THEN CASE WHEN x < 0 THEN 1.2 ELSE 1.1 END ELSE 1 END AS x FROM g0),
 gauge AS (SELECT doc_id, i, (x * CASE WHEN {MARK["forward"]} THEN 1.2 ELSE 1 END * CASE WHEN {MARK["backward"]} THEN 0.8 ELSE 1 END * CASE WHEN {MARK["data"]} THEN 0.9 ELSE 1 END)::DOUBLE AS x FROM g1)"""


def gauged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.raw_sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("i"), sc.gauge_sentence(F.col("s"), weight_map(FIXTURE_LEXICON), PATTERNS).alias("x"))


@query(f"WITH {GAUGE} SELECT doc_id, i::BIGINT AS i, round(x, 6) AS score FROM gauge")
def gauge_sentence_scores(spark: SparkSession, sf: str) -> DataFrame:
    return gauged(spark, sf).select("doc_id", "i", number(F.col("x")).alias("score"))


@query(f"""WITH {GAUGE}, c AS (SELECT doc_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) AS x FROM gauge) SELECT doc_id, round(avg(x), 6) AS mean_score, round(median(x), 6) AS median_score, round(stddev_pop(x), 6) AS std_score, count(*) AS n_sentences,
 count(*) FILTER (x <= -0.2) AS hawkish, count(*) FILTER (x >= 0.2) AS dovish, count(*) FILTER (x > -0.2 AND x < 0.2) AS neutral FROM c GROUP BY doc_id""")
def gauge_document(spark: SparkSession, sf: str) -> DataFrame:
    """Unsmoothed sentence scores, summed up by document."""
    x = F.col("x")
    return gauged(spark, sf).withColumn("x", sc.clipped(x)).groupBy("doc_id").agg(
        number(F.avg(x)).alias("mean_score"), number(F.median(x)).alias("median_score"), number(F.stddev_pop(x)).alias("std_score"), F.count("*").alias("n_sentences"),
        F.count_if(x <= -0.2).alias("hawkish"), F.count_if(x >= 0.2).alias("dovish"), F.count_if((x > -0.2) & (x < 0.2)).alias("neutral"),
    )


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, ((length(text) % 41) - 20)::DOUBLE / 10 AS x FROM conversations),
 r AS (SELECT conv_id, turn, n, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) AS y, [greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x))] AS h FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.turn, t.n, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * x + 0.4::DOUBLE * (list_sum(h[-5:]) / least(5, len(h))))), list_append(h, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * x + 0.4::DOUBLE * (list_sum(h[-5:]) / least(5, len(h)))))) FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
 SELECT conv_id, turn, round(y, 6) AS y FROM r""")
def sequential_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", ((F.length("text") % 41 - 20) / 10.0).alias("x"))
    return smoothed(rows, ["conv_id"], "turn", "x").select("conv_id", "turn", number(F.col("y")).alias("y"))


SEVERE = r"""list_filter([CASE WHEN length(text) < 100 THEN 'E:short' END, CASE WHEN length(text) > 1000000 THEN 'W:long' END, CASE WHEN n_words < 20 THEN 'E:few words' END,
 CASE WHEN (length(text) - length(replace(text, chr(10), ''))) * 10 > length(text) THEN 'W:newlines' END, CASE WHEN rep THEN 'W:repetitive' END, CASE WHEN stop < 3 THEN 'W:language' END], lambda x: x IS NOT NULL)"""
TRI = "list_transform(range(1, n_words - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
TRIGRAM = rf"""tri AS (SELECT doc_id, text, low, n_words, toks, regexp_split_to_array(regexp_replace(low, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM parts),
 rep AS (SELECT doc_id, text, toks, low, n_words, n_words >= 10 AND len(list_distinct({TRI}))::DOUBLE / nullif(len({TRI}), 0) < 0.7 AS rep FROM tri)"""


@query(f"WITH {PARTS}, {TRIGRAM} SELECT doc_id, coalesce(rep, false) AS repetitive FROM rep")
def repetitive_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", va.repetitive(F.col("text")).alias("repetitive"))


STOP = " + ".join(f"CASE WHEN list_contains(toks, '{w}') THEN 1 ELSE 0 END" for w in va.ENGLISH)


@query(f"WITH {PARTS}, {TRIGRAM}, z AS (SELECT *, {STOP} AS stop FROM rep), y AS (SELECT doc_id, {SEVERE} AS v FROM z) SELECT doc_id, array_to_string(v, ',') AS issues, len(list_filter(v, lambda x: x LIKE 'E:%')) = 0 AS is_valid FROM y")
def validate_content_severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).withColumn("issues", va.content_issues(F.col("text")))
    return rows.select("doc_id", F.array_join(F.transform("issues", lambda i: F.concat(F.left(i["severity"], F.lit(1)), F.lit(":"), i["message"])), ",").alias("issues"), va.is_valid(F.col("issues")).alias("is_valid"))


@query("""WITH c AS (SELECT doc_id, length(trim(text)) < 200 AS short, lang <> 'en' AS foreign_, (length(text) - length(replace(text, chr(10) || chr(10), ''))) // 2 < 2 AS flat, contains(lower(text), 'all rights') OR contains(lower(text), 'copyright') AS boiler FROM documents)
 SELECT doc_id, CASE WHEN short OR foreign_ OR boiler THEN 'invalid' WHEN flat THEN 'questionable' ELSE 'valid' END AS status, round((CASE WHEN short THEN 0.1 ELSE 1 END * CASE WHEN foreign_ THEN 0.3 ELSE 1 END * CASE WHEN flat THEN 0.4 ELSE 1 END * CASE WHEN boiler THEN 0 ELSE 1 END)::DOUBLE, 6) AS confidence,
 array_to_string(list_filter([CASE WHEN short THEN 'length' END, CASE WHEN foreign_ THEN 'language' END, CASE WHEN flat THEN 'structure' END, CASE WHEN boiler THEN 'boilerplate' END], lambda x: x IS NOT NULL), ',') AS issues FROM c""")
def validate_chain(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    checks = [va.length_check(t), va.language_check(F.col("lang"), "en"), va.structure_check(t), va.boilerplate_check(t, ["all rights", "copyright"])]
    rows = table(spark, sf, "documents").withColumn("r", va.chained(checks))
    return rows.select("doc_id", "r.status", number(F.col("r.confidence")).alias("confidence"), F.array_join("r.issues", ",").alias("issues"))


@query(rf"""WITH p AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 3)) AS a, regexp_extract_all(lower(html), '[\p{{L}}\p{{N}}_]+') AS b FROM pages)
 SELECT page_id, len(list_intersect(a, b)) >= least(2, 0.5 * len(a)) AS overlap FROM p""")
def title_content_overlap(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", va.title_overlap(title, F.col("html")).alias("overlap"))


@query("SELECT doc_id, length(text) >= 200 AND (" + " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ["that", "with", "from", "this", "des"]) + ") >= 3 AND (" + " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ["cookie", "login", "menu"]) + ") <= 2 AS like_speech FROM documents")
def speech_likeness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", va.speech_like(F.col("text"), ["that", "with", "from", "this", "des"], ["cookie", "login", "menu"]).alias("like_speech"))


@query("""WITH c AS (SELECT page_id, ((((((1.0::DOUBLE - CASE WHEN NOT contains(url, 'example.com') THEN 0.3 ELSE 0 END) - CASE WHEN length(html) < 3000 THEN 0.4 ELSE 0 END) - CASE WHEN contains(lower(html), 'lorem ipsum') THEN 0.5 ELSE 0 END) - CASE WHEN page_id % 5 = 0 THEN 0.2 ELSE 0 END)) - CASE WHEN NOT contains(lower(html), 'that') THEN 0.1 ELSE 0 END) AS s FROM pages)
 SELECT page_id, round(s, 6)::DOUBLE AS score, CASE WHEN s >= 0.7 THEN 'valid' WHEN s >= 0.4 THEN 'questionable' ELSE 'invalid' END AS status FROM c""")
def authenticity_score(spark: SparkSession, sf: str) -> DataFrame:
    s = va.penalties([(~F.col("url").contains("example.com"), 0.3), (F.length("html") < 3000, 0.4), (F.lower("html").contains("lorem ipsum"), 0.5), (F.col("page_id") % 5 == 0, 0.2), (~F.lower("html").contains("that"), 0.1)])
    rows = table(spark, sf, "pages").withColumn("s", s)
    return rows.select("page_id", number(F.col("s")).alias("score"), va.graded(F.col("s")).alias("status"))
