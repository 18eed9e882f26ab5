"""Scores of texts as Column expressions. Negative is restrictive (hawkish), positive accommodative (dovish).

Lexicon words match whole tokens; all phrase families match as substrings of the lower-case text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import occurrences_of_any, sentences, space_words, syllables, tokens, word_mark


def clipped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hits(toks: Column, weights: Column) -> Column:
    """Structs (word, value) of the tokens that the lexicon has, in order."""
    found = F.transform(toks, lambda t: F.struct(t.alias("word"), weights[t].alias("value")))
    return F.filter(found, lambda h: h["value"].isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def raw_lexicon_score(hit: Column, n_tokens: Column) -> Column:
    """Sum of the hits over the square root of the tokens; 0 without hits."""
    return F.when(F.size(hit) > 0, total(F.transform(hit, lambda h: h["value"])) / F.sqrt(n_tokens)).otherwise(F.lit(0.0))


def top_words(hit: Column, n: int = 10) -> Column:
    """The ``n`` hits of largest magnitude, ties in order of place."""
    placed = F.transform(hit, lambda h, i: F.struct((-F.abs(h["value"])).alias("k"), i.alias("i"), h["word"].alias("word"), h["value"].alias("value")))
    return F.transform(F.slice(F.sort_array(placed), 1, n), lambda h: F.struct(h["word"].alias("word"), h["value"].alias("value")))


def adjusted(score: Column, low: Column, families: dict[str, list[str]]) -> Column:
    """``score`` after the modifiers of the lower-case text ``low``, one after the other, clipped at the end."""
    for family, most, each, sign in (
        ("negations", 0.8, 0.2, -1), ("hedging", 0.5, 0.1, -1), ("intensifiers", 0.3, 0.1, 1), ("forward_guidance", 0.2, 0.05, 1), ("backward_looking", 0.3, 0.05, -1),
    ):
        n = occurrences_of_any(low, families[family])
        score = score * (F.lit(1.0) + F.lit(sign) * F.least(F.lit(most), n * F.lit(each)))
    return clipped(score)


def lexicon_confidence(hit: Column, n_words: Column, n_sentences: Column) -> Column:
    """Coverage, agreement of signs, length and sentences, weighted .4 .3 .2 .1; 0 without words."""
    value = F.transform(hit, lambda h: h["value"])
    up, down = total(F.filter(value, lambda v: v > 0)), -total(F.filter(value, lambda v: v < 0))
    agreement = F.when(up + down > 0, F.abs(up - down) / (up + down)).otherwise(F.lit(0.0))
    cover = F.least(F.lit(1.0), F.size(hit) / n_words * 3)
    sum_ = cover * 0.4 + agreement * 0.3 + F.least(F.lit(1.0), n_words / 100) * 0.2 + F.least(F.lit(1.0), n_sentences / 10) * 0.1
    return F.when(n_words > 0, F.least(F.lit(1.0), sum_)).otherwise(F.lit(0.0))


def modifier_counts(low: Column, families: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, p in families.items() for x in (F.lit(k), occurrences_of_any(low, p))))


def label(score: Column, edge: float = 0.05) -> Column:
    return F.when(score <= -edge, "hawkish").when(score >= edge, "dovish").otherwise("neutral")


def uncertainty(low: Column, n_words: Column, families: dict[str, list[str]], weights: dict[str, float]) -> Column:
    sum_ = F.lit(0.0)
    for k, words in families.items():
        sum_ = sum_ + occurrences_of_any(low, words) * F.lit(weights[k])
    return F.when(n_words > 0, F.least(F.lit(1.0), sum_ / n_words * 100)).otherwise(F.lit(0.0))


def uncertainty_level(score: Column) -> Column:
    return F.when(score >= 0.7, "High").when(score >= 0.4, "Medium").otherwise("Low")


def present(low: Column, words: list[str]) -> Column:
    """Those of ``words`` that occur, sorted."""
    return F.sort_array(F.filter(F.array(*(F.when(low.contains(w), F.lit(w)) for w in words)), lambda w: w.isNotNull()))


def stance_scores(low: Column, n_words: Column, families: dict[str, list[str]]) -> dict[str, Column]:
    return {k: F.when(n_words > 0, F.least(F.lit(1.0), occurrences_of_any(low, p) / n_words * 100)).otherwise(F.lit(0.0)) for k, p in families.items()}


def first_largest(scores: dict[str, Column]) -> Column:
    """The name of the largest, the first of equals."""
    best = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for k in reversed(list(scores)):
        out = F.when(scores[k] == best, F.lit(k)).otherwise(out)
    return out


def topics(low: Column, families: dict[str, list[str]]) -> Column:
    """Names of the families any phrase of which occurs, in order."""
    def some(phrases: list[str]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | low.contains(p)
        return out

    return F.filter(F.array(*(F.when(some(p), F.lit(k)) for k, p in families.items())), lambda k: k.isNotNull())


def topic_confidence(found: Column, n_words: Column) -> Column:
    return F.when(F.size(found) == 0, F.lit(0.0)).when(n_words < 100, F.lit(0.4)).when(n_words < 500, F.lit(0.6)).otherwise(F.lit(0.8))


def readability(toks: Column, n_sentences: Column) -> Column:
    """How hard a text is to read, 0 to 1, by Flesch's formula; one half without words or sentences."""
    n = F.size(toks)
    syl = F.aggregate(toks, F.lit(0), lambda a, w: a + syllables(w))
    ease = F.lit(206.835) - 1.015 * (n / n_sentences) - 84.6 * (syl / n)
    return F.when((n > 0) & (n_sentences > 0), clipped((100 - ease) / 100, 0.0, 1.0)).otherwise(F.lit(0.5))


def type_token_ratio(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.array_distinct(toks)) / F.size(toks)).otherwise(F.lit(0.0))


def complexity(read: Column, sentence_length: Column, ratio: Column) -> Column:
    return read * 0.4 + F.least(F.lit(1.0), sentence_length / 30) * 0.3 + ratio * 0.3


def with_text_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with low, toks, n_tokens, n_words and n_sentences, each made once."""
    t = F.col(text)
    return docs.withColumns({"low": F.lower(t), "toks": tokens(t), "n_words": F.size(space_words(t)), "n_sentences": F.size(sentences(t))}).withColumn("n_tokens", F.size("toks"))


# The gauge's patterns, each counted at most once a sentence.
GAUGE = {
    "negation": "not|never|no", "qualifier": "may|might|could|should|perhaps|likely|possibly", "intensifier": "very|extremely|highly|significantly",
    "forward": "will|expect|outlook", "backward": "was|had|previous", "data": "data|indicators",
}


def gauge_sentence(sentence: Column, weights: Column, patterns: dict[str, str] = GAUGE) -> Column:
    """A sentence's score before smoothing and clipping."""
    toks = tokens(sentence)
    score = raw_lexicon_score(hits(toks, weights), F.size(toks))
    has = {k: sentence.rlike(word_mark(p)) for k, p in patterns.items()}
    score = F.when(has["negation"], score * -0.8).otherwise(score)
    score = F.when(has["qualifier"], score * 0.7).otherwise(score)
    score = F.when(has["intensifier"], score * F.when(score < 0, 1.2).otherwise(1.1)).otherwise(score)
    for k, by in (("forward", 1.2), ("backward", 0.8), ("data", 0.9)):
        score = F.when(has[k], score * by).otherwise(score)
    return score


def ensemble(methods: DataFrame) -> DataFrame:
    """One row per doc of methods(doc_id, ord, method, score, confidence): the combined result."""
    agg = methods.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.stddev_pop("score").alias("std_score"),
        (F.sum(F.col("score") * F.col("confidence")) / (F.sum("confidence") + 1e-8)).alias("weighted"), F.avg("confidence").alias("base"),
        F.max_by("method", F.struct("confidence", -F.col("ord"))).alias("dominant_method"),
    )
    bonus = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 0.2 - F.col("std_score"))).otherwise(F.lit(0.0))
    agg = agg.withColumn("confidence_score", F.least(F.lit(1.0), F.col("base") + bonus))
    agg = agg.withColumn("final_score", F.when(F.col("confidence_score") > 0.3, F.col("weighted")).otherwise(F.col("mean_score")))
    level = F.when(F.col("confidence_score") >= 0.8, "high").when(F.col("confidence_score") >= 0.6, "medium").otherwise("low")
    warn = F.filter(
        F.array(
            F.when(F.col("confidence_score") < 0.5, F.lit("Low overall confidence in analysis")),
            F.when((F.col("std_score") > 0.5) & (F.col("n") > 1), F.lit("High disagreement between methods")),
            F.when(F.col("n") == 1, F.lit("Only one analysis method succeeded")),
        ),
        lambda w: w.isNotNull(),
    )
    return agg.select("doc_id", "n", "mean_score", "median_score", "std_score", "confidence_score", "final_score", label(F.col("final_score")).alias("stance"), level.alias("confidence_level"), "dominant_method", warn.alias("warnings"))
