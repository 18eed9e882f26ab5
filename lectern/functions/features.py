"""Features and combinations of scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import space_words


def text_features(text: Column, words: Column, sentences: Column) -> dict[str, Column]:
    n, s = F.size(words), F.size(sentences)
    return {
        "text_length": F.length(text), "word_count": n, "sentence_count": s,
        "avg_word_length": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(n, F.lit(1)), "avg_sentence_length": n / F.greatest(s, F.lit(1)),
        "long_word_ratio": F.coalesce(F.size(F.filter(words, lambda w: F.length(w) > 6)) / F.nullif(n, F.lit(0)), F.lit(0.0)),
        "complex_sentence_ratio": F.size(F.filter(sentences, lambda x: F.size(space_words(x)) > 20)) / F.greatest(s, F.lit(1)),
    }


#: Weight of a speaker by what the role has in it; anyone else counts half.
AUTHORITY = {"chair": 1.0, "governor": 1.0, "president": 0.8}


def authority(role: Column, weights: dict[str, float] | None = None, rest: float = 0.5) -> Column:
    out = F.lit(rest)
    for part, w in reversed(list((weights or AUTHORITY).items())):
        out = F.when(F.lower(role).contains(part), F.lit(w)).otherwise(out)
    return out


def rule_ensemble(parts: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """(score, confidence) of (score, confidence, weight) parts; agreement adds to the confidence."""
    weight = sum((c * w for _, c, w in parts), F.lit(0.0))
    plain = sum((s for s, _, _ in parts), F.lit(0.0)) / len(parts)
    score = F.coalesce(sum((s * w * c for s, c, w in parts), F.lit(0.0)) / F.nullif(weight, F.lit(0.0)), plain)
    sure = sum((c for _, c, _ in parts), F.lit(0.0)) / len(parts)
    if len(parts) > 1:
        spread = F.sqrt(sum(((s - plain) * (s - plain) for s, _, _ in parts), F.lit(0.0)) / len(parts))
        sure = F.least(F.lit(1.0), sure + F.greatest(F.lit(0.0), 0.2 - spread))
    return score, sure


def model_ensemble(models: DataFrame) -> DataFrame:
    """(doc_id, score, confidence) of models(doc_id, pos, neg, confidence, financial): models of another domain count half."""
    s = (F.col("pos") - F.col("neg")) * F.when(F.col("financial"), 1.0).otherwise(0.5)
    bonus = F.least(F.lit(0.1), 0.05 * (F.count("*") - 1))
    return models.groupBy("doc_id").agg((F.sum(s * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("score"), F.least(F.lit(1.0), F.avg("confidence") + bonus).alias("confidence"))


def pipeline_sentiment(lexicon: Column, model: Column) -> tuple[Column, Column, Column]:
    """(score, confidence, method): a model score of exactly 0 counts as none."""
    both = model.isNotNull() & (model != 0)
    return F.when(both, lexicon * 0.3 + model * 0.7).otherwise(lexicon), F.when(both, F.lit(0.85)).otherwise(F.lit(0.65)), F.when(both, "ensemble").otherwise("lexicon_only")
