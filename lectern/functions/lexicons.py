"""Word lists and phrase families. All of them are parameters of the operators; these are the defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The default policy lexicon, word to (polarity, weight); negative is restrictive.
POLICY_LEXICON = {
    "tighten": (-0.9, 1.0), "tightening": (-0.9, 1.0), "restrictive": (-0.8, 1.0), "aggressive": (-0.9, 1.0), "combat": (-0.8, 0.9),
    "fight": (-0.8, 0.9), "curb": (-0.7, 0.8), "constrain": (-0.7, 0.8), "firm": (-0.6, 0.8), "decisive": (-0.7, 0.8),
    "raise": (-0.8, 0.9), "increase": (-0.7, 0.8), "hike": (-0.9, 1.0), "higher": (-0.6, 0.7), "lift": (-0.7, 0.8),
    "elevate": (-0.7, 0.8), "normalize": (-0.5, 0.7), "inflation": (-0.6, 0.8), "overheating": (-0.8, 0.9), "excessive": (-0.7, 0.8),
    "unsustainable": (-0.6, 0.7), "pressures": (-0.5, 0.6), "risks": (-0.4, 0.6), "accommodate": (0.8, 1.0), "accommodative": (0.8, 1.0),
    "stimulus": (0.9, 1.0), "stimulate": (0.8, 0.9), "ease": (0.8, 0.9), "easing": (0.8, 0.9), "support": (0.7, 0.8),
    "boost": (0.7, 0.8), "encourage": (0.6, 0.7), "foster": (0.6, 0.7), "lower": (0.8, 0.9), "cut": (0.9, 1.0),
    "reduce": (0.7, 0.8), "decrease": (0.7, 0.8), "maintain": (0.4, 0.6), "hold": (0.3, 0.5), "employment": (0.5, 0.7),
    "unemployment": (0.4, 0.6), "jobs": (0.5, 0.6), "labor": (0.4, 0.5), "workers": (0.4, 0.5), "growth": (0.5, 0.6),
    "expansion": (0.4, 0.5), "recovery": (0.6, 0.7), "strengthen": (0.5, 0.6), "quantitative": (0.7, 0.8), "asset": (0.4, 0.5),
    "purchases": (0.6, 0.7), "balance": (0.3, 0.4), "uncertain": (0.2, 0.4), "cautious": (0.3, 0.5), "careful": (0.3, 0.4),
    "gradual": (0.4, 0.6), "measured": (0.3, 0.5), "patient": (0.5, 0.6), "data": (0.1, 0.3), "appropriate": (0.0, 0.3),
    "consistent": (0.0, 0.2), "policy": (0.0, 0.1), "economic": (0.0, 0.1), "financial": (0.0, 0.1), "immediately": (-0.3, 0.5),
    "soon": (-0.2, 0.4), "future": (0.1, 0.3), "eventually": (0.2, 0.4), "temporary": (0.3, 0.4), "committed": (-0.2, 0.5),
    "determined": (-0.3, 0.5), "resolved": (-0.3, 0.5), "flexible": (0.4, 0.6), "adapt": (0.3, 0.5), "adjust": (0.3, 0.5),
}
# Modifier families, matched as substrings.
MODIFIERS = {
    "negations": ["not", "never", "no", "n't", "without", "lack", "absence"],
    "hedging": ["may", "might", "could", "possibly", "perhaps", "likely", "probably"],
    "intensifiers": ["very", "extremely", "highly", "significantly", "substantially", "considerably"],
    "forward_guidance": ["will", "expect", "anticipate", "project", "outlook", "going forward"],
    "backward_looking": ["was", "had", "previous", "past", "earlier", "before"],
    "uncertainty": ["uncertain", "unclear", "ambiguous", "depends", "conditional"],
}
# Uncertainty words by level, and the levels' weights.
UNCERTAINTY = {
    "high": ["uncertain", "unclear", "ambiguous", "unknown", "unpredictable"],
    "medium": ["may", "might", "could", "possibly", "perhaps", "likely"],
    "low": ["depends", "conditional", "subject to", "monitor", "assess"],
}
UNCERTAINTY_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
# Stance dimensions, in the order that breaks ties.
STANCES = {
    "commitment": ["will", "committed to", "determined to", "pledge"],
    "flexibility": ["flexible", "adapt", "adjust", "respond to"],
    "forward_guidance": ["expect", "anticipate", "project", "outlook"],
    "data_dependency": ["data dependent", "economic conditions", "indicators"],
}
# Topics and the phrases any of which gives one, in order.
TOPICS = {
    "Monetary Policy": ["monetary policy", "interest rate", "federal funds", "policy rate"],
    "Inflation": ["inflation", "price stability", "deflation", "cpi", "pce"],
    "Employment": ["employment", "unemployment", "labor market", "jobs"],
    "Economic Outlook": ["economic outlook", "forecast", "projection", "growth"],
    "Financial Stability": ["financial stability", "systemic risk", "banking"],
    "International Economics": ["international", "global", "trade", "foreign"],
    "Crisis Response": ["crisis", "pandemic", "emergency", "covid"],
    "Market Conditions": ["market", "liquidity", "volatility", "credit"],
}
#: A lexicon of frequent words of the test tables, for queries that are checked.
FIXTURE_LEXICON = {
    "is": (-0.9, 1.0), "that": (-0.8, 0.9), "be": (-0.7, 0.8), "with": (-0.6, 0.8), "und": (-0.5, 0.6), "from": (0.8, 0.9),
    "this": (0.7, 0.8), "are": (0.6, 0.7), "for": (0.5, 0.7), "des": (0.6, 0.7), "que": (0.4, 0.5),
}
FIXTURE_MODIFIERS = {
    "negations": ["no", "was"], "hedging": ["that", "they"], "intensifiers": ["und", "with"], "forward_guidance": ["from"],
    "backward_looking": ["had", "this"], "uncertainty": ["are"],
}
FIXTURE_UNCERTAINTY = {"high": ["they", "und"], "medium": ["that", "des"], "low": ["from", "que"]}
FIXTURE_STANCES = {"commitment": ["with", "will"], "flexibility": ["from", "und"], "forward_guidance": ["that"], "data_dependency": ["this", "des"]}
FIXTURE_TOPICS = {"Articles": ["the ", " des "], "Links": ["with", "que"], "Pointers": ["this", "that"], "Verbs": ["are", "was"]}


def weight_map(lexicon: dict[str, tuple[float, float]]) -> Column:
    """A map of word to polarity times weight, for lexicons of a bounded size."""
    return F.create_map(*(F.lit(x) for w, (p, k) in lexicon.items() for x in (w, round(p * k, 10))))


def lexicon_table(spark: SparkSession, lexicon: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(w, p, k) for w, (p, k) in lexicon.items()], "word string, polarity double, weight double")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, polarity, weight) of a CSV file with those columns: lower-case words, the last row of a word wins."""
    rows = spark.read.option("header", True).schema("word string, polarity double, weight double").csv(path)
    rows = rows.withColumn("line", F.monotonically_increasing_id()).withColumn("word", F.lower(F.trim("word")))
    last = Window.partitionBy("word").orderBy(F.desc("line"))
    kept = rows.withColumn("n", F.row_number().over(last)).where("n = 1")
    return kept.select("word", "polarity", F.coalesce("weight", F.lit(1.0)).alias("weight"))
