"""Latent topics of a corpus."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens


def lda(docs: DataFrame, k: int = 10, vocabulary: int = 1000, rounds: int = 20, top: int = 3, least: float = 0.05) -> DataFrame:
    """(doc_id, topics): up to ``top`` (topic, weight) of each of docs(doc_id, text), heaviest first."""
    rows = docs.withColumn("toks", F.filter(tokens(F.col("text")), lambda t: F.length(t) > 3))
    words = CountVectorizer(inputCol="toks", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(rows)
    counted = words.transform(rows)
    model = LDA(k=k, maxIter=rounds, seed=42, optimizer="online").fit(counted)
    placed = F.transform(vector_to_array("topicDistribution"), lambda w, i: F.struct((-F.round(w, 6)).alias("w"), i.alias("topic")))
    best = F.slice(F.array_sort(placed), 1, top)
    chosen = F.transform(F.filter(best, lambda x: -x["w"] > least), lambda x: F.struct(x["topic"].alias("topic"), (-x["w"]).alias("weight")))
    return model.transform(counted).select("doc_id", chosen.alias("topics"))
