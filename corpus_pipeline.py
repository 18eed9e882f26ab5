"""The training-data pipeline: toxic texts out, copies out, near copies out, repeated passages out, packed.

Every stage works on all rows its predecessor kept and, but for the last, gives the columns of
``documents``. Rows that share a doc_id or have none are documents of their own. Null texts count as empty, and leave the
substring stage as empty ones; of documents without a word one stays each. Empty tables give no rows; other columns pass as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, documents, identified, labels, written
from lectern.llm.exact_dedup import exact_groups
from lectern.llm.jaccard_join import near_rows
from lectern.llm.packing import packed
from lectern.llm.suffix_dedup import substring_free
from lectern.llm.toxicity import default_folds, without_toxic

#: Words of a shingle and per cent of similarity of near copies; bytes of a repeated passage; tokens of a sequence.
SHINGLE, SIMILAR, PASSAGE, SEQUENCE = 5, 80, 100, 4096


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half for toxicity, the model learned from the labelled ones among ``docs``."""
    return without_toxic(docs, labels(spark, sf_dir), **default_folds())


def staying(own: DataFrame, stays: DataFrame) -> DataFrame:
    """The carried columns of the rows of ``own`` whose number is in stays(doc)."""
    return own.join(stays.select("doc").hint("merge"), "doc", "left_semi").select("carried.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, one of them where that occurs twice."""
    own, _ = identified(docs, carried=docs.columns)
    return staying(own, exact_groups(own, doc_id="doc").where("kept").select(F.col("doc_id").alias("doc")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked directly or through others, the row with the smallest doc_id, the first of them where that occurs twice."""
    own, _ = identified(docs, carried=docs.columns)
    return staying(own, near_rows(own, SHINGLE, SIMILAR).where("doc = component"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one (or itself, earlier) has."""
    cut = substring_free(docs, PASSAGE, keep_text=True, carried=docs.columns)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return cut.select(*((new[c] if c in new else F.col(f"carried.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Learned scores, BPE and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            if i:
                discard(given)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
