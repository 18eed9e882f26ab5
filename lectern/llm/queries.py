"""The thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.byte_bpe import encoded
from lectern.llm.common import documents, fold, labels
from lectern.llm.exact_dedup import exact_groups
from lectern.llm.jaccard_join import near_groups
from lectern.llm.language_id import languages
from lectern.llm.oracle import SQL
from lectern.llm.packing import packed
from lectern.llm.phrase_dedup import phrase_free
from lectern.llm.quality import ruled
from lectern.llm.suffix_dedup import substring_free
from lectern.llm.token_counts import token_counts
from lectern.llm.toxicity import default_folds, toxic_scores


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(documents(spark, sf_dir), trusted=labels(spark, sf_dir).where("quality = 1"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_free(documents(spark, sf_dir), length=100, keep_text=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir), teaches=fold("doc_id", 4) != 2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_free(documents(spark, sf_dir), length=13, keep_text=False)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=4, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(documents(spark, sf_dir), labels(spark, sf_dir), **default_folds())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
