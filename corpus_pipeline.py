"""The corpus pipeline: STAGES applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on every row and whole text of ``docs``, and returns rows of it with the
columns of ``documents``; the last one returns the packed pieces. A row with a null text is a row with an empty one: it
has no letter, so language ID rejects it. Extra columns of ``docs`` pass through all stages but the last. Ids
(``doc_id``) must be unique. Without rows a stage returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.exact_dedup import drop_exact_duplicates
from sluice.llm.langid import UNDETERMINED, fit_language_model, predict_language
from sluice.llm.packing import pack
from sluice.llm.runtime import session_of, written
from sluice.llm.simhash import drop_near_duplicates
from sluice.llm.tokens import token_pieces
from sluice.llm.toxicity import fit_toxicity, score_toxicity

#: A text stays whose language is known with this probability at least.
LEAST_LANGUAGE = 0.5
#: A text goes whose toxicity reaches this.
TOXIC = 0.7
SEQUENCE_TOKENS = 4096


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the corpus teaches; those without a letter or with an uncertain language go."""
    model = fit_language_model(docs)
    both = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    found = predict_language(docs.select(both, "text"), model, "row")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select("id.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier, fitted on ``labels``, doesn't call toxic."""
    model = fit_toxicity(docs, session_of(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    both = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    return score_toxicity(docs.select(both, "text"), model, "row").where(F.col("score") < TOXIC).select("id.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal without white space."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five words, a similarity of 0.8 or more.

    SimHashes under op9's Golay-code keys find the pairs, exact similarity verifies them; MinHash bands add those that bits lose.
    """
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each text in sequences of ``SEQUENCE_TOKENS``."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)
    return pack(pieces.withColumnRenamed("id", "doc_id"), SEQUENCE_TOKENS)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("exact", exact),
    ("near", near),
    ("packing", packing),
]

#: SQL can express neither the classifiers nor the packing; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = session_of(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(session_of(spark), docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
