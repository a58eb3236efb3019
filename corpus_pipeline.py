"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage is a function of the session, the documents so far and the folder of the tables, and
works on all that the stage before kept. ``run`` writes every stage's documents to the shared
folder as Parquet and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import jaccard_join, language_id, line_dedup, mixing, packing
from claimweave.llm.common import WORD, pinned, table

# A text must belong to its main language by this share at least.
LEAST_SHARE = 0.3
# Near duplicates: shingles of five words, similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (2): documents without letters, with no main language, or unlike the texts of their languages, go.

    Null texts go; rows that repeat fare alike, and all columns come through as they were.
    """
    found = language_id.identify(docs, language_id.learn_from(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE) & F.col("fits")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (1): texts lose runs of lines that stand earlier; documents of which no word is left go.

    Null texts stay. Rows that repeat id and text are one document and fare alike; of equal texts the one with the smallest id is the first.
    """
    left = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    changed = F.col("n_removed") > 0
    columns = {c: F.col("row")[c] for c in docs.columns}
    columns["text"] = F.col("kept_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (10): of each group of near duplicates the document with the smallest id stays.

    Documents without words are in no group and stay; rows that repeat id and text leave one; other columns come through.
    """
    return jaccard_join.keep_one(docs, WIDTH, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (8): every document as often as its source's target weight asks for.

    Null sources are a source of their own; documents without words, and null texts, have size 0; rows that repeat an id share a draw.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (6): the pieces of near-equal windows of tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mix), ("packing", pack)]
# Language identification and packing cannot be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
