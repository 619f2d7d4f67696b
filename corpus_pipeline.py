"""Corpus pipeline: documents through quality selection, near-duplicate removal, repeated-passage removal and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. The first three return the columns of documents; packing returns one row per piece.

Every stage takes an empty table and gives an empty one, keeps or ignores other columns whatever their names, and reads whole texts.
Repeated rows are judged alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pathgrove.llm import jaccard_join, packing, quality, repeats
from pathgrove.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose probability of the best grade is at least quality.KEEP. Null or empty text has the length feature only;
    null doc_id is judged by its text. Without usable labels all documents stay. Other columns stay."""
    model = quality.fit_on(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.select_documents(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: the smallest doc_id. Equal rows stay
    once. Documents without words, with null text or a null doc_id link with nothing and stay. Other columns stay."""
    return jaccard_join.drop_near_copies(docs, size=5, num=80, den=100)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 200 bytes that also starts elsewhere; n_chars follows the text. Null text stays null, null doc_ids and ties are cut like
    others, and repeated rows lose what they share. No row goes, and other columns stay."""
    return repeats.cut_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens, a row per piece. Null or empty text is a piece of the end id alone, null doc_id stays
    null, repeated rows are pieces each. Other columns are ignored."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
