"""Corpus preparation: each stage reads what the one before it kept, as written Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.exact_dedup import first_copies
from blockloom.llm.language_id import identify, learn_dictionaries
from blockloom.llm.near_dedup import near_duplicates
from blockloom.llm.packing import pack
from blockloom.llm.queries import tokenizer_file
from blockloom.llm.secret_scan import redacted
from blockloom.llm.tables import documents
from blockloom.session import materialized


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, judged by dictionaries of the labelled ones."""
    found = identify(docs, learn_dictionaries(docs))
    return found.filter("NOT lang_rejected").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; documents without words stay."""
    kept = near_duplicates(docs, words=5, percent=80).filter("kept").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"])
    return docs.join(kept, same, "left_semi")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: The first, third and last stage have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; the rows of the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
