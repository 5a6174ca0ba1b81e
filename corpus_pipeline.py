"""Corpus pipeline: documents to packed training sequences.

Stages, in order; each works on all rows that the stage before it kept:

1. quality_classifier  documents whose co-trained quality score is below the threshold go
2. quality_rules       lines that fail the line rules go, and documents that the rules reject
3. near_dedup          one document of each component of near copies (SimHash at most 4 bits apart, or Jaccard of
                       five-word shingles 0.8 or more) stays, that of the smallest id
4. source_mixing       documents are put in the order of the Pfair mix of their sources
5. packing             a row for each piece of a document in the packed sequences, which are numbered in the order
                       of the mix (its positions are worked out again, as documents have no column for them)

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import cotraining, mixing, packing, rules, simhash
from tabloom.llm.common import table, written
from tabloom.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.accepted(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(docs, tokenizer("byte_bpe_50k.json"), end_id=0, size=2048, positions=written(mixing.schedule(docs).select("doc_id", "position"), "positions"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", best_fit_packing),
]

#: A trained classifier and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what goes from one to the next is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
