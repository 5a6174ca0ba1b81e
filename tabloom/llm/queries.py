"""opN queries over the whole test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import licences, merkle, mixing, rules
from tabloom.llm.common import table
from tabloom.llm.cotraining import classified
from tabloom.llm.html_text import main_text
from tabloom.llm.packing import best_two_fit
from tabloom.llm.sequence_files import token_files
from tabloom.llm.simhash import near_duplicates
from tabloom.llm.token_counts import token_counts


def tokenizer(name: str) -> str:
    """A public tokenizer file: a path is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, seed=42, radius=4)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, size=2048)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_id_output": op2_token_id_output,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_main_text": op8_html_main_text,
    "op9_license_scans": op9_license_scans,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.SQL,
    "op5_quality_rules": rules.SQL,
    "op9_license_scans": licences.SQL,
}
