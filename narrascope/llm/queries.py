"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrascope.llm import chat_format, decontaminate, gru_lm, langid, license_scan, mixing, pii, quality, token_output
from narrascope.llm.near_dedup import ORACLE as NEAR_ORACLE
from narrascope.llm.near_dedup import near_duplicates
from narrascope.llm.shared import table


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.op1_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.op2_chat(table(spark, folder, "conversations"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.op3_pii(table(spark, folder, "documents"))


def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return gru_lm.op4_lm_scores(table(spark, folder, "documents"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.op6_language(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.op7_mixing(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.op8_quality(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.op9_license_scan(table(spark, folder, "documents"))


def op10_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.op10_token_output(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_pii": op3_pii,
    "op4_lm_scores": op4_lm_scores,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_token_output": op10_token_output,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op5_near_dedup": NEAR_ORACLE,
    "op7_mixing": mixing.ORACLE,
}
