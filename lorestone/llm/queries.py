"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorestone.llm import crosstoken, decontaminate, divergence, language, lmscore, media, mixing, neardup, quality, secrets, sharding, toxicity, warc
from lorestone.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lmscore_report(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.neardup_report(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op12_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align_report(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        op1_mixing, op2_toxicity, op3_secrets, op4_quality, op5_sharding, op6_language, op7_media, op8_decontaminate, op9_lmscore, op10_neardup,
        op11_warc, op12_crosstoken, op13_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.OP1_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op10_neardup": neardup.OP10_SQL, "op11_warc": warc.OP11_SQL, "op13_divergence": divergence.OP13_SQL}
