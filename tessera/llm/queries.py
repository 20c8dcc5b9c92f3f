"""Queries over the driver's tables: one for each training-data operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, langid, lattice, main_text, minhash, mixing, packing, quality_cnn, quality_rules, spelling, toxicity, url_trust, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), mixing.TARGETS, copy_column="copy")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_copies(_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(_table(spark, sf_dir, "pages"), "page_id", "url")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_trust, op2_packing, op3_toxicity, op4_mixing, op5_warc, op6_lattice,
            op7_quality, op8_minhash, op9_language, op10_quality_rules, op11_main_text, op12_spelling, op13_conversations,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_trust": url_trust.oracle_sql(),
        "op4_mixing": mixing.oracle_sql(),
        "op5_warc": warc.ORACLE_SQL,
        "op6_lattice": lattice.ORACLE_SQL,
        "op8_minhash": minhash.ORACLE_SQL,
        "op11_main_text": main_text.ORACLE_SQL,
        "op12_spelling": spelling.oracle_sql(),
        "op13_conversations": conversations.oracle_sql(),
    }
