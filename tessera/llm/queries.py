"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, html_extract, licenses, line_dedup, lm_score, packing, quality, secrets, simhash
from tessera.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have fingerprint zero and link like any other. See near_duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; a null text has no licence of its own. Directories are made of source and language. See scan."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.document_path())


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; null html gives an empty text. See extract."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; texts without words score 0. See score."""
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation, and one for the probe; null texts are empty. See format_chats."""
    return chat.digest(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null texts have no spans. See find_secrets."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, with the lines that stay; a null text stays null. See dedup_lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece; a null text gives the end token alone. See pack."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item in it; null texts match nothing. See contaminated."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; a null text has no words and fails. See quality."""
    return quality.quality(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that corpus_pipeline.run() gives."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_simhash, op2_licenses, op3_html, op4_lm_score, op5_chat_format, op6_secrets, op7_line_dedup, op8_packing,
        op9_decontaminate, op10_quality, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": licenses.ORACLE_SQL,
        "op4_lm_score": lm_score.ORACLE_SQL,
        "op5_chat_format": chat.ORACLE_SQL,
        "op6_secrets": secrets.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op10_quality": quality.ORACLE_SQL,
    }
