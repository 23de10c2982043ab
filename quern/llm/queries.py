"""The queries of this subpackage, over whole tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.wavelet import token_wavelet

    return token_wavelet(spark, table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.jaccard_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.chat import format_chats

    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_chats(turns.unionByName(fixed))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.cotraining import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.html_text import extract_html

    return extract_html(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_pii": op4_pii,
    "op5_chat_windows": op5_chat_windows,
    "op6_mix_sources": op6_mix_sources,
    "op7_line_dedup": op7_line_dedup,
    "op8_cotraining": op8_cotraining,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {}
