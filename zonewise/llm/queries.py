"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, decontaminate, html, importance, language, licenses, mixing, pii, rules, simhash
from .common import read


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("positions")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(read(spark, sf_dir, "conversations"))


def with_tools(conversations: DataFrame) -> DataFrame:
    """conversations with assistants' messages as tool calls and users' later ones as their results.

    By conv_id: calls out of range, unknown, with one id for all, without a query, waiting for an earlier result or for their
    own, and results that stand before their call.
    """
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    name_of = lambda t: F.when(conv % 5 == 2, "c").otherwise(F.concat(F.lit("c"), t))
    mention = lambda when, t: F.when(when, F.concat(F.lit(" ${c"), t, F.lit("}"))).otherwise("")
    query = F.when(conv % 5 != 3, F.concat(text, mention(conv % 5 == 4, turn - 2), mention(conv % 11 == 3, turn)))
    given = F.struct(F.when(conv % 5 == 0, 0).otherwise(turn + 1).alias("limit"), query.alias("query"))
    call = F.struct(given.alias("arguments"), name_of(turn).alias("id"), F.when(conv % 5 == 1, "lookup").otherwise("search").alias("name"))
    result = F.struct(text.alias("content"), name_of(F.when(conv % 6 == 0, turn + 1).otherwise(turn - 1)).alias("tool_call_id"))
    answers = (F.col("role") == "user") & (turn > 0)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(answers, "tool").otherwise(F.col("role")).alias("role"),
        F.when(answers, F.to_json(result)).when(F.col("role") == "assistant", F.to_json(F.struct(F.array(call).alias("tool_calls")))).otherwise(text).alias("text"),
    )


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat operator on conversations full of calls and results, for the table itself has none."""
    return chat.format_chat(with_tools(read(spark, sf_dir, "conversations")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("longest")


QUERIES = {f.__name__: f for f in (op1_mix, op2_chat_format, op3_quality_rules, op4_html_extraction, op5_license_scan, op6_language_id, op7_pii, op8_quality_classifier, op9_simhash, op10_decontaminate)} | {"chat_tool_calls": chat_tool_calls, "pipeline": corpus_pipeline.run}
