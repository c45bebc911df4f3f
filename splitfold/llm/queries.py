"""The queries of this subpackage, each over its whole table, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.llm import bpe, chat, decontaminate, langid, pii, quality, rules, simhash, substrings, toxicity
from splitfold.llm.common import held_out, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out().alias("held_out"), quality.score("text", model).alias("r"))
    return found.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.3).cast("int").alias("predicted"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out().alias("held_out"), toxicity.score("text", model).alias("r"))
    return found.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(chat.as_events(rows.unionByName(added))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = bpe.digests("text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("r")).select("doc_id", "r.*")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), langid.predict("text", langid.train(docs)).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_rules": op4_rules,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
}
ORACLE: dict[str, str] = {"op4_rules": rules.SQL, "op5_decontaminate": decontaminate.SQL, "op7_chat": chat.SQL}
