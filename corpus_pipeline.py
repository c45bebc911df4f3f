"""A corpus pipeline of five stages, each over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet into a folder of the shared one, which goes when the driver ends, and reads them again.

In every stage null and empty texts count as texts without words, null ids as ids of no other row, repeated rows as rows; an empty
table gives an empty table; columns beside those of documents are carried along, whatever their names; texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitfold.llm import bpe, common, decontaminate, pii, simhash, toxicity
from splitfold.shipping import scratch_folder, ship

#: SQL can express neither the learned toxicity model nor the fingerprints.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is at least 0.5; the model learns from the labelled documents of its input. Texts
    without a hit, null and empty ones among them, stay; repeated rows go or stay together."""
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose fingerprints are linked: the one with the smallest doc_id, of ties that with the
    smallest hash of its text. Null ids come last. All null and empty texts are one group; of repeated rows one stays."""
    ship(spark)
    return simhash.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which any window of a benchmark item occurs: a passage leaks however long the text around it. Null and
    empty texts stay; an empty benchmark rejects nothing."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks spans of personal data; keeps all documents."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The counts and digests of each document's token ids and of the text they decode to."""
    import public_tokenizers

    made = bpe.digests("text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", made.alias("r")).select("doc_id", "r.*")


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii", personal_data),
    ("byte_level_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
