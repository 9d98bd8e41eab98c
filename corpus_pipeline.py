"""A corpus pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import langid, neardup, packing, secrets, substrings
from fieldloom.llm.common import looked_up, unused, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which the classifier gives a language; texts without letters go. How sure it is does not count: the
    probabilities are closed over the learned languages, so short and mixed texts have low ones too."""
    names, weights = langid.train(docs)
    judged = langid.predict(docs, names, weights)
    return judged.where(F.col("lang_pred") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return neardup.one_of_each(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; texts without any stay as they are."""
    cut = substrings.without_repeats(docs).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    found, _ = secrets.audit(docs)
    # A document's findings depend on its content alone, so only content with findings is looked up, each once.
    blob, spans = unused(docs, "_blob"), unused(docs, "_spans")
    known = found.where("size(spans) > 0").groupBy(F.col("blob").alias(blob)).agg(F.max("spans").alias(spans), F.count("*").alias("size"))
    marked = looked_up(docs.withColumn(blob, F.sha2(secrets.content().cast("binary"), 256)), written(known, "findings"), blob, "left")
    text = F.when(F.col(spans).isNotNull(), secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return marked.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    path = public_tokenizers.path
    return packing.packed(docs, path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_spans", secret_spans),
    ("sequences", sequences),
]

#: No SQL for a trained network, sketches or tokenizers: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
