"""A training-data pipeline over ``documents``, one operator a stage.

Toxic documents go; of each group of near duplicates the document of the least doc_id
stays; byte strings that repeat an earlier place are cut out of the texts; documents
with benchmark leaks go; what is left is encoded and decoded. Every stage reads all
rows that its predecessor wrote. Stages but the last return the columns of
``documents``, with ``text`` and ``n_chars`` as they are then.

Any 64-bit doc_id is one like any other; rows without one take part like others and come after all with one, so of a
group of theirs alone the row of the least text hash stays; of rows with equal doc_id and text one stays, and rows with equal
doc_id and other texts are documents of their own. A cut inside a character drops the whole character. Texts without words
belong to no group and are kept. The columns of ``documents`` go through all stages; extra ones of other names do too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from quire.llm import byte_bpe, chosen_path, suffix_dedup, templates, toxicity
from quire.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, rest=F.struct(*(F.col(c) for c in docs.columns if c != "text")))
    text = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") == 0, text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    new = cut.select("rest.*", text.alias("text"))
    return new.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_leaks),
    ("byte_bpe", encoded),
]

#: The stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
