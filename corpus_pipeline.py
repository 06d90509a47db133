"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

1. Toxic documents go.
2. Of documents that are near copies by their 5-word shingles, one stays.
3. Passages of ``REPEAT_BYTES`` bytes and more that occur twice are cut out; ``n_chars`` follows.
4. Sources are mixed to their target shares: rows repeat or go.
5. What is left is tokenised and packed into sequences of 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm import mixing, ngram_join, packing, queries, substrings, toxicity
from tagloom.llm.common import table
from tagloom.runtime import scratch_path


#: Bytes from which a repeated passage goes: about 50 words of five letters or a little less.
REPEAT_BYTES = 250


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=5, percent=75)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(docs, length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, cap=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path(queries.WORD_TOKENIZER), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
