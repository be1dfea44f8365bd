"""A training-data pipeline over documents, stage by stage.

Each stage takes what its predecessor kept, written and read again, so a lost executor
costs one stage's tasks at most. All but the last return the columns of documents.
SQL can't express the first stage's machine, so there is no SQL for the whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe_codec, language, mixing, ngram_join, toxicity
from framewright.llm.batches import shared_folder

TOKENIZER = "byte_bpe_50k.json"
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the machine learns from the labels at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return toxicity.without_toxic(docs, machine)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages, by text, declared language and source."""
    model = language.fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return language.in_known_language(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the text that they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    decoded = bpe_codec.encode_decoded(docs, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
