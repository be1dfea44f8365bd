"""The pipeline's token stage: one Python pass that gives the rows of encode, then decode."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import bpe_codec


def test_token_stage_is_one_pass_with_the_rows_of_encode_then_decode(spark, edge):
    path = public_tokenizers.path(corpus_pipeline.TOKENIZER)
    staged = corpus_pipeline.tokenize(spark, edge, "")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    two = bpe_codec.decode(bpe_codec.encode(edge, path), path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    assert sorted(staged.collect(), key=str) == sorted(two.collect(), key=str)
    assert staged.count() == len(edge.collect())
