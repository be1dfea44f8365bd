"""Queries of the subpackage against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from framewright.llm.queries import LLM_QUERIES
from framewright.sources.tables import TABLE_SCHEMAS
from tests.conftest import SF_DIR, rows

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(spark_entry.queries())
    assert set(LLM_QUERIES) < names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n, entry in LLM_QUERIES.items() if entry.sql])
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLE_SCHEMAS:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    expected = connection.execute(LLM_QUERIES[name].sql)
    columns = [c[0] for c in expected.description]
    result = LLM_QUERIES[name].run(spark, SF_DIR)
    assert sorted(result.columns) == sorted(columns)
    assert sorted(map(repr, rows(result.select(columns)))) == sorted(map(repr, expected.fetchall()))


def test_pipeline_stages_take_effect(spark):
    from framewright.llm import mixing, toxicity
    from tests.llm.test_documents import brute_components, shingles

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        kept = docs.collect()
        docs = spark.createDataFrame(kept, docs.schema)
        seen[name] = before, kept
        if name != "bpe":
            assert docs.columns == columns

    before, kept = seen["toxicity"]
    machine = toxicity.fitted(
        spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    )
    clean = {r["doc_id"] for r in toxicity.scores(before, machine).filter("score < 0.5").collect()}
    assert {r["doc_id"] for r in kept} == clean

    before, kept = seen["ngram_join"]
    sets = [(r["doc_id"], shingles(r["text"])) for r in before.collect()]
    wanted = {i for i, least in brute_components(sets).items() if i == least}
    assert {r["doc_id"] for r in kept} == wanted and len(kept) == len(wanted)

    before, kept = seen["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.repetitions(before).collect()}
    assert len(kept) == sum(copies.values())

    before, kept = seen["bpe"]
    assert len(kept) == before.count() and all(r["n_tokens"] == len(r["ids"]) for r in kept)
    assert corpus_pipeline.run(spark, SMALL).count() == len(kept)


def test_stages_take_edge_rows_and_empty_tables(spark, edge, nothing):
    """Each stage defines its result on nulls, blanks, repeats, long texts and clashing names."""
    from pyspark.sql import functions as F

    for docs in (edge, nothing):
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
        total = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SMALL)
            kept = result.collect()
            assert len(kept) <= 3 * total
            if name == "bpe":
                assert len(kept) == total and all(r["n_tokens"] == len(r["ids"]) for r in kept)
            else:
                assert result.columns == docs.columns
                texts = {r["text"] for r in docs.collect()}
                assert {r["text"] for r in kept} <= texts
            if name == "toxicity":
                assert len(kept) == total
