"""Queries over documents and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.bands import BandRule
from framewright.functions.python_functions import arrow_bands, null_safe_udf
from framewright.operators.derive import filter_derive
from framewright.operators.enrich import attach_lookup, join_on_key
from framewright.operators.ordering import ordered, ordered_once
from framewright.operators.pivoting import REFUSE, pivot_measures
from framewright.operators.profile import profile
from framewright.operators.ranking import RankNames, rank_values_balanced, rank_within_balanced
from framewright.plans.registry import query
from framewright.sources.staging import staging_folder, stored, stored_and_counted
from framewright.sources.tables import load_table

LANGUAGES = [("de", "German"), ("en", "English"), ("fr", "French")]

LEVEL = BandRule(">", ((900, "Long"),), otherwise="Short")
SIZE = BandRule("<", ((1000, "small"), (2500, "medium")), otherwise="large")
PIVOT_SIZE = BandRule("<", ((300, "small"), (1000, "medium")), otherwise="large")
CATEGORY = BandRule(
    ">=", ((1000, "High"), (300, "Medium")), otherwise="Low", null_label=None
)


@query("""
    WITH lookup(lang, language) AS (
        VALUES ('de', 'German'), ('en', 'English'), ('fr', 'French'))
    SELECT language, count(*) AS n_docs
    FROM documents JOIN lookup USING (lang)
    GROUP BY language
""")
def memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load_table(spark, sf_dir, "documents").select("lang")
    named = attach_lookup(documents, LANGUAGES, "lang string, language string", on="lang")
    return profile(named, ["language"], rows="n_docs")


@query("""
    SELECT doc_id, lang, n_chars * 0.1::DOUBLE AS tenth,
           CASE WHEN n_chars > 900 THEN 'Long' ELSE 'Short' END AS level
    FROM documents WHERE n_chars > 300
""")
def filter_and_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_derive(
        load_table(spark, sf_dir, "documents"),
        F.col("n_chars") > 300,
        keep=["doc_id", "lang"],
        derived={"tenth": F.col("n_chars") * 0.1, "level": LEVEL.column("n_chars")},
    )


@query("""
    SELECT doc_id, lang, n_chars, count(*) OVER () AS n_long
    FROM documents WHERE n_chars > 900
""")
def long_documents_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their number, both from the one run that stores them."""
    long_ones = filter_derive(
        load_table(spark, sf_dir, "documents"),
        F.col("n_chars") > 900,
        keep=["doc_id", "lang", "n_chars"],
        derived={},
    )
    rows, count = stored_and_counted(long_ones, staging_folder(spark, "counted"))
    return rows.withColumn("n_long", F.lit(count).cast("bigint"))


@query("""
    SELECT doc_id, n_chars, n_chars * 0.1::DOUBLE AS tenth
    FROM documents WHERE n_chars > 300 ORDER BY n_chars DESC, doc_id
""")
def derived_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = filter_derive(
        load_table(spark, sf_dir, "documents"),
        F.col("n_chars") > 300,
        keep=["doc_id", "n_chars"],
        derived={"tenth": F.col("n_chars") * 0.1},
    )
    return ordered(derived, F.col("n_chars").desc(), tie_breaker="doc_id")


@query("""
    SELECT doc_id, n_chars,
           CASE WHEN n_chars < 1000 THEN 'small'
                WHEN n_chars < 2500 THEN 'medium' ELSE 'large' END AS size
    FROM documents
""")
def size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return filter_derive(sizes, derived={"size": SIZE.column("n_chars")})


@query("""
    SELECT source, count(*) AS n_docs, avg(n_chars) AS avg_n_chars,
           min(n_chars) AS min_n_chars, max(n_chars) AS max_n_chars,
           sum(n_chars)::BIGINT AS sum_n_chars
    FROM documents GROUP BY source
""")
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(
        load_table(spark, sf_dir, "documents"),
        ["source"],
        {"n_chars": ["avg", "min", "max", "sum"]},
        rows="n_docs",
    )


@query("""
    SELECT source, count(*) AS n_docs, avg(n_chars) AS avg_n_chars
    FROM documents GROUP BY source ORDER BY avg_n_chars DESC, source
""")
def profile_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile(
        load_table(spark, sf_dir, "documents"),
        ["source"],
        {"n_chars": "avg"},
        rows="n_docs",
    )
    return ordered(stats, F.col("avg_n_chars").desc(), tie_breaker="source")


@query("""
    SELECT doc_id, lang, quality, n_chars FROM documents JOIN labels USING (doc_id)
""")
def join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_on_key(
        load_table(spark, sf_dir, "documents"),
        load_table(spark, sf_dir, "labels"),
        on="doc_id",
    )
    return joined.select("doc_id", "lang", "quality", "n_chars")


RANK_TRIO_SQL = """
    SELECT doc_id, source, n_chars,
           rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS size_rank,
           dense_rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS size_dense_rank,
           row_number() OVER (
               PARTITION BY source ORDER BY n_chars DESC, doc_id) AS size_row_number
    FROM documents
"""
TRIO = RankNames("size_rank", "size_dense_rank", "size_row_number")


@query(RANK_TRIO_SQL)
def rank_trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "n_chars"
    )
    return rank_within_balanced(documents, ["source"], "n_chars", "doc_id", names=TRIO)


@query(RANK_TRIO_SQL)
def rank_trio_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks with every source of 40 documents or more cut into slices."""
    documents = load_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "n_chars"
    )
    return rank_within_balanced(
        documents, ["source"], "n_chars", "doc_id", names=TRIO, hot_rows=40, slice_rows=200
    )


@query(RANK_TRIO_SQL + " ORDER BY source, size_rank, doc_id")
def ranks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(rank_trio(spark, sf_dir), "source", "size_rank", tie_breaker="doc_id")


CATEGORY_SQL = """
    SELECT doc_id, n_chars,
           CASE WHEN n_chars >= 1000 THEN 'High'
                WHEN n_chars >= 300 THEN 'Medium'
                WHEN n_chars IS NOT NULL THEN 'Low' END AS category
    FROM documents
"""


@query(CATEGORY_SQL)
def category_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_derive(
        load_table(spark, sf_dir, "documents"),
        keep=["doc_id", "n_chars"],
        derived={"category": CATEGORY.column("n_chars")},
    )


@query(CATEGORY_SQL)
def category_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_derive(
        load_table(spark, sf_dir, "documents"),
        keep=["doc_id", "n_chars"],
        derived={"category": arrow_bands(CATEGORY)("n_chars")},
    )


def category_of(n_chars: int) -> str:
    """The category of one value, as a plain Python function."""
    return next((label for cut, label in CATEGORY.cuts if n_chars >= cut), CATEGORY.otherwise)


@query(CATEGORY_SQL)
def category_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function called once for each distinct value of a batch."""
    return filter_derive(
        load_table(spark, sf_dir, "documents"),
        keep=["doc_id", "n_chars"],
        derived={"category": null_safe_udf(category_of)("n_chars")},
    )


@query(CATEGORY_SQL + " ORDER BY n_chars DESC, doc_id")
def category_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(
        category_native(spark, sf_dir), "n_chars", ascending=False, tie_breaker="doc_id"
    )


@query(CATEGORY_SQL + " ORDER BY n_chars DESC, doc_id")
def category_by_value_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function's results in order, without calling it again for the bounds."""
    return ordered_once(
        category_by_value(spark, sf_dir), "n_chars", ascending=False, tie_breaker="doc_id"
    )


@query("""
    WITH banded AS (
        SELECT source, n_chars,
               CASE WHEN n_chars < 300 THEN 'small'
                    WHEN n_chars < 1000 THEN 'medium' ELSE 'large' END AS size
        FROM documents)
    SELECT source,
           avg(n_chars) FILTER (size = 'small') AS small_avg_chars,
           nullif(count(*) FILTER (size = 'small'), 0) AS small_count,
           avg(n_chars) FILTER (size = 'medium') AS medium_avg_chars,
           nullif(count(*) FILTER (size = 'medium'), 0) AS medium_count,
           avg(n_chars) FILTER (size = 'large') AS large_avg_chars,
           nullif(count(*) FILTER (size = 'large'), 0) AS large_count
    FROM banded GROUP BY source
""")
def pivot_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = filter_derive(
        load_table(spark, sf_dir, "documents"),
        keep=["source", "n_chars"],
        derived={"size": PIVOT_SIZE.column("n_chars")},
    )
    return pivot_measures(
        banded,
        ["source"],
        "size",
        PIVOT_SIZE.labels,
        {"avg_chars": F.avg("n_chars"), "count": F.count(F.lit(1))},
        other=REFUSE,
    )


def labelled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents beyond 300 characters, by language and source."""
    labelled = join_on_key(
        load_table(spark, sf_dir, "documents").filter(F.col("n_chars") > 300),
        load_table(spark, sf_dir, "labels"),
        on="doc_id",
    )
    return profile(
        labelled,
        ["lang", "source"],
        {"n_chars": "avg", "quality": "sum"},
        rows="n_docs",
    )


@query("""
    WITH stats AS (
        SELECT lang, source, count(*) AS n_docs, avg(n_chars) AS avg_n_chars,
               sum(quality)::BIGINT AS sum_quality
        FROM documents JOIN labels USING (doc_id)
        WHERE n_chars > 300 GROUP BY lang, source)
    SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_docs DESC) AS source_rank
    FROM stats
""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored, so that join and aggregate run once for both uses below
    stats = stored(labelled_stats(spark, sf_dir), staging_folder(spark, "flagship"))
    # ranks each distinct count once, so a language with a source for every web
    # host isn't sorted as a whole in one task
    ranks = rank_values_balanced(stats, ["lang"], "n_docs", names=RankNames(rank="source_rank"))
    ranks = ranks.select(
        F.col("lang").alias("ranked_lang"), F.col("n_docs").alias("ranked_docs"), "source_rank"
    )
    same = F.col("lang").eqNullSafe(F.col("ranked_lang"))
    joined = stats.join(ranks, same & (F.col("n_docs") == F.col("ranked_docs")))
    return joined.select(*stats.columns, "source_rank")
