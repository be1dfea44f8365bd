"""Queries over orders, their lines and their customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.measures import exact_avg
from framewright.operators.enrich import join_on_key
from framewright.operators.pivoting import pivot_measures
from framewright.operators.profile import profile
from framewright.operators.ranking import rank_values, rank_values_balanced, rank_within_balanced
from framewright.plans.registry import query
from framewright.sources.tables import load_table


@query("""
    SELECT range AS number, count(l_linenumber) AS n_lines,
           coalesce(sum(l_partkey), 0)::BIGINT AS sum_l_partkey
    FROM range(0, (SELECT max(l_linenumber) + 1 FROM lineitem)::BIGINT)
    LEFT JOIN lineitem ON l_linenumber = range
    GROUP BY range
""")
def range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and exact part totals of every number up to the largest line number."""
    lines = load_table(spark, sf_dir, "lineitem")
    largest = profile(lines, measures={"l_linenumber": "max"}, rows=None).first()[0]
    # aggregated first, so the join meets one row per number
    totals = profile(lines, ["l_linenumber"], {"l_partkey": "wide_sum"}, rows="n_lines")
    numbers = spark.range(0 if largest is None else largest + 1)
    joined = numbers.join(totals, numbers["id"] == totals["l_linenumber"], "left")
    return joined.select(
        F.col("id").alias("number"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("wide_sum_l_partkey", F.lit(0)).cast("bigint").alias("sum_l_partkey"),
    )


@query("""
    SELECT count(*) AS n_rows, sum(l_linenumber)::BIGINT AS sum_l_linenumber,
           max(l_quantity) AS max_l_quantity
    FROM lineitem
""")
def global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(
        load_table(spark, sf_dir, "lineitem"),
        measures={"l_linenumber": "sum", "l_quantity": "max"},
    )


@query("""
    SELECT l_suppkey, count(*) AS n_lines,
           sum(l_quantity::BIGINT)::DOUBLE / count(l_quantity) AS stable_avg_l_quantity
    FROM lineitem GROUP BY l_suppkey
""")
def supplier_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages that don't depend on the order of addition, and that round once."""
    lines = load_table(spark, sf_dir, "lineitem")
    return profile(lines, ["l_suppkey"], {"l_quantity": "stable_avg"}, rows="n_lines")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
           sum(l_extendedprice::DECIMAL(15,2))::DOUBLE / count(l_extendedprice)
               AS avg_price,
           min(l_extendedprice) AS min_l_extendedprice,
           max(l_extendedprice) AS max_l_extendedprice,
           avg(l_quantity) AS avg_l_quantity
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(
        load_table(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"l_extendedprice": ["min", "max"], "l_quantity": "avg"},
        rows="n_lines",
        extra={"avg_price": exact_avg("l_extendedprice", scale=2)},
    )


@query("""
    SELECT c_custkey, o_orderkey, o_totalprice, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey
""")
def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders").withColumnRenamed(
        "o_custkey", "c_custkey"
    )
    joined = join_on_key(orders, load_table(spark, sf_dir, "customer"), on="c_custkey")
    return joined.select(
        "c_custkey", "o_orderkey", "o_totalprice", "c_name", "c_mktsegment"
    )


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice,
           row_number() OVER (
               PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS row_number
    FROM orders
""")
def order_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )
    ranked = rank_within_balanced(orders, ["o_custkey"], "o_totalprice", "o_orderkey")
    return ranked.select(*orders.columns, "row_number")


@query("""
    WITH ranked AS (
        SELECT l_suppkey,
               rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r,
               dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS d
        FROM lineitem)
    SELECT l_suppkey, max(r) AS max_rank, max(d) AS max_dense_rank
    FROM ranked GROUP BY l_suppkey
""")
def line_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load_table(spark, sf_dir, "lineitem")
    ranked = rank_values(lines, ["l_suppkey"], "l_quantity")
    return profile(ranked, ["l_suppkey"], {"rank": "max", "dense_rank": "max"}, rows=None)


@query("""
    WITH ranked AS (
        SELECT l_returnflag,
               rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS r,
               dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS d
        FROM lineitem)
    SELECT l_returnflag, max(r) AS max_rank, max(d) AS max_dense_rank,
           sum(r)::BIGINT AS sum_rank, sum(d)::BIGINT AS sum_dense_rank
    FROM (SELECT DISTINCT l_returnflag, r, d FROM ranked) GROUP BY l_returnflag
""")
def price_ranks_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of prices, nearly all different, with each group cut into slices."""
    lines = load_table(spark, sf_dir, "lineitem")
    ranked = rank_values_balanced(lines, ["l_returnflag"], "l_extendedprice", slice_values=8000)
    measures = {"rank": ["max", "sum"], "dense_rank": ["max", "sum"]}
    return profile(ranked, ["l_returnflag"], measures, rows=None)


@query("""
    SELECT o_orderpriority,
           max(o_totalprice) FILTER (o_orderstatus = 'F') AS F_max_price,
           nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F_count,
           max(o_totalprice) FILTER (o_orderstatus = 'O') AS O_max_price,
           nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O_count,
           max(o_totalprice) FILTER (o_orderstatus = 'P') AS P_max_price,
           nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P_count,
           max(o_totalprice) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P'))
               AS other_max_price,
           nullif(count(*) FILTER (
               o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P')), 0) AS other_count
    FROM orders GROUP BY o_orderpriority
""")
def pivot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_measures(
        load_table(spark, sf_dir, "orders"),
        ["o_orderpriority"],
        "o_orderstatus",
        ["F", "O", "P"],
        {"max_price": F.max("o_totalprice"), "count": F.count(F.lit(1))},
        other="other",
    )


@query("""
    SELECT l_returnflag,
           sum(l_partkey) FILTER (l_linenumber = 1)::BIGINT AS l_linenumber_1_parts,
           sum(l_partkey) FILTER (l_linenumber = 2)::BIGINT AS l_linenumber_2_parts,
           sum(l_partkey) FILTER (l_linenumber = 3)::BIGINT AS l_linenumber_3_parts,
           sum(l_partkey) FILTER (l_linenumber IS NULL)::BIGINT AS l_linenumber_null_parts,
           sum(l_partkey) FILTER (l_linenumber NOT IN (1, 2, 3))::BIGINT AS later_parts
    FROM lineitem GROUP BY l_returnflag
""")
def pivot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_measures(
        load_table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        "l_linenumber",
        [1, 2, 3, None],
        {"parts": F.sum("l_partkey")},
        other="later",
    )
