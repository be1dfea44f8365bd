"""Parquet tables with a checked schema, and small in-memory lookup tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TABLE_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, "
    "c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, "
    "p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
    "l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, "
    "event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def check_schema(df: DataFrame, expected: str | StructType, name: str) -> None:
    """Raise ``ValueError`` unless ``df`` has every expected column and type."""
    wanted = StructType.fromDDL(expected) if isinstance(expected, str) else expected
    found = {field.name: field.dataType.simpleString() for field in df.schema}
    problems = [
        f"{field.name}: expected {field.dataType.simpleString()}, "
        f"found {found.get(field.name, 'nothing')}"
        for field in wanted
        if found.get(field.name) != field.dataType.simpleString()
    ]
    if problems:
        raise ValueError(f"table {name!r}: " + "; ".join(problems))


def load_table(
    spark: SparkSession, directory: str, name: str, schema: str | None = None
) -> DataFrame:
    """Scan ``directory/name.parquet`` and check it against its known schema.

    The types come from the files themselves, so a changed file raises here
    instead of reading as nulls. Columns and filters are left to Catalyst,
    which pushes both into the scan.
    """
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    check_schema(df, schema or TABLE_SCHEMAS[name], name)
    return df


def lookup_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: str | StructType
) -> DataFrame:
    """Turn positional tuples into a table with explicit types.

    For small reference data held in the program. The rows travel as one Arrow
    table, which Spark keeps as a local relation of known size.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = list(rows)
    wrong = [row for row in rows if len(row) != len(struct)]
    if wrong:
        raise ValueError(f"expected {len(struct)} values per row, got {wrong[0]!r}")
    arrow_schema = to_arrow_schema(struct)
    columns = [
        pa.array([row[i] for row in rows], type=field.type)
        for i, field in enumerate(arrow_schema)
    ]
    return spark.createDataFrame(pa.table(columns, schema=arrow_schema), struct)
