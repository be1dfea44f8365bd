"""Helpers shared by the operators: Arrow batches in tasks, stored tables, names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.staging import staging_folder

# Ids sent to all executors at most, 16 MB; longer lists are joined by a shuffle.
LOOKUP_ROWS = 2_000_000
# A batch that reaches Python holds up to 10,000 rows; work on it in pieces.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, text: str, piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``piece_bytes`` text, one row at least."""
    if batch.num_rows == 0:
        return
    lengths = np.zeros(batch.num_rows, dtype=np.int64)
    column = batch.column(batch.schema.get_field_index(text))
    known = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    lengths[known] = sizes[known]
    marks = np.cumsum(lengths) // piece_bytes
    starts = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1, [batch.num_rows]])
    for first, end in zip(starts[:-1], starts[1:]):
        if end > first:
            yield batch.slice(int(first), int(end - first))


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The text column as Python strings, null as the empty text."""
    column = batch.column(batch.schema.get_field_index(text))
    return ["" if value is None else value for value in column.to_pylist()]


def map_pieces(
    df: DataFrame,
    text: str,
    function: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    keep: Sequence[str],
    outputs: str,
    prepare: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Add Python-made columns to ``keep``, a piece of a batch at a time.

    ``prepare`` builds the function in the task, for what is costly to send.
    ``outputs`` is the schema of the new columns, in the order of the dict.
    """
    source = df.select(*(f"`{name}`" for name in dict.fromkeys([*keep, text])))
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function if prepare is None else prepare()
        for batch in batches:
            for piece in pieces(batch, text, piece_bytes):
                made = work(piece)
                kept = {k: piece.column(piece.schema.get_field_index(k)) for k in keep}
                yield pa.RecordBatch.from_pydict({**kept, **made})

    return source.mapInArrow(run, f"{fields}, {outputs}" if fields else outputs)


def lists(flat: np.ndarray, counts: Sequence[int], kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    if offsets[-1] < 2**31:
        return pa.ListArray.from_arrays(
            pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind)
        )
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share."""
    return staging_folder(spark, purpose)


def stored(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, free of its lineage."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(ids: DataFrame) -> DataFrame:
    """A stored list of ids, broadcast if its counted size is within the bound."""
    return F.broadcast(ids) if ids.count() <= LOOKUP_ROWS else ids


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sum_long(column: Column | str) -> Column:
    """A sum as bigint, 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
