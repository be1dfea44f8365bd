"""Near-duplicate embeddings by a subspace pigeonhole join (operator 4).

Vectors of one label link when their cosine is high enough, that is, when the squared
distance of their directions is within a budget. The directions are turned by a fixed
orthogonal matrix and cut into blocks; each block gets a share of the budget in
proportion to its dimensions. A pair within the whole budget keeps within its share in
some block, so it is enough to range-join each block: by a grid over the block's first
two dimensions, cells as wide as the share allows, and the distance over the block. The
union of what the blocks find is decided on the vectors themselves, in double precision.

Equal vectors of one label are one node with a count, so copies are never paired. Cells
with many vectors are cut, a task for each pair of parts; no pair is left out.

Vectors that are null, zero, or hold nulls, NaN or infinities link with nothing, as do
vectors without label or id; without id a row has no component and isn't kept. Vectors of
different lengths don't link. Rows repeating an id count as vectors of their own. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import stored
from framewright.llm.components import components

COSINE = 0.98
BLOCK_DIMENSIONS = 8
SLACK = 1e-6  # of squared distances, over the error of single precision
PART_ROWS = 4096
SEED = 20_26
_FORWARD = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks_of(dimensions: int) -> list[np.ndarray]:
    """The dimensions of each block, as even as possible."""
    return np.array_split(np.arange(dimensions), max(1, dimensions // BLOCK_DIMENSIONS))


def _usable(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as packed doubles; null if it can't link."""
    for batch in batches:
        vectors = batch.column(1).to_pylist()
        made = []
        for vector in vectors:
            packed = None
            if vector and None not in vector:
                values = np.array(vector, dtype=np.float64)
                if np.isfinite(values).all() and values.any():
                    packed = (values + 0.0).tobytes()  # no negative zeros
            made.append(packed)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(made, pa.binary())],
            names=["id", "label", "vector"],
        )


def _to_cells(cosine: float):
    budget = 2 - 2 * cosine

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            labels = batch.column(1)
            data = [np.frombuffer(v, dtype=np.float64) for v in batch.column(2).to_pylist()]
            sizes = np.array([len(v) for v in data])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                matrix = turned.setdefault(size, rotation(size))
                values = np.stack([data[r] for r in rows.tolist()])
                values = values / np.abs(values).max(axis=1, keepdims=True)
                values = values / np.linalg.norm(values, axis=1, keepdims=True) @ matrix
                for number, own in enumerate(blocks_of(size)):
                    share = budget * len(own) / size + SLACK
                    block = values[:, own].astype(np.float32)
                    cells = np.floor(values[:, own[:2]] / np.sqrt(share)).astype(np.int32)
                    second = cells[:, 1] if cells.shape[1] > 1 else np.zeros(len(rows), np.int32)
                    packed = pa.array([x.tobytes() for x in block], pa.binary())
                    for dx, dy in _FORWARD:
                        if dy and cells.shape[1] == 1:
                            continue
                        yield pa.RecordBatch.from_pydict(
                            {
                                "label": labels.take(pa.array(rows)),
                                "size": pa.array(np.full(len(rows), size, np.int32)),
                                "block": pa.array(np.full(len(rows), number, np.int32)),
                                "x": pa.array(cells[:, 0] + np.int32(dx)),
                                "y": pa.array(second + np.int32(dy)),
                                "guest": pa.array(np.full(len(rows), bool(dx or dy))),
                                "id": pa.array(ids[rows], pa.int64()),
                                "share": pa.array(np.full(len(rows), share)),
                                "values": packed,
                            }
                        )

    return run


_CELL = ["label", "size", "block", "x", "y"]


def _within_cells(cells: DataFrame) -> DataFrame:
    """Pairs within a block's share of the budget."""
    crowded = cells.filter("not guest").groupBy(*_CELL).count().filter(F.col("count") > PART_ROWS)
    parts = F.ceil(F.coalesce("count", F.lit(1)) / PART_ROWS).cast("int")
    cut = cells.join(crowded, _CELL, "left").withColumn("parts", parts)
    met = cut.withColumns(
        {
            "own": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"),
            "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
        }
    ).select(
        *_CELL, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        "own", "guest", "id", "share", "values",
    )
    keys = [*_CELL, "p", "q"]
    ordered = met.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_compare_cells, "a bigint, b bigint")


def _compare_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*_CELL, "p", "q", "own", "guest", "id", "share", "values"]
    held: list[tuple] = []
    current = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        for row in zip(*columns):
            if row[:7] != current:
                yield from _compare_cell(held)
                held, current = [], row[:7]
            held.append(row[7:])
    yield from _compare_cell(held)


def _compare_cell(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if len(rows) < 2:
        return
    own, guest, ids, share, data = (list(c) for c in zip(*rows))
    own, guest, ids = np.array(own), np.array(guest), np.array(ids, dtype=np.int64)
    values = np.frombuffer(b"".join(data), dtype=np.float32).reshape(len(rows), -1)
    apart = len(np.unique(own)) > 1
    found_a, found_b = [], []
    home = np.flatnonzero(~guest)
    step = max(1, 2_000_000 // values.size)
    for first in range(0, len(home), step):
        some = home[first : first + step]
        far = ((values[some, None, :] - values[None, :, :]) ** 2).sum(axis=2)
        near = (far <= share[0]) & (guest[None, :] | (ids[None, :] > ids[some, None]))
        if apart:  # two parts of a cell: pairs within one are found elsewhere
            near &= own[None, :] != own[some, None]
        i, j = np.nonzero(near)
        found_a.append(ids[some[i]])
        found_b.append(ids[j])
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if len(a):
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}
            )


def _really(cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            passed = []
            for x, y in pairs:
                one, other = np.frombuffer(x), np.frombuffer(y)
                # scaled first, so that squares neither overflow nor vanish
                one, other = one / np.abs(one).max(), other / np.abs(other).max()
                norm = np.sqrt(one @ one) * np.sqrt(other @ other)
                passed.append(bool(one @ other / norm >= cosine))
            keep = pa.array(passed, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"]
            )

    return run


def near_duplicates(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of each row."""
    kind = df.schema[label].dataType.simpleString()
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector), F.col(label))
    rows = source.mapInArrow(_usable, f"id bigint, label {kind}, vector binary")
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = stored(rows.withColumn("able", able), "vectors")
    nodes = rows.filter("able").groupBy("label", "vector").agg(
        F.min("id").alias("node"), F.count("*").alias("copies")
    )
    # several vectors may repeat an id: nodes need numbers of their own
    nodes = nodes.withColumn("name", F.xxhash64("label", "vector"))
    nodes = stored(nodes, "vector-nodes")
    cells = nodes.select("name", "label", "vector").mapInArrow(
        _to_cells(cosine),
        f"label {kind}, size int, block int, x int, y int, guest boolean, id bigint, "
        "share double, values binary",
    )
    candidates = _within_cells(stored(cells, "vector-cells")).distinct()
    a, b = (nodes.select(F.col("name").alias(x), F.col("vector").alias(f"v{x}")) for x in "ab")
    checked = candidates.join(a, "a").join(b, "b").select("a", "b", "va", "vb")
    links = stored(checked.mapInArrow(_really(cosine), "a bigint, b bigint"), "vector-links")

    both = links.union(links.select("b", "a"))
    others = both.join(nodes.select(F.col("name").alias("b"), "copies"), "b").groupBy("a").agg(
        F.sum("copies").alias("linked")
    )
    found = components(links)
    grouped = nodes.join(found, nodes["name"] == found["node"], "left").select(
        "label", "vector", "name", "copies", nodes["node"], F.coalesce("component", "name").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min(nodes["node"]).alias("least"))
    described = (
        grouped.join(least, "component")
        .join(others, grouped["name"] == others["a"], "left")
        .select(
            "name", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "least"
        )
    )
    named = rows.withColumn("name", F.when(F.col("able"), F.xxhash64("label", "vector")))
    result = named.select("id", "name").join(described, "name", "left")
    component = F.coalesce("least", "id")
    return result.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
