"""Merkle manifest of a dataset (operator 13).

Each row is a leaf, the hash of its fields. The leaves of one part of the table (a
language), ascending by key, are the lowest level of a tree: every ``FANOUT``
consecutive nodes, the last run perhaps fewer, become the hash of their hex digests
until one is left, the part's subroot. The subroots, ordered by part, give the root.

Trees are built and proven in superblocks of ``FANOUT ** SPAN`` nodes. On the way up,
a superblock leaves its task as one node, so each round shrinks the table by that
factor. On the way down, nodes and the outer nodes that their superblock needs (the
siblings above it) are cogrouped by superblock; each task redoes its local levels,
joins local and outer siblings to proofs, and folds them. No task holds more than one
superblock, and nothing but counts reaches the driver.

A null field enters a leaf as ``-``, others as byte count, colon and value, so no two
rows share an encoding. A null part is a part of its own, the first; null keys come
first in their part. Rows with one key are ordered by their leaf; fully equal rows
are leaves of equal digests, whose order doesn't matter. An empty table gives no rows.
Texts of any length are hashed in the JVM and never shuffled. Columns beside the
fields play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import looked_up, stored
from framewright.llm.ordering import numbered

FANOUT = 8
SPAN = 4  # levels of a superblock: 4,096 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OUTER = "tree bigint, place bigint, before array<string>, after array<string>, top string"


def digest(parts: Iterable[str]) -> str:
    """The lowercase hex sha256 of the parts put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """The hash of a row's fields; each states its length, so none can run into the next."""
    texts = [field.cast("string") for field in fields]
    marked = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*marked), 256)


def tampered_leaf(fields: Sequence[str], key: str, text: str) -> Column:
    """The leaf once the text's A-Z are lower-cased, for a third of the keys; else null."""
    changed = [F.translate(f, UPPER, LOWER) if f == text else F.col(f) for f in fields]
    drawn = F.crc32(F.col(key).cast("string")) % 3 == 0
    return F.when(drawn, leaf_of(changed))


def height_of(count: Column) -> Column:
    """Levels above the leaves of a tree of so many: ceil(log8(count)), exactly."""
    steps = [(count > FANOUT**k).cast("int") for k in range(21)]
    return sum(steps[1:], steps[0])


def levels_above(nodes: Sequence[str], steps: int) -> list[list[str]]:
    """The nodes, and each of ``steps`` levels above them."""
    levels = [list(nodes)]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def siblings_in(levels: Sequence[Sequence[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands before and after a node's line of descent, on each level but the top."""
    before, after = [], []
    for level in levels[:-1]:
        first = place - place % FANOUT
        before.append("".join(level[first:place]))
        after.append("".join(level[place + 1 : first + FANOUT]))
        place //= FANOUT
    return before, after


def folded(node: str, before: Iterable[str], after: Iterable[str]) -> str:
    """The root that a node and its siblings give."""
    for left, right in zip(before, after):
        node = digest((left, node, right))
    return node


def _in_blocks(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / FANOUT**span))


def _top(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    rows = rows.sort_values("place")
    height = int(rows["height"].iloc[0])
    steps = min(span, height)
    return pd.DataFrame(
        {
            "tree": rows["tree"].iloc[:1],
            "place": rows["block"].iloc[:1],
            "height": height - steps,
            "node": levels_above(rows["node"].tolist(), steps)[-1],
        }
    )


def climbed(nodes: DataFrame, span: int = SPAN) -> list[DataFrame]:
    """Tiers of superblock tops, from the nodes given up to one node for each tree.

    At least one tier stands above the nodes, if only of lone leaves.

    ``nodes`` has ``tree``, ``place`` from 0 on, ``height`` (levels above) and ``node``.
    """
    tiers = [nodes.select("tree", "place", "height", "node")]
    schema = "tree bigint, place bigint, height int, node string"
    left = nodes.agg(F.max("height")).first()[0] or 0
    while left > 0 or len(tiers) == 1:
        blocks = _in_blocks(tiers[-1], span).groupBy("tree", "block")
        tops = blocks.applyInPandas(lambda rows: _top(rows, span), schema)
        tiers.append(stored(tops, "manifest-tier"))
        left -= span
    return tiers


def _descend(rows: pd.DataFrame, outer: pd.DataFrame, span: int) -> pd.DataFrame:
    rows = rows.sort_values("place")
    above = outer.iloc[0]
    levels = levels_above(rows["node"].tolist(), min(span, int(rows["height"].iloc[0])))
    paths = [siblings_in(levels, place) for place in range(len(rows))]
    return pd.DataFrame(
        {
            "tree": rows["tree"],
            "place": rows["place"],
            "before": [[*before, *above["before"]] for before, _ in paths],
            "after": [[*after, *above["after"]] for _, after in paths],
            "top": above["top"],
        }
    )


def outer_nodes(tiers: Sequence[DataFrame], span: int = SPAN) -> DataFrame:
    """For each node of the lowest tier given: siblings on its way up, and the top.

    ``before`` and ``after`` hold a string for each level, from the node's own up.
    """
    nothing = F.array().cast("array<string>")
    outer = tiers[-1].select(
        "tree", "place", nothing.alias("before"), nothing.alias("after"), F.col("node").alias("top")
    )
    for tier in reversed(tiers[:-1]):
        above = outer.withColumnRenamed("place", "block").groupBy("tree", "block")
        below = _in_blocks(tier, span).groupBy("tree", "block")
        joined = below.cogroup(above).applyInPandas(lambda a, b: _descend(a, b, span), _OUTER)
        outer = stored(joined, "manifest-outer")
    return outer


def _proven(rows: pd.DataFrame, outer: pd.DataFrame, span: int) -> pd.DataFrame:
    """Proofs of a superblock's leaves: local siblings, outer ones, and what they fold to."""
    rows = rows.sort_values("place")
    above = outer.iloc[0]
    nodes = rows["node"].tolist()
    levels = levels_above(nodes, min(span, int(rows["height"].iloc[0])))
    proofs, roots = [], []
    for place, (node, altered) in enumerate(zip(nodes, rows["altered"])):
        before, after = siblings_in(levels, place)
        before, after = [*before, *above["before"]], [*after, *above["after"]]
        proofs.append(digest(left + right for left, right in zip(before, after)))
        roots.append(folded(node if altered is None else altered, before, after))
    return pd.DataFrame(
        {
            "name": rows["name"],
            "leaf": nodes,
            "subroot": above["subroot"],
            "root": above["top"],
            "proof_sha256": proofs,
            "folded_root": roots,
        }
    )


def manifest(
    df: DataFrame,
    key: str = "doc_id",
    part: str = "lang",
    fields: Sequence[str] = FIELDS,
    altered: Column | None = None,
    span: int = SPAN,
) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``altered`` is the leaf that a row shows now, null where it is the one that the
    tree was built from; proofs are folded from it, and verified against the root.
    """
    key_type = df.select(F.col(key)).schema[0].dataType.simpleString()
    shown = F.lit(None).cast("string") if altered is None else altered
    leaves = stored(
        df.select(
            F.col(key).alias("key"),
            F.col(key).cast("string").alias("name"),
            F.col(part).alias("part"),
            leaf_of([F.col(f) for f in fields]).alias("node"),
            shown.alias("altered"),
            F.monotonically_increasing_id().alias("spread"),
        ),
        "manifest-leaves",
    )
    order = [F.asc_nulls_first("part"), F.asc_nulls_first("key"), F.col("node"), F.col("spread")]
    places = numbered(leaves, order, "at")
    parts = places.groupBy("part").agg(
        F.min("at").alias("first"), F.count("*").cast("bigint").alias("count")
    )
    trees = stored(
        numbered(stored(parts, "manifest-parts"), [F.col("first")], "tree").withColumn(
            "height", height_of(F.col("count"))
        ),
        "manifest-trees",
    )
    named = looked_up(trees.select(F.col("part").alias("of"), "tree", "first", "height"))
    placed = stored(
        places.join(named, F.col("part").eqNullSafe(F.col("of"))).select(
            "tree", (F.col("at") - F.col("first")).alias("place"), "height", "name", "node", "altered"
        ),
        "manifest-placed",
    )
    tiers = climbed(placed, span)
    subroots = tiers[-1].select("tree", F.col("node"))
    count = subroots.count()
    catalog = climbed(
        subroots.select(
            F.lit(0).cast("bigint").alias("tree"),
            F.col("tree").alias("place"),
            height_of(F.lit(count)).alias("height"),
            "node",
        ),
        span,
    )
    across = outer_nodes(catalog, span).select(
        F.col("place").alias("tree"), F.col("before").alias("b"), F.col("after").alias("a"), "top"
    )
    blocks = outer_nodes(tiers[1:], span).withColumnsRenamed({"place": "block", "top": "subroot"})
    outer = blocks.join(across, "tree")
    outer = outer.select(
        "tree",
        "block",
        F.concat("before", "b").alias("before"),
        F.concat("after", "a").alias("after"),
        "subroot",
        "top",
    )
    schema = (
        "name string, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string"
    )  # the key as text, as pandas has no null among integers
    proven = (
        _in_blocks(placed, span)
        .groupBy("tree", "block")
        .cogroup(outer.groupBy("tree", "block"))
        .applyInPandas(lambda a, b: _proven(a, b, span), schema)
    )
    return proven.select(
        F.col("name").cast(key_type).alias(key),
        *("leaf", "subroot", "root", "proof_sha256", "folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
