"""The Merkle manifest against a tree built by plain recursion."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from framewright.llm import manifest
from tests.llm.conftest import EDGE_ROWS


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def build(nodes):
    """A node of a tree: its hash, and for each leaf below the (left, right) strings up to it."""
    trees = [(node, [()]) for node in nodes]
    while len(trees) > 1:
        merged = []
        for start in range(0, len(trees), 8):
            run = trees[start : start + 8]
            paths = []
            for i, (_, below) in enumerate(run):
                sides = "".join(n for n, _ in run[:i]), "".join(n for n, _ in run[i + 1 :])
                paths += [(*path, sides) for path in below]
            merged.append((h("".join(n for n, _ in run)), paths))
        trees = merged
    return trees[0]


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows in the order of FIELDS."""
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    order = sorted(parts, key=lambda part: (part is not None, (part or "").encode()))
    for part in order:
        parts[part].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [build([leaf(r) for r in parts[part]]) for part in order]
    root, above = build([subroot for subroot, _ in trees])
    found = []
    for part, (subroot, paths), top in zip(order, trees, above):
        for row, path in zip(parts[part], paths):
            path = (*path, *top)
            node, (key, *_, text) = leaf(row), row
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and text is not None:
                node = leaf((*row[:-1], re.sub("[A-Z]", lambda m: m[0].lower(), text)))
            for left, right in path:
                node = h(left + node + right)
            found.append(
                (row[0], leaf(row), subroot, root, h("".join(a + b for a, b in path)), node)
            )
    return found


def table(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"
    )


def proven(df, **options):
    altered = manifest.tampered_leaf(manifest.FIELDS, "doc_id", "text")
    return [tuple(r) for r in manifest.manifest(df, altered=altered, **options).collect()]


@pytest.mark.parametrize("span", [1, 4])
def test_proofs_are_those_of_plain_recursion(spark, span):
    rng = random.Random(span)
    sizes = {None: 65, "": 1, "de": 8, "en": 700, "z": 9, "é": 2, "a": 64, "b": 3, "c": 1, "d": 1}
    rows = [
        (rng.getrandbits(60), rng.choice([None, "s", "ü"]), lang, rng.choice([None, 7]), f"Text {i} É")
        for lang, count in sizes.items()
        for i in range(count)
    ]
    rows += [(5, "s", "en", 1, "Same")] * 20 + [(5, "s", "en", 1, "Other")]
    rng.shuffle(rows)
    found = proven(table(spark, rows).repartition(5), span=span)
    assert sorted(repr(r[:-1]) for r in found) == sorted(map(repr, brute(rows)))
    assert all(r[-1] == (r[-2] == r[3]) for r in found)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_more_leaves_than_a_superblock(spark):
    rows = [(i, None, "en", i, f"Row {i}") for i in range(manifest.FANOUT**manifest.SPAN + 5)]
    found = proven(table(spark, rows))
    assert sorted(repr(r[:-1]) for r in found) == sorted(map(repr, brute(rows)))


def test_edge_rows(spark, edge, nothing):
    df = edge.withColumn("n_chars", F.length("text").cast("bigint"))
    rows = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in EDGE_ROWS]
    found = proven(df)
    assert sorted(repr(r[:-1]) for r in found) == sorted(map(repr, brute(rows)))
    assert proven(nothing.withColumn("n_chars", F.lit(1).cast("bigint"))) == []


def test_without_alteration_all_are_verified(spark):
    rows = [(i, "s", "en", 1, "Text") for i in range(30)]
    assert all(r["verified"] for r in manifest.manifest(table(spark, rows)).collect())


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 8**20, 8**20 + 1])
def test_height_is_exact(spark, count):
    found = spark.range(1).select(manifest.height_of(F.lit(count))).first()[0]
    assert 8**found >= count and (found == 0 or 8 ** (found - 1) < count)
