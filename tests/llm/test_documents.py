"""Near-duplicates, fingerprints, licenses and mixing against brute force."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import license_scan, merkle, mixing, ngram_join, queries
from framewright.llm.components import components
from tests.llm.conftest import EDGE_ROWS

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    """Smallest linked id of each (id, set) row; rows of one id are one node."""
    least = {i: i for i, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, (i, s) in enumerate(rows):
        for j, t in rows[:n]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: find(i) for i in least}


def families(seed):
    """Chains of near copies, copies, texts that share a passage, and lone texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    passage, rows = [word() for _ in range(30)], []
    for _ in range(8):
        words = [word() for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 9)):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 90)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words = [*words, *(word() for _ in range(len(words) // 6))]
    rows += [" ".join([*passage, *(word() for _ in range(rng.randint(5, 40)))]) for _ in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [2048, 3])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", blocks)
    texts = families(blocks)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r for r in ngram_join.near_duplicates(df).collect()}
    wanted = brute_components([(i, shingles(t)) for i, t in enumerate(texts)])
    assert {i: r["component_id"] for i, r in found.items()} == wanted
    assert all(r["n_shingles"] == len(shingles(texts[i])) for i, r in found.items())


def test_near_duplicates_on_edge_rows(edge, nothing):
    rows = ngram_join.near_duplicates(edge).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(EDGE_ROWS)
    assert found[2] == (0, 2) and found[3] == (0, 3) and found[4] == (0, 4)
    assert found[7] == found[8] == found[9] == (1, 7)
    assert found[None] == (4, None) and found[1][1] == 1
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 5, 6, 7])


def test_signatures_never_rule_out_a_link():
    rng = random.Random(7)
    import numpy as np

    for _ in range(200):
        pool = np.array([rng.getrandbits(64) for _ in range(rng.randint(2, 300))], dtype=np.uint64)
        a = np.unique(pool[: max(1, int(len(pool) * rng.uniform(0.6, 1)))])
        b = np.unique(pool[int(len(pool) * rng.uniform(0, 0.3)) :])
        if not len(b):
            continue
        one, other = ngram_join.signature(a), ngram_join.signature(b)
        size = min(len(one), len(other))
        apart = np.bitwise_count(ngram_join.folded(one, size) ^ ngram_join.folded(other, size)).sum()
        shared = len(np.intersect1d(a, b))
        linked = 100 * shared >= 75 * (len(a) + len(b) - shared)
        assert ngram_join.links(a, b) == (linked and shared > 0)
        if linked:
            assert ngram_join.may_link(np.array([apart]), np.array([len(a) + len(b)]))[0]


def test_first_shared_shingle_lies_in_lead_and_prefix():
    """For the smallest overlap that links two sizes, and so for any larger one."""
    for a in range(1, 120):
        for b in range(a, 160):
            for shared in range(1, a + 1):
                if 100 * shared >= 75 * (a + b - shared):
                    assert a - shared < ngram_join.lead_length(a) <= ngram_join.prefix_length(a)
                    assert b - shared < ngram_join.prefix_length(b)
                    assert a != b or b - shared < ngram_join.lead_length(b)
                    break


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201)]
    found = components(spark.createDataFrame(edges + [(5, 5)], "a bigint, b bigint"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints_locate_edits():
    text = "First line here.\nSecond line, longer than the first one. It has more.\n\nThird part.\n" * 3
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1.0
    assert merkle.differences(merkle.fingerprint(text), merkle.fingerprint(text)) == []
    changed = text.replace("It has more.", "It has less.", 1)
    one, other = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert one != other and 0.8 < merkle.likeness(one, other) < 1
    found = merkle.differences(one, other)
    assert ("paragraph", (1, 2), (1, 2)) in found
    assert [x for x in found if x[0] == "leaf"] == [("leaf", (2, 3), (2, 3))]
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0.0


def check_edits(rows, texts):
    """Rows of neighbour_edits against (id, text) in their order."""
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    for n, (key, text) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        row = next(r for r in found[key] if r["edited_sha256"] == digest)
        found[key].remove(row)
        assert row["n_chars"] == len(text)
        assert row["fingerprint"] == merkle.fingerprint(text)
        assert row["edited_fingerprint"] == merkle.fingerprint(changed)
        assert row["near_edited"] == merkle.likeness(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_next"] == merkle.likeness(row["fingerprint"], merkle.fingerprint(after))
    assert not any(found.values())


def test_op9_query(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in documents), reverse=True)
    check_edits(queries.op9_fingerprints(spark, SMALL).collect(), texts)


def test_neighbour_edits_on_edge_rows(edge, nothing):
    known = sorted(((r[0], r[1] or "") for r in EDGE_ROWS if r[0] is not None), key=lambda r: (-r[0], r[1]))
    texts = known + [(None, r[1] or "") for r in EDGE_ROWS if r[0] is None]
    check_edits(merkle.neighbour_edits(edge).collect(), texts)
    assert merkle.neighbour_edits(nothing).count() == 0
    alone = edge.filter("doc_id is null")
    check_edits(merkle.neighbour_edits(alone).collect(), texts[-1:])
    assert merkle.fingerprints(edge).count() == len(EDGE_ROWS)


def brute_licenses(text, share=0.75):
    """Templates of which a window a little longer holds enough shingles."""
    words = license_scan.without_marks(text or "").decode().split()
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    own = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
    found = set()
    for name, template in license_scan.TEMPLATES.items():
        t = [w.lower() for w in license_scan.without_marks(template).decode().split()]
        wanted = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        length = len(t) - 4
        stride = max(1, length // 4)
        for first in range(0, max(1, len(own)), stride):
            if len(wanted & set(own[first : first + length + stride])) >= share * len(wanted):
                found.add(name)
    return found


def test_licenses_are_those_of_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for template in license_scan.TEMPLATES.values():
        for _ in range(6):
            words = template.split()
            for _ in range(rng.randint(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = "changed"
            filler = [f"w{rng.randrange(999)}" for _ in range(rng.randint(0, 60))]
            cut = rng.randint(0, len(filler))
            texts.append(" ".join([*filler[:cut], *words, *filler[cut:]]))
    rows = [*enumerate(texts), (998, None), (999, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {}
    for r in license_scan.scan(df).collect():
        found.setdefault(r["doc_id"], set()).add(r["template"])
    assert found == {i: b for i, t in rows if (b := brute_licenses(t))}


@pytest.mark.parametrize("leader", ["# ", " * ", "// ", "-- ", ";; ", "> ", "# \u201c"])
def test_licenses_in_commented_headers(spark, leader):
    wrapped = {n: textwrap.wrap(t.replace('"', "\u201d"), 60) for n, t in license_scan.TEMPLATES.items()}
    rows = [(n, "\n".join(["/*\u201c\u201d", *(leader + x for x in lines), " */ end"])) for n, lines in wrapped.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = {(r["doc_id"], r["template"]): r for r in license_scan.scan(df).collect()}
    for name, text in rows:
        row = found[name, name]
        assert row["share"] == 1.0
        assert text[row["start"] :].startswith(wrapped[name][0][:8])
        assert text[: row["end"]].endswith(wrapped[name][-1].rstrip(".")[-4:])


def test_licenses_on_edge_rows(edge, nothing):
    assert license_scan.scan(edge).count() == 0
    assert license_scan.scan(nothing).count() == 0
    marked = edge.withColumn("text", F.lit("x y z (Licensed under the Apache License, Version 2.0)."))
    row = license_scan.scan(marked).first()
    assert (row["template"], row["start"], row["end"], row["share"]) == ("Apache-2.0", 7, 53, 1.0)


def test_mix_on_edge_rows(edge, nothing):
    planned = mixing.repetitions(edge).collect()
    assert len(planned) == len(EDGE_ROWS)
    assert mixing.repetitions(edge).exceptAll(mixing.repetitions(edge)).isEmpty()
    copies = {}
    for r in planned:
        assert 0 <= r["copies"] <= 3 and r["target"] <= 3 * r["source_size"]
        copies.setdefault(r["doc_id"], set()).add(r["copies"])
    assert all(len(c) == 1 for c in copies.values())
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    assert mixed.count() == sum(r["copies"] for r in planned)
    assert mixing.mix(nothing).count() == 0


def test_targets_fill_up_in_order(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 2 + ["b"] * 40 + [None] * 3 + ["c"] * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    # a weighs 5 and stops at 60, null weighs 5 and stops at 90; b and c share 350 as 2 to 1
    assert got["a"] == 60 and got[None] == 90
    assert sum(got.values()) == pytest.approx(500)
    assert got["c"] == pytest.approx(350 / 3) and got["b"] == pytest.approx(700 / 3)


def plain_pieces(paragraph):
    """Runs of up to LEAF_CHARACTERS without end marks, with the end marks and blanks after them."""
    found, at = [], 0
    while at < len(paragraph):
        end = at
        while end < len(paragraph) and paragraph[end] not in ".!?" and end - at < merkle.LEAF_CHARACTERS:
            end += 1
        if end < len(paragraph) and paragraph[end] in ".!?":
            while end < len(paragraph) and paragraph[end] in ".!?":
                end += 1
            while end < len(paragraph) and paragraph[end].isspace():
                end += 1
        found.append(paragraph[at:end])
        at = end
    return found


def plain_tree(text):
    """(digest, children) of the root, hashed up from the leaves without the operator."""

    def node(children):
        data = b"".join(child[0] for child in children)
        return hashlib.blake2b(data, digest_size=16).digest(), children

    *ended, last = text.split("\n")
    lines = [line + "\n" for line in ended] + ([last] if last else [])
    sections, own = [], []
    for line in lines:
        leaves = [(hashlib.blake2b(p.encode(), digest_size=16).digest(), p) for p in plain_pieces(line)]
        own.append(node(leaves))
        if not line.strip() or int(own[-1][0][:5].hex(), 16) % merkle.SECTION_ONE_IN == 0:
            sections.append(node(own))
            own = []
    if own:
        sections.append(node(own))
    return node(sections)


def test_hashes_go_up_from_the_leaves():
    rng = random.Random(21)
    texts = ["", "\n", "One. Two!", "a\n\nb"]
    for _ in range(60):
        texts.append("".join(rng.choices(["word ", "é", "x" * 40, ". ", "?! ", "\n", "\n\n"], k=rng.randint(1, 200))))
    for text in texts:
        root, sections = plain_tree(text)
        shown, _, rest = merkle.fingerprint(text).partition("/")
        assert shown == root.hex()
        parts = rest.split(";") if rest else []
        assert [p.partition("=")[0] for p in parts] == [d[:6].hex() for d, _ in sections]
        for part, (_, paragraphs) in zip(parts, sections):
            marks = [p.partition(":")[0] for p in part.partition("=")[2].split(",")]
            assert marks == [d[:5].hex() for d, _ in paragraphs]
        # a branch: leaves of one paragraph and its siblings' hashes give the root
        for i, (_, paragraphs) in enumerate(sections):
            for j, (_, leaves) in enumerate(paragraphs):
                node = merkle.node_digest(merkle.leaf_digest(p) for _, p in leaves)
                node = merkle.node_digest(node if k == j else d for k, (d, _) in enumerate(paragraphs))
                assert merkle.node_digest(node if k == i else d for k, (d, _) in enumerate(sections)) == root
