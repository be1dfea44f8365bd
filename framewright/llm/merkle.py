"""Document fingerprints: Merkle trees over sections and paragraphs (operator 9).

A text is cut into paragraphs at line ends and into sections at blank lines and
after paragraphs whose hash says so, so that an edit moves no boundary elsewhere.
Within a paragraph the leaves are pieces of sentences. Each node's hash is made from its
children's, in 16 bytes; equal roots mean equal texts, and comparing children leads to
the edit.

The fingerprint is text: ``root/section=paragraph:leaf.leaf,paragraph:leaf;...``,
a leaf being 8 hex digits of hash and its length in hex.

Nulls count as the empty text, which has a root and no leaf. Repeated rows give
repeated rows. Other columns of the input play no part.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import map_pieces, texts_of
from framewright.llm.ordering import key_ranges, range_number

LEAF_CHARACTERS = 96
SECTION_ONE_IN = 8  # a paragraph in so many ends a section
_PARAGRAPHS = re.compile(r"[^\n]*\n|[^\n]+")
_PIECES = re.compile(
    r"[^.!?]{1,%d}(?:[.!?]+\s*)?|[.!?]+\s*" % LEAF_CHARACTERS
)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def leaf_digest(piece: str) -> bytes:
    return _digest(piece.encode("utf-8", "surrogatepass"))


def node_digest(children: Iterable[bytes]) -> bytes:
    """The hash of a node; all children's have one length, so their order is told, too."""
    return _digest(b"".join(children))


def fingerprint(text: str) -> str:
    """The whole tree of a text, as text.

    Hashes go up whole, from leaves to paragraphs, sections and the root; all but the
    root's are shown cut.
    """
    sections: list[tuple[bytes, str]] = []
    paragraphs: list[tuple[bytes, str]] = []

    def close() -> None:
        if paragraphs:
            own = node_digest(digest for digest, _ in paragraphs)
            body = ",".join(shown for _, shown in paragraphs)
            sections.append((own, f"{own[:6].hex()}={body}"))
            paragraphs.clear()

    for paragraph in _PARAGRAPHS.findall(text):
        pieces = _PIECES.findall(paragraph)
        digests = [leaf_digest(piece) for piece in pieces]
        own = node_digest(digests)
        leaves = ".".join(f"{d[:4].hex()}{len(p):x}" for d, p in zip(digests, pieces))
        paragraphs.append((own, f"{own[:5].hex()}:{leaves}"))
        if not paragraph.strip() or int.from_bytes(own[:5], "big") % SECTION_ONE_IN == 0:
            close()
    close()
    root = node_digest(digest for digest, _ in sections)
    return f"{root.hex()}/{';'.join(shown for _, shown in sections)}"


def _leaves(print_: str) -> Counter:
    body = print_.partition("/")[2]
    return Counter(
        leaf
        for section in body.split(";")
        for paragraph in section.partition("=")[2].split(",")
        for leaf in paragraph.partition(":")[2].split(".")
        if leaf
    )


def likeness(one: str, other: str) -> float:
    """The share of characters in leaves that both have, from 0 to 1."""
    if one.partition("/")[0] == other.partition("/")[0]:
        return 1.0
    return _likeness(_leaves(one), _leaves(other))


def _likeness(a: Counter, b: Counter) -> float:
    weigh = lambda leaves: sum(int(x[8:], 16) * n for x, n in leaves.items())
    total = weigh(a) + weigh(b)
    # only equal texts have likeness 1
    return min(2 * weigh(a & b) / total, 1 - 1e-9) if total else 0.0


def differences(one: str, other: str) -> list[tuple[str, tuple[int, int], tuple[int, int]]]:
    """Where two trees differ: level, and the index ranges on either side.

    Branches with equal hashes aren't entered. A level is ``section``, ``paragraph``
    or ``leaf``; paragraphs and leaves are numbered over the whole text.
    """
    split = [p.partition("/") for p in (one, other)]
    if split[0][0] == split[1][0]:
        return []
    sections = [[s for s in p[2].split(";") if s] for p in split]
    paragraphs = [[s.partition("=")[2].split(",") for s in side] for side in sections]
    leaves = [[[p.partition(":")[2].split(".") for p in s] for s in side] for side in paragraphs]
    found = []

    def compare(level, a, b, start_a, start_b):
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag != "equal":
                found.append((level, (start_a + i, start_a + j), (start_b + k, start_b + m)))
                yield (i, j), (k, m)

    flat = lambda x: [y for part in x for y in part]
    for (i, j), (k, m) in list(compare("section", *sections, 0, 0)):
        start = len(flat(paragraphs[0][:i])), len(flat(paragraphs[1][:k]))
        below = flat(paragraphs[0][i:j]), flat(paragraphs[1][k:m])
        under = flat(leaves[0][i:j]), flat(leaves[1][k:m])
        first = len(flat(flat(leaves[0][:i]))), len(flat(flat(leaves[1][:k])))
        for (p, q), (r, s) in list(compare("paragraph", *below, *start)):
            at = first[0] + len(flat(under[0][:p])), first[1] + len(flat(under[1][:r]))
            list(compare("leaf", flat(under[0][p:q]), flat(under[1][r:s]), *at))
    return found


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``fingerprint`` of each text."""

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fingerprint": pa.array(map(fingerprint, texts_of(piece, text)), pa.string())}

    return map_pieces(df, text, work, [key], "fingerprint string")


def edited(text: str, next_text: str) -> str:
    """The last third of a text replaced by the first characters of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + next_text[:third]


_EDIT_SCHEMA = (
    "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def neighbour_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint against its edited text's and its successor's.

    The successor is the next row by descending ``key`` (nulls last, equal keys by
    text), the first row after the last. The texts move once, into ranges of keys;
    the first row of a range also goes, as a copy, to the end of the range before it,
    so no task needs another's rows. Ranges end at keys that exist, found by quantiles.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ends, top = key_ranges(rows, "key")
    if top is None:  # no keys at all: the smallest text comes first
        known = F.coalesce("text", F.lit(""))
        is_first = known == F.lit(rows.agg(F.min(known)).first()[0])
    else:
        is_first = F.coalesce(F.col("key") == top, F.lit(False))

    placed = rows.withColumn("range", range_number(ends, "key"))
    opens = F.coalesce(F.col("key").isin(ends), F.lit(False))
    copies = F.filter(
        F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("copy")),
            F.when(opens, F.struct((F.col("range") + 1).alias("range"), F.lit(True).alias("copy"))),
            F.when(is_first, F.struct(F.lit(0).alias("range"), F.lit(True).alias("copy"))),
        ),
        lambda x: x.isNotNull(),
    )
    sent = placed.select("key", "text", F.explode(copies).alias("to")).select("to.*", "key", "text")
    sorted_ = sent.repartitionById(len(ends) + 1, F.col("range")).sortWithinPartitions(
        "range", "copy", F.col("key").desc_nulls_last(), "text"
    )
    compared = sorted_.mapInArrow(_compare_neighbours, _EDIT_SCHEMA)
    return compared.withColumnRenamed("key", key)


def _compare_neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    waiting = None  # the last row: range, key, text, fingerprint, leaves
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, names=["key", *names])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("range", "copy", "key", "text")]
        for i in range(batch.num_rows):
            place, copy, key, text = (c[i].as_py() for c in columns)
            if waiting is None and copy:
                continue
            text = text or ""
            print_ = fingerprint(text)
            leaves = _leaves(print_)
            if waiting is not None:
                if waiting[0] != place:
                    raise AssertionError("a range ended without its successor")
                own_text, own_print, own_leaves = waiting[2:]
                changed = edited(own_text, text)
                changed_print = own_print if changed == own_text else fingerprint(changed)
                near = 1.0 if changed == own_text else _likeness(own_leaves, _leaves(changed_print))
                near_next = 1.0 if own_text == text else _likeness(own_leaves, leaves)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((waiting[1], len(own_text), digest, own_print, changed_print, near, near_next))
            waiting = None if copy else (place, key, text, print_, leaves)
            if len(out) >= 1000:
                yield flush()
    if waiting is not None:
        raise AssertionError("a range ended without its successor")
    if out:
        yield flush()
