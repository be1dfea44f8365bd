"""Token ids as word-aligned binary files (operator 2).

Simple-8b: a 64-bit word holds a selector in its top four bits and as many ids as
fit in the other 60 at the selector's width. Where an id needs more than 60 bits,
selector 0 holds its low 60 bits and the next word, selector 15, the rest.

A stored table has one row per document and keeps the words in `words`
(little-endian), with `block_starts`: the ids before each block of ``BLOCK_WORDS``
words, so that any block can be decoded on its own, all of its words at once.

Nulls count as the empty text: only the end id. Documents of one id keep the order
of their coded words, null ids come first; repeated rows are stored repeatedly. An
empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.batches import map_pieces, shared_folder, texts_of
from framewright.llm.ordering import before_each, key_ranges, range_number
from framewright.llm.spans import ragged, span_hashes

# Fixed values of Simple-8b: ids in a word and bits of each, by selector from 1 on.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, REST = 0, 15
BLOCK_WORDS = 256

_HELD = np.array([1, *COUNTS, 0], dtype=np.int64)  # ids by selector, escapes included


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coded words of rows of ids; no word spans two rows.

    Returns the words, the number of words in each row, and the number of ids
    that each word holds.
    """
    ids = ids.astype(np.uint64)
    total, ends = len(ids), np.repeat(np.cumsum(sizes), sizes)
    room = ends - np.arange(total)
    choice = np.zeros(total, dtype=np.int64)
    most = int(ids.max()) if total else 0
    for selector in range(len(COUNTS), 0, -1):  # the last that fits holds most
        count, bits = COUNTS[selector - 1], BITS[selector - 1]
        if count > total:
            break
        fits = room >= count
        if most >> bits:
            wide = np.concatenate([[0], np.cumsum(ids >> np.uint64(bits) != 0)])
            fits[: total - count + 1] &= wide[count:] == wide[: total - count + 1]
        fits[total - count + 1 :] = False
        choice[fits] = selector
    first = _chain(np.arange(total, dtype=np.int64) + _HELD[choice])
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in range(1, len(COUNTS) + 1):
        here = np.flatnonzero(chosen == selector)
        for j in range(COUNTS[selector - 1] if len(here) else 0):
            words[here] |= ids[first[here] + j] << np.uint64(j * BITS[selector - 1])
    low = np.uint64((1 << 60) - 1)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] = ids[first[escaped]] & low
    rest = (ids[first[escaped]] >> np.uint64(60)) | np.uint64(REST << 60)
    row = np.searchsorted(np.cumsum(sizes), first, side="right")
    held = _HELD[chosen]
    words = np.insert(words, escaped + 1, rest)
    held, row = np.insert(held, escaped + 1, 0), np.insert(row, escaped + 1, row[escaped])
    return words, np.bincount(row, minlength=len(sizes)), held


def _chain(after: np.ndarray) -> np.ndarray:
    """The places met from 0 on by going to ``after`` of each, up to its length.

    The path doubles in each round, and so does the jump of each place.
    """
    total = len(after)
    jump = np.append(after, total)
    path = np.zeros(1, dtype=np.int64)
    while path[-1] < total:
        path = np.concatenate([path, jump[path]])
        jump = jump[jump]
    return path[path < total]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of coded words, all words at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    held = _HELD[selectors]
    first = np.cumsum(held) - held
    ids = np.empty(int(held.sum()), dtype=np.uint64)
    for selector in np.unique(selectors):
        here = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            ids[first[here]] = words[here] & np.uint64((1 << 60) - 1)
        elif selector != REST:
            count, bits = COUNTS[selector - 1], BITS[selector - 1]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (words[here, None] >> shifts) & np.uint64((1 << bits) - 1)
            ids[first[here, None] + np.arange(count)] = values
    rest = np.flatnonzero(selectors == REST)
    ids[first[rest] - 1] |= words[rest] << np.uint64(60)
    return ids


def block_ids(words: np.ndarray, block: int) -> np.ndarray:
    """The ids that begin in a block of a document's words, decoded on their own."""
    part = words[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS + 1]
    rests = part >> np.uint64(60) == REST
    if len(part) > BLOCK_WORDS and not rests[-1]:  # only the rest of a last escape is taken along
        part, rests = part[:-1], rests[:-1]
    return unpack(part[1:] if len(part) and rests[0] else part)


def slice_ids(words: np.ndarray, block_starts: Sequence[int], first: int, count: int) -> np.ndarray:
    """Up to ``count`` ids of a document from its id ``first`` on, from their blocks alone."""
    starts = np.asarray(block_starts, dtype=np.int64)
    if not len(starts) or count <= 0:
        return np.empty(0, dtype=np.uint64)
    low = int(np.searchsorted(starts, first, side="right")) - 1
    high = int(np.searchsorted(starts, first + count, side="left"))
    ids = np.concatenate([block_ids(words, block) for block in range(low, max(low + 1, high))])
    return ids[first - int(starts[low]) :][:count]


class WordEncoder:
    """The tokenizers library's ids of many texts, calling it for new words only.

    Its pre-tokens depend on nothing around them, so their ids are kept by hash of
    their characters. Texts with special strings, or with characters for which normalising
    isn't one lower-case character below U+0300, go to the library whole.
    """

    ODD = "".join(
        chr(c) for c in range(0x300) if len(chr(c).lower()) > 1 or ord(chr(c).lower()) >= 0x300
    )
    NOT_PLAIN = regex.compile(rf"[^\x00-\u02ff]|[{ODD}]")
    CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
    CACHED_WORDS = 200_000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ids_of: dict[int, bytes] = {}
        self.odd = np.array([bool(self.NOT_PLAIN.match(chr(c))) for c in range(0x300)])
        kinds = [regex.compile(p) for p in (r"\s", r"\p{L}", r"\p{N}")]
        self.kind = np.array(
            [next((k for k, p in enumerate(kinds) if p.match(chr(c))), 3) for c in range(0x300)],
            dtype=np.int8,
        )

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text as the library gives them."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
        unusual = np.flatnonzero((codes >= 0x300) | self.odd[np.minimum(codes, 0x2FF)])
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        flagged = np.bincount(
            np.searchsorted(np.cumsum(lengths), unusual, side="right"), minlength=len(texts)
        )
        odd = [
            i
            for i, t in enumerate(texts)
            if flagged[i] or any(s in t for s in self.specials)
        ]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        flat, counts = self._plain(plain)
        if odd:
            rows = np.split(flat, np.cumsum(counts)[:-1])
            for i in odd:
                rows[i] = self.whole(texts[i])
                counts[i] = len(rows[i])
            flat = np.concatenate(rows)
        return flat, counts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts).lower()
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = self.kind[codes]
        new = np.ones(len(kind), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # a quote that begins a pre-token may begin a contraction
        for at in np.flatnonzero(new & (codes == 39)):
            if hit := self.CONTRACTION.match(joined, int(at)):
                new[at + 1 : hit.end()] = False
                if hit.end() < len(new):
                    new[hit.end()] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(codes))
        visible = kind[starts] != 0
        starts, ends = starts[visible], ends[visible]
        hashes = span_hashes(codes, starts, ends)
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.ids_of
        missing = [k for k, h in enumerate(unique.tolist()) if h not in known]
        if len(known) + len(missing) > self.CACHED_WORDS:
            known.clear()
            missing = range(len(unique))
        if missing:
            at = example[list(missing)]
            words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            for k, ids in zip(missing, self._from_library(words)):
                known[int(unique[k])] = ids
        packed = [known[h] for h in unique.tolist()]
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        values = np.frombuffer(b"".join(packed), dtype=np.uint32)
        amounts = sizes[inverse]
        flat = values[ragged((np.cumsum(sizes) - sizes)[inverse], amounts)]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        text_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
        counts = np.bincount(text_of, weights=amounts, minlength=len(texts)).astype(np.int64)
        return flat, counts

    def _from_library(self, words: list[str]) -> Iterator[bytes]:
        """Ids of pre-tokens, many in one call: blanks between them are dropped."""
        for first in range(0, len(words), 1000):
            part = words[first : first + 1000]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype=np.uint32)
            word = np.array(found.word_ids)
            ends = np.searchsorted(word, np.arange(len(part)), side="right")
            begin = 0
            for end in ends:
                yield ids[begin:end].tobytes()
                begin = end


_ENCODERS: dict[int, WordEncoder] = {}


def coded(
    df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_tokens``, ``words`` and ``block_starts`` of each text and the end id."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")

    def prepare():
        name = hash(spec)
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = WordEncoder(spec)
        encoder = _ENCODERS[name]

        def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            flat, counts = encoder.many(texts_of(piece, text))
            flat, counts = np.insert(flat, np.cumsum(counts), end_id), counts + 1
            words, rows, held = pack(flat, counts)
            ends = np.cumsum(rows)
            data, starts = [], []
            for first, end in zip((ends - rows).tolist(), ends.tolist()):
                data.append(words[first:end].tobytes())
                before = np.cumsum(held[first:end]) - held[first:end]
                starts.append(before[::BLOCK_WORDS].astype(np.int32))
            return {
                "n_tokens": pa.array(counts, pa.int64()),
                "words": pa.array(data, pa.binary()),
                "block_starts": pa.array(starts, pa.list_(pa.int32())),
            }

        return work

    outputs = "n_tokens bigint, words binary, block_starts array<int>"
    return map_pieces(df, text, None, [key], outputs, prepare)


def write_ids(
    df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> str:
    """Store the coded documents in ascending order of ``key``; returns the path.

    Keys are cut into ranges; a range is sorted in one task and stored in order, with
    each document's first place counted from the start of the range.
    """
    ends, _ = key_ranges(df, key)
    rows = coded(df, tokenizer_path, end_id, key, text).withColumnRenamed(key, "key")
    rows = rows.withColumn("range", range_number(ends, "key"))
    ordered = rows.repartitionById(len(ends) + 1, F.col("range")).sortWithinPartitions(
        "range", F.col("key").asc_nulls_first(), "words"
    )
    path = shared_folder(df.sparkSession, "token-ids")
    schema = "range int, first bigint, key bigint, n_tokens bigint, words binary, block_starts array<int>"
    ordered.mapInArrow(_with_first, schema).write.parquet(path)
    return path


def _with_first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the number of ids before each row of a range; ranges come in order."""
    current, total = None, 0
    for batch in batches:
        ranges = batch.column(batch.schema.get_field_index("range")).to_pylist()
        sizes = batch.column(batch.schema.get_field_index("n_tokens")).to_pylist()
        first = []
        for number, size in zip(ranges, sizes):
            if number != current:
                current, total = number, 0
            first.append(total)
            total += size
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        yield pa.RecordBatch.from_pydict(
            {
                "range": columns["range"],
                "first": pa.array(first, pa.int64()),
                **{n: columns[n] for n in ("key", "n_tokens", "words", "block_starts")},
            }
        )


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids`` of a stored table.

    ``start`` is the number of ids of all documents before; ``ids`` holds the decoded
    ids as little-endian unsigned 32-bit integers, or 64-bit ones where they need it.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("range").agg(F.sum("n_tokens").alias("ids"))
    before = before_each(totals, "range", "ids", "before")
    placed = table.join(before, "range").select(
        F.col("key"), (F.col("before") + F.col("first")).alias("start"), "words"
    )
    schema = "key bigint, start bigint, n_tokens bigint, ids binary"
    return placed.mapInArrow(_decoded, schema).withColumnRenamed("key", key)


def read_slices(
    spark: SparkSession, path: str, first: int, count: int, key: str = "doc_id"
) -> DataFrame:
    """``key`` and ``ids``: up to ``count`` ids of each document from its ``first`` on.

    Only the blocks that hold them are decoded, found by ``block_starts``. A document
    that ends before gives no ids. ``ids`` is an array of bigints.
    """
    if first < 0 or count < 0:
        raise ValueError("first and count can't be negative")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, starts = (batch.column(i) for i in range(3))
            found = [
                slice_ids(np.frombuffer(w, dtype="<u8"), s, first, count).astype(np.int64)
                for w, s in zip(words.to_pylist(), starts.to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(found, pa.list_(pa.int64()))], names=["key", "ids"]
            )

    table = spark.read.parquet(path).select("key", "words", "block_starts")
    return table.mapInArrow(run, "key bigint, ids array<bigint>").withColumnRenamed("key", key)


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            key, start, column = (piece.column(i) for i in range(3))
            words = [np.frombuffer(w, dtype="<u8") for w in column.to_pylist()]
            ids = unpack(np.concatenate(words))
            held = [int(_HELD[(w >> np.uint64(60)).astype(np.int64)].sum()) for w in words]
            if len(ids) and int(ids.max()) < 1 << 32:
                ids = ids.astype("<u4")
            rows = np.split(ids, np.cumsum(held)[:-1])
            yield pa.RecordBatch.from_arrays(
                [key, start, pa.array(held, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["key", "start", "n_tokens", "ids"],
            )
