"""Exact token counts at every prefix of a text (operator 6).

For one pre-token, dynamic programming over its bytes stores the last token of
every prefix: of all tokens that end there, the one that stands after the last
token of what comes before exactly as the merges would leave it. Its predecessor's
count plus one is the count of the prefix. Over a text the counts add up from
pre-token to pre-token; where cutting a text moves a pre-token boundary (a run of
blanks before a word, half an English contraction, half a special string) the
count of the cut text is set on its own.

Nulls count as the empty text, whose only prefix has 0 tokens. Repeated rows give
repeated rows. A budget below 0 fits nothing and gives null.
"""

from __future__ import annotations

from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import lists, map_pieces, texts_of
from framewright.llm.bpe_core import MergeList, merge_list

CACHED_WORDS = 150_000  # twice: those met lately, and those before
CACHED_PAIRS = 1_000_000
CACHED_LENGTH = 48
# Of the split pattern's contractions, those that need two letters.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
_BLANKS_BEFORE_WORD = regex.compile(r"\s{2,}(?=\S)")


class WordCounts(dict):
    """Token counts at the character prefixes of a pre-token, as packed integers."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges
        self.older: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # lengths of the tokens that end in given three bytes, longest first
        sizes: dict[bytes, set[int]] = {}
        for token in merges.id_of:
            if len(token) > 2:
                sizes.setdefault(token[-3:], {2, 1}).add(len(token))
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in sizes.items()}

    def stands(self, before: int, token: int) -> bool:
        """Whether the merges leave ``token`` just after ``before`` (-1: at the start)."""
        left = self.merges.bytes_of[before] if before >= 0 else b""
        ids = self.merges.merge(left + self.merges.bytes_of[token])
        fits = ids == ([before, token] if before >= 0 else [token])
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[before, token] = fits
        return fits

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one pre-token."""
        last, counts = [-1], [0]
        token_at, sizes, known = self.merges.id_of.get, self.sizes.get, self.fits.get
        for end in range(1, len(data) + 1):
            for size in sizes(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - size
                if start < 0:
                    continue
                token = token_at(data[start:end])
                if token is None:
                    continue
                fits = known((last[start], token))
                if self.stands(last[start], token) if fits is None else fits:
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise AssertionError("single bytes are tokens, so one always stands")
        return counts

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self._counted(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def _counted(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        counts = self.byte_prefixes(data)
        if len(data) != len(word):  # keep the counts at ends of characters
            counts = counts[:1] + [
                counts[i] for i in range(1, len(data) + 1)
                if i == len(data) or data[i] & 0xC0 != 0x80
            ]
        if word in LONG_CONTRACTIONS:
            counts[2] = 2  # its first two characters are two pre-tokens
        return array("i", counts[1:]).tobytes()


class PrefixCounter:
    """Token counts at all prefixes of a text."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.words = WordCounts(merges)

    def counts(self, text: str) -> np.ndarray:
        """Entry i: the number of tokens of the first i characters, i from 0 on."""
        if self.merges.special_split is None:
            return self._plain(text)[0]
        parts, at, before = [np.zeros(1, np.int32)], 0, 0
        for hit in self.merges.special_split.finditer(text):
            section, last_word, so_far = self._plain(text[at : hit.start()])
            # a cut inside the special string leaves ordinary characters
            cut = self._plain(text[at + last_word : hit.end() - 1])[0]
            inside = cut[hit.start() - at - last_word + 1 :] + so_far
            parts += [section[1:] + before, inside + before]
            before += int(section[-1]) + 1
            parts.append(np.array([before], np.int32))
            at = hit.end()
        parts.append(self._plain(text[at:])[0][1:] + before)
        return np.concatenate(parts)

    def _plain(self, text: str) -> tuple[np.ndarray, int, int]:
        """Counts where special strings are ordinary; start of and tokens before the last word."""
        words = self.merges.split.findall(text)
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        if not words:
            return counts, 0, 0
        inner = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        totals = inner[ends - 1]
        counts[1:] = inner + np.repeat(np.cumsum(totals) - totals, sizes)
        for run in _BLANKS_BEFORE_WORD.finditer(text):
            whole = np.frombuffer(self.words[run[0]], dtype=np.int32)[-1]
            counts[run.end()] = counts[run.start()] + whole
        return counts, int(ends[-1] - sizes[-1]), int(totals[:-1].sum())


_COUNTERS: dict[int, PrefixCounter] = {}


def _counter(merges: MergeList) -> PrefixCounter:
    if id(merges) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(merges)] = PrefixCounter(merges)
    return _COUNTERS[id(merges)]


def prefix_counts(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_bytes`` and ``counts``: the tokens of each prefix, in characters.

    ``counts[i]`` is the number of tokens of the first i characters, so that the
    last entry belongs to the whole text. See ``tokens_of``
    and ``fitting_prefix`` for what can be asked of it.
    """
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    merge_list(spec)

    def prepare():
        counter = _counter(merge_list(spec))

        def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            column = piece.column(piece.schema.get_field_index(text))
            found = [counter.counts(value) for value in texts_of(piece, text)]
            sizes = pa.compute.binary_length(column).fill_null(0).cast(pa.int64())
            flat = np.concatenate(found)
            return {"n_bytes": sizes, "counts": lists(flat, [len(c) for c in found], pa.int32())}

        return work

    return map_pieces(df, text, None, [key], "n_bytes bigint, counts array<int>", prepare)


def tokens_of(counts: Column | str, characters: Column | int | None = None) -> Column:
    """Tokens of the first ``characters`` characters, of the whole text if None."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    if characters is None:
        return F.element_at(counts, -1).cast("bigint")
    return F.get(counts, F.lit(characters) if isinstance(characters, int) else characters).cast(
        "bigint"
    )


def fitting_prefix(counts: Column | str, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits).cast("bigint")
