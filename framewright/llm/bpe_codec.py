"""BPE encoding and decoding as streams (operator 1).

Encoding is a transducer with bounded lookahead. The merge list gives the number
of bytes after which a token boundary is final (`MergeList.lookahead`); tokens
leave as soon as that many bytes lie behind them, so a run of any length needs
the same memory. Decoding feeds token bytes to an incremental UTF-8 decoder.

Nulls encode as the empty text: no ids. Special strings inside a text become
their special id. Ids outside the vocabulary decode to nothing. Repeated rows
give repeated rows; a null list of ids decodes to a null text.
"""

from __future__ import annotations

import codecs
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewright.llm.batches import lists, map_pieces, texts_of
from framewright.llm.bpe_core import MergeList, merge_list

BLOCK_CHARACTERS = 1 << 16
CACHED_WORDS = 200_000
CACHED_LENGTH = 48
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]


class RunTransducer:
    """Token ids of one pre-token that arrives in parts."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.pending = b""

    def feed(self, data: bytes) -> list[int]:
        """Take bytes, give the tokens that have become final."""
        out: list[int] = []
        step = 4 * self.merges.lookahead
        for at in range(0, len(data), step):
            self.pending += data[at : at + step]
            if len(self.pending) < step:
                continue
            stable, end = len(self.pending) - self.merges.lookahead, 0
            for token in self.merges.merge(self.pending):
                size = len(self.merges.bytes_of[token])
                if end + size > stable:
                    break
                out.append(token)
                end += size
            self.pending = self.pending[end:]
        return out

    def finish(self) -> list[int]:
        """The rest of the tokens; ready for another pre-token."""
        data, self.pending = self.pending, b""
        return self.merges.merge(data)


class WordIds(dict):
    """Ids of short pre-tokens as packed integers.

    When it is full, its words become the older ones and replace those; an older word
    that occurs again comes back, so frequent words stay.
    """

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges
        self.older: dict[str, bytes] = {}

    def _keep(self, word: str, packed: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed

    def __missing__(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is not None:
            return self._keep(word, known)
        data = word.encode("utf-8", "surrogatepass")
        if len(data) > 4 * self.merges.lookahead:
            run = RunTransducer(self.merges)
            return array("I", run.feed(data) + run.finish()).tobytes()
        packed = array("I", self.merges.merge(data)).tobytes()
        return self._keep(word, packed) if len(word) <= CACHED_LENGTH else packed


class StreamEncoder:
    """Encode a text that arrives in parts; memory doesn't grow with its length.

    ``feed`` and ``finish`` return packed unsigned 32-bit ids.
    """

    def __init__(self, merges: MergeList, words: WordIds | None = None):
        self.merges = merges
        self.words = WordIds(merges) if words is None else words
        self.rest = ""
        self.run: RunTransducer | None = None
        self.run_pattern = None

    def feed(self, text: str) -> bytes:
        buffer, out = self.rest + text, []
        special = self.merges.special_split
        while special and (hit := special.search(buffer)):
            out.append(self._section(buffer[: hit.start()]))
            out.append(array("I", [self.merges.special[hit[0]]]).tobytes())
            buffer = buffer[hit.end() :]
        held = max(
            (n for s in self.merges.special for n in range(1, len(s)) if buffer.endswith(s[:n])),
            default=0,
        )
        body = buffer[: len(buffer) - held]
        if self.run is not None:
            body = self._continue_run(body, out, last=False)
        words = self.merges.split.findall(body)
        # a match is final once the next two characters are known
        tail = ""
        while words and len(tail) < 2:
            tail = words.pop() + tail
        out += map(self.words.__getitem__, words)
        if len(tail) > BLOCK_CHARACTERS and self.run is None:
            tail = self._start_run(tail, out)
        self.rest = tail + buffer[len(buffer) - held :]
        return b"".join(out)

    def finish(self) -> bytes:
        rest, self.rest = self.rest, ""
        return self._section(rest)

    def _section(self, text: str) -> bytes:
        """Text up to a special string or the end."""
        out: list[bytes] = []
        if self.run is not None:
            text = self._continue_run(text, out, last=True)
        out += map(self.words.__getitem__, self.merges.split.findall(text))
        return b"".join(out)

    def _start_run(self, tail: str, out: list[bytes]) -> str:
        """Hand a pre-token that may go on for long to a run transducer."""
        lead = 1 if tail[0] == " " and not tail[1].isspace() else 0
        for pattern in _RUNS:
            hit = pattern.match(tail, lead)
            if hit and hit.end() == len(tail):
                self.run, self.run_pattern = RunTransducer(self.merges), pattern
                if lead:
                    self.run.feed(b" ")
                return self._continue_run(tail[lead:], out, last=False)
        return tail

    def _continue_run(self, text: str, out: list[bytes], last: bool) -> str:
        """Feed what belongs to the run; give back what doesn't."""
        hit = self.run_pattern.match(text)
        end = hit.end() if hit else 0
        blank = self.run_pattern is _RUNS[3]
        # the last blank belongs to what follows it, if anything does
        keep = 1 if blank and end and not (last and end == len(text)) else 0
        body = text[: end - keep].encode("utf-8", "surrogatepass")
        out.append(array("I", self.run.feed(body)).tobytes())
        if last or end < len(text):
            out.append(array("I", self.run.finish()).tobytes())
            self.run = None
        return text[end - keep :]


class StreamDecoder:
    """Text of token ids that arrive in parts; incomplete characters wait."""

    def __init__(self, merges: MergeList):
        self.table = merges.bytes_of
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.decoder.decode(b"".join([self.table.get(i, b"") for i in ids]))

    def finish(self) -> str:
        text = self.decoder.decode(b"", True)
        self.decoder.reset()
        return text


_WORDS: dict[int, WordIds] = {}


def _words(merges: MergeList) -> WordIds:
    if id(merges) not in _WORDS:
        _WORDS.clear()
        _WORDS[id(merges)] = WordIds(merges)
    return _WORDS[id(merges)]


def encode(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``key`` and the token ids of ``text``, as array<int>."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    merge_list(spec)

    def prepare():
        merges = merge_list(spec)
        encoder = StreamEncoder(merges, _words(merges))

        def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            packed, counts = [], []
            for value in texts_of(piece, text):
                parts = [
                    encoder.feed(value[at : at + BLOCK_CHARACTERS])
                    for at in range(0, len(value), BLOCK_CHARACTERS)
                ]
                parts.append(encoder.finish())
                packed += parts
                counts.append(sum(map(len, parts)) // 4)
            flat = np.frombuffer(b"".join(packed), dtype=np.uint32).astype(np.int32)
            return {ids: lists(flat, counts, pa.int32())}

        return work

    return map_pieces(df, text, None, [key], f"`{ids}` array<int>", prepare)


def encode_decoded(
    df: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """``key``, the token ids of ``text`` and the text that they decode to.

    The rows of ``decode(encode(...))`` in one Python pass, so that a task holds one
    merge list and one worker instead of two. Merge list and words belong to the task and
    are freed with it, so that a pooled worker doesn't carry them into later stages.
    """
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    merge_list(spec)

    def prepare():
        merges = MergeList(spec)
        encoder, decoder = StreamEncoder(merges), StreamDecoder(merges)

        def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            packed, counts, made = [], [], []
            for value in texts_of(piece, text):
                parts = [
                    encoder.feed(value[at : at + BLOCK_CHARACTERS])
                    for at in range(0, len(value), BLOCK_CHARACTERS)
                ]
                parts.append(encoder.finish())
                row = np.frombuffer(b"".join(parts), dtype=np.uint32).astype(np.int32)
                packed.append(row)
                counts.append(len(row))
                pieces = [
                    decoder.feed(row[i : i + BLOCK_CHARACTERS].tolist())
                    for i in range(0, len(row), BLOCK_CHARACTERS)
                ]
                made.append("".join(pieces) + decoder.finish())
            flat = np.concatenate(packed) if packed else np.zeros(0, np.int32)
            return {ids: lists(flat, counts, pa.int32()), decoded: pa.array(made, pa.string())}

        return work

    return map_pieces(
        df, text, None, [key], f"`{ids}` array<int>, `{decoded}` string", prepare
    )


def decode(
    df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded"
) -> DataFrame:
    """All columns of ``df`` and the text of its token ids; a column ``text`` is replaced."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    kept = [name for name in df.columns if name.lower() != text.lower()]
    source = df.select(*(f"`{name}`" for name in kept))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)

    def run(batches):
        decoder = StreamDecoder(merge_list(spec))
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                piece = batch.slice(first, 512)
                column = piece.column(piece.schema.get_field_index(ids))
                flat = column.flatten().to_numpy(zero_copy_only=False)
                sizes = pa.compute.list_value_length(column).to_pylist()
                made, at = [], 0
                for size in sizes:
                    if size is None:
                        made.append(None)
                        continue
                    row = flat[at : at + size]
                    at += size
                    parts = [
                        decoder.feed(row[i : i + BLOCK_CHARACTERS].tolist())
                        for i in range(0, size, BLOCK_CHARACTERS)
                    ]
                    made.append("".join(parts) + decoder.finish())
                columns = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
                yield pa.RecordBatch.from_pydict({**columns, text: pa.array(made, pa.string())})

    return source.mapInArrow(run, f"{fields}, `{text}` string")
