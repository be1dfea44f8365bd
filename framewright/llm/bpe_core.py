"""Byte-level BPE: the merge list, its sufficient lookahead, and its pre-tokens.

Nothing is trained here: the merge list comes from a public tokenizer's file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import cached_property

import regex

# Fixed values of the byte-level pre-tokenizer: its split pattern and, below, the
# rule that turns bytes into printable characters.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_of_character() -> dict[str, int]:
    """Printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    table, shifted = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[chr(byte)] = byte
        else:
            table[chr(shifted)] = byte
            shifted += 1
    return table


class MergeList:
    """A byte-level BPE vocabulary with its merges in order.

    Raises ``ValueError`` for a list on which left-to-right emission isn't proven:
    each merge must join bytes or products of earlier merges, and no two merges
    may give the same token.
    """

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        to_byte = byte_of_character()
        raw = lambda piece: bytes(to_byte[c] for c in piece)
        self.id_of = {raw(token): number for token, number in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {number: token for token, number in self.id_of.items()}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = [(raw(left), raw(right)) for left, right in pairs]
        known = {bytes([b]) for b in range(256)}
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(self.pairs):
            if left not in known or right not in known or left + right in known:
                raise ValueError(f"merge {rank} is out of order")
            known.add(left + right)
            key = self.id_of[left], self.id_of[right]
            self.merge_of[key] = rank, self.id_of[left + right]
        self.rank_of = {pair: rank for pair, (rank, _) in self.merge_of.items()}
        self.products = [product for _, product in self.merge_of.values()]
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]

    @cached_property
    def lookahead(self) -> int:
        """Bytes after which a token boundary can no longer change.

        Let a text go on behind position p. The first merge over p takes the token
        that ends there away from its left neighbour. Each further change to the
        left is made by a later merge whose right part begins with the left part of
        the merge before it, and moves the changed zone left by the length of its
        own left part. The longest such chain of merges, added up, is the answer.
        """
        reach: dict[bytes, int] = {}
        longest = 1
        for left, right in self.pairs:
            before = max((reach.get(right[:n], 0) for n in range(1, len(right) + 1)))
            here = len(left) + before
            longest = max(longest, here)
            reach[left] = max(reach.get(left, 0), here)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token: the lowest merge first, leftmost of equals."""
        symbols = [self.byte_ids[b] for b in data]
        if len(symbols) > 40:
            return self._merge_long(symbols)
        rank_of, none = self.rank_of.get, len(self.products)
        ranks = [rank_of(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [self.products[best]]
            del ranks[at]
            # a merge changes the pairs on its two sides only
            if at < len(ranks):
                ranks[at] = rank_of((symbols[at], symbols[at + 1]), none)
            if at:
                ranks[at - 1] = rank_of((symbols[at - 1], symbols[at]), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        found, end = self.merge_of.get, len(symbols)
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        queue = []

        def offer(left: int, right: int) -> None:
            hit = found((symbols[left], symbols[right]))
            if hit is not None:
                queue.append((hit[0], left, right, hit[1]))

        for i in range(end - 1):
            offer(i, i + 1)
        heapq.heapify(queue)
        while queue:
            rank, left, right, product = heapq.heappop(queue)
            if symbols[left] < 0 or right >= end or symbols[right] < 0 or after[left] != right:
                continue
            if found((symbols[left], symbols[right])) != (rank, product):
                continue
            symbols[left], symbols[right] = product, -1
            after[left] = after[right]
            if after[right] < end:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < end:
                    hit = found((symbols[a], symbols[b]))
                    if hit is not None:
                        heapq.heappush(queue, (hit[0], a, b, hit[1]))
        return [s for s in symbols if s >= 0]

    @cached_property
    def split(self):
        """The compiled split pattern."""
        return regex.compile(SPLIT_PATTERN)

    @cached_property
    def special_split(self):
        """Pattern of the special strings, longest first; None without any."""
        strings = sorted(self.special, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, strings))) if strings else None


_LOADED: dict[bytes, MergeList] = {}


def merge_list(tokenizer_json: str) -> MergeList:
    """One merge list per worker process and file; a few at most."""
    key = hashlib.sha256(tokenizer_json.encode()).digest()
    if key not in _LOADED:
        if len(_LOADED) >= 4:
            _LOADED.clear()
        _LOADED[key] = MergeList(tokenizer_json)
    return _LOADED[key]
