"""License scans by MinHash bands over windows (operator 3).

A text's words are cut into overlapping windows a little longer than each template. A
window and a template are compared by MinHash signatures of their five-word shingles,
in bands; the numbers of bands and rows are the smallest that let a window holding
three quarters of a template share a band with it with the wanted probability. What
bands retrieve is decided exactly: the share of the template's shingles in the window.

As a band can only agree on shingles of a template, texts without any are passed over
before windows are made; that loses nothing the bands would find.

Nulls, empty texts and texts of fewer than five words hold no license. Repeated rows are
reported repeatedly. Templates need five words. Of several windows with one template the
one with the largest share counts, the first of equals. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm.batches import map_pieces, texts_of
from framewright.llm.ngram_join import WORDS, shingle_runs
from framewright.llm.spans import mixed

SHARE = 0.75
CERTAINTY = 0.9999
ROWS = 2

# Names and wordings of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
}
_ENDS = str.maketrans(dict.fromkeys(".,;:()\"'", " "))
_MARKS = re.compile(r"(?:[^\w\s]|_)+")


def bands_for(likeness: float, rows: int = ROWS, certainty: float = CERTAINTY) -> int:
    """Bands so that sets this alike share one with at least the given probability."""
    return int(np.ceil(np.log(1 - certainty) / np.log(1 - likeness**rows)))


def _at_edge(run: re.Match) -> str:
    """Blanks of the same length in UTF-8 for marks at a word's edge, or alone."""
    before, after = run.string[run.start() - 1 : run.start()], run.string[run.end() : run.end() + 1]
    if before.strip() and after.strip():
        return run[0]
    return " " * len(run[0].encode("utf-8", "surrogatepass"))


def without_marks(text: str) -> bytes:
    """UTF-8 with marks at words replaced by blanks of the same length.

    So comment leaders are no words, and quotes of any kind no parts of words.
    """
    return _MARKS.sub(_at_edge, text.translate(_ENDS)).encode("utf-8", "surrogatepass")


def minhashes(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The least value of a set under each of several hash functions."""
    return mixed(shingles[None, :] ^ salts[:, None]).min(axis=1)


class Scanner:
    """Templates by size, with their signatures."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, share: float = SHARE):
        self.share = share
        self.templates: list[tuple[str, np.ndarray, int, np.ndarray]] = []
        for name, text in templates.items():
            _, runs, _, _, last = shingle_runs([without_marks(text)])
            if last[0] < WORDS:
                raise ValueError(f"template {name!r} has fewer than {WORDS} words")
            every = np.unique(runs[: last[0] - WORDS + 1])
            length = int(last[0]) - WORDS + 1
            # windows are longer by their stride, so one of them holds any occurrence
            stride = max(1, length // 4)
            likeness = share * len(every) / (length + stride + (1 - share) * len(every))
            count = bands_for(likeness) * ROWS
            salts = mixed(np.arange(1, count + 1, dtype=np.uint64))
            self.templates.append((name, every, length, minhashes(every, salts)))
        known = np.unique(np.concatenate([t[1] for t in self.templates]))
        self.screen = np.zeros(1 << 16, dtype=bool)
        self.screen[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.known = known

    def matches(self, runs: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Template, first and last shingle and share of what a text's shingles hold."""
        found = []
        for name, every, length, wanted in self.templates:
            at = np.flatnonzero(np.isin(runs, every))
            if not len(at):
                continue
            stride, best = max(1, length // 4), None
            salts = mixed(np.arange(1, len(wanted) + 1, dtype=np.uint64))
            # the signature of a window without a shingle of the template can't agree
            reach = np.arange(0, length + stride, stride)
            firsts = np.unique(at[:, None] // stride * stride - reach[None, :])
            for first in firsts[(firsts >= 0) & (firsts < len(runs))].tolist():
                end = first + length + stride
                agree = (minhashes(runs[first:end], salts) == wanted).reshape(-1, ROWS).all(axis=1)
                if not agree.any():
                    continue
                inside = at[(at >= first) & (at < end)]
                share = len(np.unique(runs[inside])) / len(every)
                if share >= self.share and (best is None or share > best[3]):
                    best = name, int(inside[0]), int(inside[-1]), share
            if best:
                found.append(best)
        return found


_SCANNERS: dict[tuple, Scanner] = {}


def scan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    share: float = SHARE,
) -> DataFrame:
    """``key``, ``template``, ``start``, ``end`` (in characters) and ``share`` of each match."""
    named = dict(templates)

    def prepare():
        name = (*named.items(), share)
        if name not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[name] = Scanner(named, share)
        scanner = _SCANNERS[name]

        def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            given = texts_of(piece, text)
            texts = [without_marks(t) for t in given]
            _, runs, starts, ends, last = shingle_runs(texts)
            hit = np.flatnonzero(scanner.screen[(runs & np.uint64(0xFFFF)).astype(np.int64)])
            hit = hit[np.isin(runs[hit], scanner.known)]
            rows = np.unique(np.searchsorted(last, hit, side="right"))
            offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            out: list[list[tuple]] = [[] for _ in texts]
            for row in rows.tolist():
                first = int(last[row - 1]) if row else 0
                own = runs[first : max(first, int(last[row]) - WORDS + 1)]
                for name, i, j, share_ in scanner.matches(own) if len(own) else ():
                    begin = int(starts[first + i] - offsets[row])
                    end = int(ends[first + j + WORDS - 1] - offsets[row])
                    data = given[row].encode("utf-8", "surrogatepass")
                    chars = [len(data[:x].decode("utf-8", "surrogatepass")) for x in (begin, end)]
                    out[row].append((name, *chars, share_))
            kind = pa.list_(
                pa.struct(
                    [("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]
                )
            )
            names = ("template", "start", "end", "share")
            return {"found": pa.array([[dict(zip(names, m)) for m in row] for row in out], kind)}

        return work

    schema = "found array<struct<template:string,start:int,end:int,share:double>>"
    made = map_pieces(df, text, None, [key], schema, prepare)
    return made.filter("size(found) > 0").selectExpr(f"`{key}`", "inline(found)")
