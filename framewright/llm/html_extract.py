"""Main text of HTML pages (operator 11).

A page is a chain of leaf blocks (``page_blocks``). A linear-chain conditional random
field labels each block as main text or not, from the elements around it (their tags
and the words that name them) and the form of its text; Viterbi's best path decides.
It is trained on labelled pages (``page_layouts``), ``TRAINING_PAGES`` of them, which
bound its size whatever the table's.

The result joins the blocks labelled main, in page order, by single blanks. Character
references are decoded, white space inside a block is one blank; scripts, styles and
other elements without readable text give no blocks. A null or empty page, or one
without main text, gives an empty text. Broken markup never fails: see ``page_blocks``.
Pages of any length are read whole, in time linear in their length. Each row is a page
of its own, so repeated rows repeat their result; an empty table gives no rows, and
columns beside those asked for play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm.batches import map_pieces, texts_of
from framewright.llm.page_blocks import Block, blocks_of
from framewright.llm.page_layouts import MARK, labelled_pages

TRAINING_PAGES = 600
SEED = 11
LEAST_SEEN = 3  # training blocks that a feature must be in
ROUNDS = 120
RATE = 0.1
PENALTY = 1e-3
_WORD_STEPS = (1, 2, 4, 8, 16, 32, 64)
_SENTENCE_ENDS = frozenset(".!?:;…\"”»")


def text_features(block: Block) -> list[str]:
    """What the form of a block's text says, whatever its language."""
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    found = [
        f"tag:{block.tag}",
        f"words:{sum(words >= step for step in _WORD_STEPS)}",
        f"linked:{0 if share == 0 else 1 if share < 0.6 else 2}",
    ]
    if block.text[-1] in _SENTENCE_ENDS:
        found.append("sentence")
    if "©" in block.text:
        found.append("copyright")
    return found


@dataclass(frozen=True)
class Field:
    """Weights of a trained field: what a feature adds to label 1, and the transitions."""

    weights: dict[str, float]
    bias: float
    steps: tuple[tuple[float, float], tuple[float, float]]  # from label, to label
    start: float  # of label 1 over label 0 in the first block

    def scores(self, blocks: Sequence[Block]) -> list[float]:
        """How much label 1 leads label 0 in each block, taken alone."""
        get, sums, found = self.weights.get, {}, []
        for block in blocks:
            outer = sums.get(block.around)
            if outer is None:
                outer = sums[block.around] = self.bias + sum(get(f, 0.0) for f in block.around)
            found.append(outer + sum(get(f, 0.0) for f in text_features(block)))
        return found

    def labels(self, blocks: Sequence[Block]) -> list[int]:
        """The likeliest labels of the chain, by Viterbi; ties go to label 0."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.steps
        scores = self.scores(blocks)
        zero, one, back = 0.0, self.start + scores[0], []
        for score in scores[1:]:
            back.append((one + s10 > zero + s00, one + s11 > zero + s01))
            zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + score
        label = int(one > zero)
        found = [label]
        for before in reversed(back):
            label = int(before[label])
            found.append(label)
        return found[::-1]


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a labelled page without their marks, and their labels."""
    blocks = blocks_of(page)
    labels = [int(MARK in block.text) for block in blocks]
    clean = [Block(b.text.replace(MARK, ""), b.tag, b.around, b.linked) for b in blocks]
    return clean, labels


def marginals(
    scores: np.ndarray, steps: np.ndarray, start: float, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Chances of label 1, and of each pair of labels summed over all steps.

    ``scores`` has a row for each chain, filled up to the longest. Forward and
    backward sums run over all chains at once, in logarithms.
    """
    chains, longest = scores.shape
    node = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead = np.empty_like(node)
    ahead[:, 0] = node[:, 0] + np.array([0.0, start])
    for t in range(1, longest):
        ahead[:, t] = node[:, t] + np.logaddexp(
            ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]
        )
    behind = np.zeros_like(node)
    for t in range(longest - 2, -1, -1):
        after = node[:, t + 1] + behind[:, t + 1]
        reached = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
        behind[:, t] = np.where((t + 1 < lengths)[:, None], reached, 0.0)
    whole = ahead + behind
    total = np.logaddexp(whole[..., 0], whole[..., 1])
    chance = np.exp(whole[..., 1] - total)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1):
        inside = t + 1 < lengths
        joint = ahead[:, t, :, None] + steps + (node[:, t + 1] + behind[:, t + 1])[:, None, :]
        pairs += np.exp(joint[inside] - total[inside, t][:, None, None]).sum(axis=0)
    return chance, pairs


def trained(pages: Sequence[tuple[list[Block], list[int]]]) -> Field:
    """The field that makes the labels of the pages likeliest, less a small penalty."""
    pages = [page for page in pages if page[0]]
    seen: dict[str, int] = {}
    for blocks, _ in pages:
        for block in blocks:
            for name in (*block.around, *text_features(block)):
                seen[name] = seen.get(name, 0) + 1
    names = sorted(name for name, count in seen.items() if count >= LEAST_SEEN)
    place = {name: i for i, name in enumerate(names)}
    lengths = np.array([len(blocks) for blocks, _ in pages])
    inside = np.arange(lengths.max()) < lengths[:, None]
    features = np.zeros((lengths.sum(), len(names) + 1))
    features[:, -1] = 1.0  # the bias
    for row, block in enumerate(block for blocks, _ in pages for block in blocks):
        for name in (*block.around, *text_features(block)):
            if name in place:
                features[row, place[name]] = 1.0
    wanted = np.zeros(inside.shape)
    wanted[inside] = [label for _, labels in pages for label in labels]
    wanted_pairs = np.zeros((2, 2))
    for _, labels in pages:
        for a, b in zip(labels, labels[1:]):
            wanted_pairs[a, b] += 1

    size = len(names) + 1
    point = np.zeros(size + 5)  # weights, steps, start
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for turn in range(1, ROUNDS + 1):
        scores = np.zeros(inside.shape)
        scores[inside] = features @ point[:size]
        chance, pairs = marginals(scores, point[size:-1].reshape(2, 2), point[-1], lengths)
        slope = np.concatenate(
            [
                features.T @ (wanted - chance)[inside],
                (wanted_pairs - pairs).ravel(),
                [(wanted - chance)[:, 0].sum()],
            ]
        )
        slope = slope / len(pages) - PENALTY * point
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        step = (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        point += RATE * (1 - turn / (ROUNDS + 1)) * step
    (s00, s01), (s10, s11) = point[size:-1].reshape(2, 2).tolist()
    return Field(
        {name: float(point[i]) for name, i in place.items()},
        float(point[size - 1]),
        ((s00, s01), (s10, s11)),
        float(point[-1]),
    )


@lru_cache(maxsize=1)
def fitted() -> Field:
    """The field trained on the labelled pages of the subpackage."""
    return trained([labelled_blocks(page) for page in labelled_pages(TRAINING_PAGES, SEED)])


def main_text(page: str, model: Field, known: frozenset[str]) -> str:
    blocks = blocks_of(page, known)
    return " ".join(b.text for b, label in zip(blocks, model.labels(blocks)) if label)


def extract(
    df: DataFrame,
    model: Field | None = None,
    keep: Sequence[str] = ("page_id", "url"),
    html: str = "html",
) -> DataFrame:
    """Kept columns, ``text`` and ``n_chars``, its code points. A map over pages, no shuffle."""
    model = fitted() if model is None else model
    known = frozenset(model.weights)

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(page, model, known) for page in texts_of(piece, html)]
        return {
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array(map(len, texts), pa.int64()),
        }

    return map_pieces(df, html, work, keep, "text string, n_chars bigint")
