"""Toxicity by a string-kernel support vector machine (operator 7).

The kernel counts shared subsequences of three letters, each occurrence weighted by
a power of its span, so that an insult keeps its likeness when letters are inserted
or gaps opened. Nyström landmarks turn it into features of fixed length, on which a
linear machine with squared hinge loss is trained. As both the features and the
machine are linear in the subsequences, the trained machine is one weight for each
three letters: what is sent to tasks is that table, and scoring costs no landmark.

The machine judges units: words without marks, accents and look-alike digits, runs of
single letters, stretches of longer words, and neighbouring words joined, as long as they
have up to ``WINDOW`` letters together, so that an insult split by blanks or line ends is
whole again. What stands out is learned from words only, so phrases of harmless words
aren't. Labels belong to texts, so it is trained
on multiple instances: units that more groups of copies have in toxic texts than chance
explains, each weighed by how surely it does (``standing_out``), with letters inserted,
against units of clean ones, the worst mistakes added in a second round. Only landmarks
are bounded in number, and spread over what stands out. A text's score is a logistic function of its worst unit, and of how
many units are on the toxic side, in all and per word, fitted on the same texts.

Nulls and texts without letters get the lowest score. Without a toxic or a clean
example all scores are 0. Null ids count as not held out; repeated rows get equal
scores. Several labels of one id count as toxic if one does. Columns beside id and
text play no part.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import map_pieces, texts_of
from framewright.llm.ngram_join import WORDS, shingle_runs
from framewright.llm.spans import mixed, ragged, span_hashes

# What training sees at most, so that it fits in a driver whatever the size of the table:
TRAINING_TEXTS = 2000  # of each label: those with the smallest hash of the id
TRAINING_CHARS = 20_000  # longer texts are no examples
NEGATIVE_UNITS = 12_000  # words of clean texts: the most frequent ones, and every nth other
NEGATIVE_JOINS = 4000  # joined words of clean texts, every nth; the worst 500 come on top
LANDMARKS = 192  # half of them, at most, from units that stand out
COPIES = 0.5  # texts with this overlap of five-word shingles count once
DECAY = 0.7
WINDOW, STRIDE = 12, 3
OTHERS = 17  # codes for letters beside a to z
LETTERS = 26 + OTHERS
IDEOGRAPHS = 0x2E80  # letters from here on stand for more than a sound
PENALTY = 10.0
CACHED_TOKENS = 700_000
CHUNK = 8192  # units of one length that are weighed together
FOLDS = 5  # ids whose crc32 leaves 0 are held out
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# letters and what sets them apart share no character, so a run is read in one way only
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s.\-_*]{1,3}[^\W_]){2,}(?![^\W_])")


class _Plain(dict):
    """Characters to plain letters: base letters, look-alikes, codes from ``{`` on.

    Neighbours in an alphabet get different codes. Ideographs and syllables are too many
    for that and get two codes each, so that a pair of them is enough for a unit.
    """

    def __missing__(self, code: int) -> str:
        character = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if character in _DIGITS:
            plain = _DIGITS[character]
        elif "a" <= character <= "z":
            plain = character
        elif not character.isalpha():
            plain = ""
        elif code >= IDEOGRAPHS and ord(character) >= 0x1100:
            plain = chr(123 + code % OTHERS) + chr(123 + code // OTHERS % OTHERS)
        else:
            plain = chr(123 + ord(character) % OTHERS)
        self[code] = plain
        return plain


_PLAIN = _Plain()


def plain_of(token: str) -> str:
    """The letters of a token, without marks at its edges."""
    if not (token[:1].isalnum() and token[-1:].isalnum()):
        first = next((i for i, c in enumerate(token) if c.isalnum()), len(token))
        last = next((i for i in range(len(token), first, -1) if token[i - 1].isalnum()), first)
        token = token[first:last]
    return token.translate(_PLAIN)


@dataclass
class Joins:
    """Neighbouring words whose letters fit in a window together, of many texts at once.

    ``letters`` holds the letters of all words in a row, as numbers; join ``n`` goes from
    word ``first[n]`` to ``last[n]`` and from letter ``start[n]`` up to ``end[n]``, and
    belongs to text ``row[n]``.
    """

    letters: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One join for each run of letters, and which of these each join is."""
        _, example, which = np.unique(
            span_hashes(self.letters, self.start, self.end), return_index=True, return_inverse=True
        )
        return example, which

    def units(self) -> np.ndarray:
        """The distinct runs of letters, sorted, as an array of bytes."""
        some, _ = self.distinct()
        start, size = self.start[some], (self.end - self.start)[some]
        at = np.arange(WINDOW)
        letters = np.concatenate([self.letters, np.zeros(WINDOW, dtype=np.int32)])
        rows = letters[start[:, None] + at] + 97
        rows[at >= size[:, None]] = 0
        return np.sort(rows.astype(np.uint8).view(f"S{WINDOW}").ravel())


def joins_of(rows: list[list[str | None]]) -> Joins:
    """The joins of texts given as words; words without letters are passed over.

    No join goes across a null or from one text to the next.
    """
    words = [word for row in rows for word in row]
    return joins_between(
        np.array([len(row) for row in rows], dtype=np.int64),
        np.array([len(word or "") for word in words], dtype=np.int64),
        np.array([word is None for word in words], dtype=bool),
        codes_of(["".join(word or "" for word in words)])[0],
    )


def joins_between(
    lengths: np.ndarray, sizes: np.ndarray, barred: np.ndarray, letters: np.ndarray
) -> Joins:
    """``joins_of`` from words of each text, letters of each word, and all letters in a row.

    The letters of barred words are not in the row.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    stretch = row + np.cumsum(barred)  # grows at each text and each barred word
    place = np.arange(len(sizes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero((sizes > 0) & ~barred)
    row, stretch, place = row[some], stretch[some], place[some]
    ends = np.cumsum(sizes[some])
    starts = ends - sizes[some]
    found = []
    for away in range(1, WINDOW):
        size = ends[away:] - starts[: len(starts) - away if away < len(starts) else 0]
        fits = np.flatnonzero((stretch[away:] == stretch[: len(size)]) & (size <= WINDOW))
        if not len(fits):
            break
        fits = fits[size[fits] >= 3]
        found.append(np.stack([fits, fits + away]))
    first, last = np.concatenate([*found, np.empty((2, 0), dtype=np.int64)], axis=1)
    return Joins(letters, row[first], place[first], place[last], starts[first], ends[last])


def units_of(token: str) -> list[str]:
    """The stretches of letters that a token is judged by."""
    return stretches(plain_of(token))


def stretches(plain: str) -> list[str]:
    """Letters as they are, or cut into overlapping windows; none of fewer than three."""
    if len(plain) < 3:
        return []
    if len(plain) <= WINDOW:
        return [plain]
    starts = range(0, len(plain) - WINDOW + STRIDE, STRIDE)
    return [plain[s : s + WINDOW] for s in starts]


def tokens_of(text: str) -> list[str]:
    """Words, and runs of single letters taken as one."""
    tokens = text.split()
    runs = _SPACED.findall(text)
    return tokens + ["".join(run.split()) for run in runs] if runs else tokens


def codes_of(units: list[str]) -> np.ndarray:
    """Units of one length as rows of letter numbers."""
    data = np.frombuffer("".join(units).encode("latin-1"), dtype=np.uint8)
    return data.reshape(len(units), -1).astype(np.int32) - 97


def squared_norms(codes: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """The kernel of each row with itself, worked out once for all rows alike."""
    # it depends only on which letters are equal: on each letter's first place in the row
    size = codes.shape[1]
    places = np.zeros(codes.shape, dtype=np.int64)
    for j in range(size - 1, -1, -1):
        np.copyto(places, j, where=codes == codes[:, j : j + 1])
    names = places @ (np.int64(WINDOW + 1) ** np.arange(size)) if size <= 16 else None
    if names is None:
        return _own_kernel(codes, decay)
    _, example, which = np.unique(names, return_index=True, return_inverse=True)
    return _own_kernel(places[example], decay)[which]


def _own_kernel(codes: np.ndarray, decay: float) -> np.ndarray:
    """The kernel of each row with itself, by the usual recursion over positions."""
    rows, size = codes.shape
    same = codes[:, :, None] == codes[:, None, :]
    inner = np.ones((size + 1, size + 1, rows), dtype=np.float64)
    for level in range(2):
        following = np.zeros_like(inner)
        for i in range(1, size + 1):
            along = np.zeros(rows)
            for j in range(1, size + 1):
                along = decay * along + np.where(same[:, i - 1, j - 1], decay**2 * inner[i - 1, j - 1], 0)
                following[i, j] = decay * following[i - 1, j] + along
        inner = following
    total = np.zeros(rows)
    for i in range(2, size):
        for j in range(2, size):
            total += np.where(same[:, i, j], decay**2 * inner[i, j], 0)
    return total


def _triples(size: int) -> Iterator[tuple[int, int, int]]:
    for i in range(size - 2):
        for j in range(i + 1, size - 1):
            for k in range(j + 1, size):
                yield i, j, k


def weighed(codes: np.ndarray, table: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Sums over three-letter subsequences of table rows times decay to their span."""
    total = np.zeros((len(codes), *table.shape[1:]), dtype=table.dtype)
    columns = np.ascontiguousarray(codes.T, dtype=np.intp)
    size = len(columns)
    for span in range(2, size):
        part = np.zeros_like(total)
        for i in range(size - span):
            ends = columns[i] * LETTERS**2 + columns[i + span]
            for j in range(i + 1, i + span):
                part += table.take(ends + columns[j] * LETTERS, axis=0)
        total += decay ** (span + 1) * part
    return total


def features_of(codes: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """The normalised weights of one unit's subsequences, a row of the table's length."""
    out = np.zeros((len(codes), LETTERS**3))
    for i, j, k in _triples(codes.shape[1]):
        at = (codes[:, i] * LETTERS + codes[:, j]) * LETTERS + codes[:, k]
        np.add.at(out, (np.arange(len(codes)), at), decay ** (k - i + 1))
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def packed(units: Sequence[str]) -> np.ndarray:
    """Units as an array of bytes, a fifth of what they take as strings."""
    return np.array([u.encode("latin-1") for u in units], dtype=f"S{WINDOW}")


def _by_length(units: Sequence[str] | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and letter numbers of the units of each length, in chunks."""
    units = units if isinstance(units, np.ndarray) else packed(units)
    lengths = np.char.str_len(units) if len(units) else np.empty(0, dtype=np.int64)
    letters = units.view(np.uint8).reshape(len(units), -1)
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        for first in range(0, len(rows), CHUNK):
            part = rows[first : first + CHUNK]
            yield part, letters[part, :size].astype(np.int32) - 97


@dataclass
class Machine:
    """A trained machine: a weight for each three letters, an offset, and a logit."""

    table: np.ndarray
    offset: float
    logit: np.ndarray | None = None  # of the text's features, the constant last

    def margins(self, units: Sequence[str] | np.ndarray) -> np.ndarray:
        out = np.empty(len(units))
        for rows, codes in _by_length(units):
            sums = weighed(codes, self.table)
            out[rows] = sums / np.sqrt(squared_norms(codes)) + self.offset
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logit, -30, 30)))

    def toxic(self, joins: Joins) -> np.ndarray:
        """The margin of each join where it is positive, else 0.

        Repeated letters only add to a norm, so where the sum is too small for the norm
        of as many different letters, the margin is negative whatever the norm.
        """
        example, which = joins.distinct()
        starts, sizes = joins.start[example], (joins.end - joins.start)[example]
        margins = np.zeros(len(example))
        for size in np.unique(sizes).tolist():
            least = math.sqrt(squared_norms(np.arange(size)[None, :])[0])
            rows = np.flatnonzero(sizes == size)
            for first in range(0, len(rows), CHUNK):
                part = rows[first : first + CHUNK]
                codes = joins.letters[starts[part, None] + np.arange(size)]
                sums = weighed(codes, self.table)
                if self.offset < 0:
                    some = np.flatnonzero(sums / least * (1 + 1e-9) > -self.offset)
                    part, codes, sums = part[some], codes[some], sums[some]
                margins[part] = sums / np.sqrt(squared_norms(codes)) + self.offset
        return np.maximum(margins, 0.0)[which]

    def joined(self, rows: list[list[str]], margin: Mapping[str, float], plain: Mapping[str, str]) -> list[list[float]]:
        """Of each row of words, the margins of toxic joins of words that aren't toxic.

        Of joins that share a word, only the worst counts.
        """
        known = {word: None if margin[word] > 0 else plain[word] for word in set().union(*rows)}
        found = self.worst(joins_of([list(map(known.__getitem__, row)) for row in rows]))
        return [found.get(row, []) for row in range(len(rows))]

    def worst(self, joins: Joins) -> dict[int, list[float]]:
        """The margins of toxic joins that share no word with a worse one, by text."""
        margins = self.toxic(joins)
        found: dict[int, list[float]] = {}
        taken: dict[int, set[int]] = {}
        at = np.flatnonzero(margins > 0)
        for n in at[np.lexsort((joins.last[at], joins.first[at], -margins[at]))].tolist():
            row, words = int(joins.row[n]), range(joins.first[n], joins.last[n] + 1)
            own = taken.setdefault(row, set())
            if own.isdisjoint(words):
                own.update(words)
                found.setdefault(row, []).append(float(margins[n]))
        return found


def text_features(margins: list[float], joined: list[float]) -> tuple[float, float, float, float]:
    """Of a text's tokens and joins: the worst margin, and toxic ones in all and per word."""
    if not margins:
        return -1.0, 0.0, 0.0, 1.0
    values = np.array([*margins, *joined])
    toxic = float(np.clip(values, 0, 1).sum())
    worst = float(np.clip(values.max(), -1, 1))
    return worst, math.log1p(toxic), math.log1p(1000 * toxic / len(margins)), 1.0


def spread_over(units: list[str], count: int, weight: np.ndarray) -> list[str]:
    """Up to ``count`` units, each the one that those before explain least, by weight."""
    left, chosen = np.ones(len(units)), []
    columns = np.zeros((len(units), min(count, len(units))))
    groups = [(rows, codes, np.sqrt(squared_norms(codes))) for rows, codes in _by_length(units)]
    for n in range(columns.shape[1]):
        best = int(np.argmax(left * weight))
        if left[best] * weight[best] < 1e-3:
            break
        chosen.append(units[best])
        feature = features_of(codes_of([units[best]]))[0]
        for rows, codes, norms in groups:
            columns[rows, n] = weighed(codes, feature) / norms
        columns[:, n] -= columns[:, :n] @ columns[best, :n]
        columns[:, n] /= math.sqrt(left[best])
        left = np.maximum(left - columns[:, n] ** 2, 0)
        left[best] = 0
    return chosen


def nystroem_machine(
    units: list[str], toxic: np.ndarray, landmarks: list[str], weight: np.ndarray | None = None
) -> Machine:
    """Train on labelled units; the landmarks' kernel is inverted once, on the driver."""
    # single precision, filled in place: the tallest table that training holds
    stacked = np.zeros((LETTERS**3, len(landmarks)), dtype=np.float32)
    for column, unit in enumerate(landmarks):
        stacked[:, column] = features_of(codes_of([unit]))[0]
    kernel = (stacked.T @ stacked).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    made = np.empty((len(units), len(landmarks)), dtype=np.float32)
    for rows, codes in _by_length(units):
        made[rows] = weighed(codes, stacked) / np.sqrt(squared_norms(codes))[:, None]
    made = np.hstack([made @ root.astype(np.float32), np.ones((len(units), 1), dtype=np.float32)])
    sign = np.where(toxic, 1.0, -1.0)
    # both classes weigh the same in all
    weight = np.ones(len(units)) if weight is None else weight
    cost = PENALTY * weight * np.where(toxic, 0.5 / weight[toxic].sum(), 0.5 / weight[~toxic].sum()) * len(units)
    weights = np.zeros(made.shape[1])
    ridge = np.eye(made.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps on the squared hinge
        active = sign * (made @ weights) < 1
        curve, slope = ridge.copy(), np.zeros(len(weights))
        for first in range(0, len(active), CHUNK):  # sums over chunks, in double precision
            some = np.flatnonzero(active[first : first + CHUNK]) + first
            part = made[some].astype(np.float64)
            costly = part * cost[some, None]
            curve += costly.T @ part
            slope += costly.T @ sign[some]
        new = np.linalg.solve(curve, slope)
        if np.allclose(new, weights, atol=1e-9):
            break
        weights = new
    table = stacked @ (root @ weights[:-1]).astype(np.float32)
    return Machine(table.astype(np.float64), float(weights[-1]))


def _copy_groups(texts: list[str]) -> np.ndarray:
    """A group number for each text; near copies share it, by the overlap of shingles.

    Candidates share one of eight least hashes of five-word shingles; each is compared
    before it joins a group. Texts of fewer words are their own shingle.
    """
    group = np.arange(len(texts))

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    salts = mixed(np.arange(1, 9, dtype=np.uint64))
    seen: dict[tuple[int, int], list[int]] = {}
    sets = []
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        _, runs, _, _, last = shingle_runs([data])
        size = int(last[0])
        whole = np.frombuffer(blake2b(b" ".join(data.split()), digest_size=8).digest(), np.uint64)
        own = np.unique(runs[: size - WORDS + 1]) if size >= WORDS else whole[: min(size, 1)]
        sets.append(own)
        if not len(own):
            continue
        for salt, least in enumerate(mixed(own[None, :] ^ salts[:, None]).min(axis=1).tolist()):
            others = seen.setdefault((salt, least), [])
            for other in others:
                if find(other) == find(row):
                    break
                shared = len(np.intersect1d(own, sets[other], assume_unique=True))
                if shared >= COPIES * (len(own) + len(sets[other]) - shared):
                    group[find(row)] = find(other)
                    break
            else:
                others.append(row)
    return np.array([find(r) for r in range(len(texts))])


def standing_out(in_toxic: Mapping[str, int], in_clean: Mapping[str, int]) -> dict[str, float]:
    """Units likelier in toxic texts, weighed by how surely and how far they are.

    How surely: one less the number of units that chance would let stand out about as
    much, given the counts of all units, over the number found; neighbours in chance are
    pooled so that this never falls as units stand out more. How far: the share of a unit's
    finds in toxic texts, above the usual. There is no bar on counts but that a unit in
    one group of copies can't be told from what is that text's own.
    """
    found = sum(in_toxic.values())
    share = found / max(1, found + sum(in_clean.values()))
    units = {u: (k, k + in_clean.get(u, 0)) for u, k in in_toxic.items()}
    sizes = Counter(n for _, n in units.values()) + Counter(n for u, n in in_clean.items() if u not in in_toxic)
    tails = {n: _tails(n, share) for n in sizes if n > 1}
    chance = {u: float(tails[n][k]) for u, (k, n) in units.items() if k > 1 and k > n * share}
    blocks: list[list] = []  # expected and found numbers, and the chances they go with
    for p in sorted(set(chance.values())):
        # the tails fall, so the first within p is the largest
        firsts = ((n, t[np.searchsorted(-t, -p)]) for n, t in tails.items() if t[-1] <= p)
        blocks.append([sum(sizes[n] * float(first) for n, first in firsts), 0, [p]])
    found_at = Counter(chance.values())
    pooled: list[list] = []
    for (total, _, (p,)), before in zip(blocks, [0.0, *(x[0] for x in blocks)]):
        pooled.append([total - before, found_at[p], [p]])
        while len(pooled) > 1 and pooled[-2][0] * pooled[-1][1] > pooled[-1][0] * pooled[-2][1]:
            last = pooled.pop()
            pooled[-1] = [x + y for x, y in zip(pooled[-1], last)]
    sure = {p: 1 - due / seen for due, seen, chances in pooled for p in chances}
    far = {u: (k / n - share) / (1 - share) if share < 1 else 1.0 for u, (k, n) in units.items()}
    return {u: sure[p] * far[u] for u, p in chance.items() if sure[p] > 1e-9}


def _tails(n: int, share: float) -> np.ndarray:
    """Chances that k or more of n are toxic, for each k."""
    if share >= 1:
        return np.ones(n + 1)
    logs = [
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(share) + (n - k) * math.log1p(-share)
        for k in range(n + 1)
    ]
    return np.cumsum(np.exp(logs)[::-1])[::-1]


def with_insertions(unit: str) -> list[str]:
    """The unit with a letter inserted at each inner place, and with doubled letters."""
    inserted = [f"{unit[:i]}{'xqeo'[i % 4]}{unit[i:]}" for i in range(1, len(unit))]
    doubled = [f"{unit[:i]}{unit[i]}{unit[i:]}" for i in range(1, len(unit) - 1)]
    return [v[:WINDOW] for v in (*inserted, *doubled)]


def train(texts: list[str], toxic: list[bool], share: float | None = None) -> Machine | None:
    """A machine from labelled texts, or None without examples of both kinds.

    ``share`` is the share of toxic texts among all, where the examples' differs.
    """
    labels = np.array(toxic, dtype=bool)
    if not labels.any() or labels.all():
        return None
    tokens = [tokens_of(x) for x in texts]
    vocabulary = {t: units_of(t) for row in tokens for t in row}
    groups = _copy_groups(texts)
    firsts = dict.fromkeys(zip(groups.tolist(), labels.tolist()))
    for row, which in reversed([*enumerate(zip(groups.tolist(), labels.tolist()))]):
        firsts[which] = row
    in_toxic, in_clean = Counter(), Counter()
    for row in firsts.values():
        (in_toxic if labels[row] else in_clean).update(
            {u for t in set(tokens[row]) for u in vocabulary[t]}
        )
    weight_of = standing_out(in_toxic, in_clean)
    # joins with a word that stands out would be right to score high
    plain = {t: None if any(u in weight_of for u in us) else plain_of(t) for t, us in vocabulary.items()}
    clean_rows = [[plain[t] for t in texts[row].split()] for row in firsts.values() if not labels[row]]
    joins = np.unique(
        np.concatenate(
            [packed([])]
            + [joins_of(clean_rows[i : i + 64]).units() for i in range(0, len(clean_rows), 64)]
        )
    )
    del plain, clean_rows
    if not weight_of:  # too few texts to tell: all units that only toxic ones have
        weight_of = {u: 1.0 for u in in_toxic if u not in in_clean}
    seeds = sorted(weight_of, key=lambda u: (-weight_of[u], -in_toxic[u], u))
    if not seeds:
        return None
    rated: dict[str, float] = {}
    for u in seeds:  # what may as well be chance is taken as it is
        for v in (u, *(with_insertions(u) if weight_of[u] >= 0.5 else ())):
            rated.setdefault(v, weight_of[u])
    positive = list(rated)
    central = spread_over(seeds, LANDMARKS // 2, np.array([weight_of[u] for u in seeds]))
    taken = set(positive)
    every = sorted(set(in_clean) - taken)
    joins = joins[~np.isin(joins, packed([*taken, *in_clean]))]
    clean = sorted(every, key=lambda u: (-in_clean[u], u))
    half = NEGATIVE_UNITS // 2
    step = max(1, (len(clean) - half) // half)
    negative = clean[:half] + clean[half::step][:half]
    negative += _unpacked(joins[:: max(1, len(joins) // NEGATIVE_JOINS)])
    known = set(negative)
    machine, margins = None, None
    for _ in range(2):
        if not negative:
            return None
        spread = negative[:: max(1, len(negative) // (LANDMARKS - len(central)))]
        landmarks = [*central, *spread][:LANDMARKS]
        both = [*positive, *negative]
        weight = np.array([*rated.values(), *[1.0] * len(negative)])
        machine = nystroem_machine(both, np.arange(len(both)) < len(positive), landmarks, weight)
        margins = machine.margins(every)
        worst = [every[i] for i in np.argsort(-margins, kind="stable")[:500].tolist()]
        wrong = machine.margins(joins)
        worst += _unpacked(joins[np.argsort(-wrong, kind="stable")[:500]])
        negative += [u for u in worst if u not in known]
        known.update(worst)
    scored = dict(zip(every, margins.tolist()))
    left = sorted({u for own in vocabulary.values() for u in own} - set(scored))
    scored |= dict(zip(left, machine.margins(left).tolist()))
    worst_of = {t: max((scored[u] for u in us), default=-2.0) for t, us in vocabulary.items()}
    plain = {t: plain_of(t) for t in vocabulary}
    features = []
    for first in range(0, len(texts), 256):
        joined = machine.joined([x.split() for x in texts[first : first + 256]], worst_of, plain)
        for row, own in zip(tokens[first : first + 256], joined):
            features.append(text_features([worst_of[t] for t in row], own))
    features = np.array(features)
    weight = np.ones(len(texts))
    if share is not None and 0 < share < 1:
        weight = np.where(labels, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    machine.logit = _logit(features, labels, weight)
    return machine


def _unpacked(units: np.ndarray) -> list[str]:
    return [u.decode("latin-1") for u in units.tolist()]


def _logit(features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    at = np.zeros(features.shape[1])
    ridge = np.diag([0.1] * (len(at) - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ at, -30, 30)))
        slope = features.T @ (weight * (labels - p)) - ridge @ at
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge
        step = np.linalg.solve(curve, slope)
        at = at + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return at


def held_out(key: Column | str) -> Column:
    """Whether an id belongs to the fifth that is never trained on."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def fitted(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Machine | None:
    """Train on at most ``TRAINING_TEXTS`` texts of each label that aren't held out.

    The ids are drawn from the labels alone, so the texts aren't shuffled. Their number
    and length are bounded, and so is what reaches the driver; of several texts of one
    id, the smallest is taken.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    each = known.groupBy(F.col(key).alias("id")).agg((F.max(label) > 0).alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    drawn = None
    for kind in (True, False):
        part = each.filter(F.col("toxic") == kind).orderBy(*order).limit(TRAINING_TEXTS)
        drawn = part if drawn is None else drawn.union(part)
    texts = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.filter(F.length("text") <= TRAINING_CHARS)
    # repeated ids are one row before anything leaves the executors
    chosen = texts.join(F.broadcast(drawn), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = chosen.toPandas().sort_values("id")
    share = each.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    return train(rows["text"].tolist(), rows["toxic"].tolist(), share)


class KnownTokens:
    """Tokens met so far by number, with their margins and letters, in arrays."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.margin = np.empty(0)
        self.size = self.start = np.empty(0, dtype=np.int64)
        self.letters = np.empty(0, dtype=np.int32)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """The numbers of tokens; new ones are judged first."""
        new = set(tokens).difference(self.number)
        if len(self.number) + len(new) > CACHED_TOKENS:
            self.clear()
            new = set(tokens)
        if new:
            self._add(list(new))
        return np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def _add(self, new: list[str]) -> None:
        letters = [plain_of(t) for t in new]
        pairs = [(u, n) for n, own in enumerate(letters) for u in stretches(own)]
        best = np.full(len(new), -2.0)
        if pairs:
            values = self.machine.margins([u for u, _ in pairs])
            np.maximum.at(best, np.fromiter((n for _, n in pairs), np.int64, len(pairs)), values)
        sizes = np.fromiter(map(len, letters), dtype=np.int64, count=len(new))
        starts = len(self.letters) + np.cumsum(sizes) - sizes
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.margin = np.concatenate([self.margin, best])
        self.size = np.concatenate([self.size, sizes])
        self.start = np.concatenate([self.start, starts])
        self.letters = np.concatenate([self.letters, codes_of(["".join(letters)])[0]])

    def features(self, texts: list[str]) -> np.ndarray:
        """``text_features`` of all texts."""
        words = [t.split() for t in texts]
        runs = [("".join(run.split()), n) for n, t in enumerate(texts) for run in _SPACED.findall(t)]
        lengths = np.array([len(row) for row in words], dtype=np.int64)
        flat = [w for row in words for w in row]
        all_numbers = self.numbers(flat + [run for run, _ in runs])
        numbers = all_numbers[: len(flat)]
        rows = np.repeat(np.arange(len(texts)), lengths)
        margins, sizes = self.margin[numbers], self.size[numbers]
        barred = margins > 0
        free = numbers[~barred]
        letters = self.letters[ragged(self.start[free], self.size[free])]
        joined = self.machine.worst(joins_between(lengths, sizes, barred, letters))

        margins = np.concatenate([self.margin[all_numbers], *joined.values()])
        rows = np.concatenate(
            [rows, [n for _, n in runs], *([row] * len(own) for row, own in joined.items())]
        ).astype(np.int64)
        tokens = np.bincount(rows[: len(all_numbers)], minlength=len(texts))
        worst = np.full(len(texts), -1.0)
        np.maximum.at(worst, rows, np.clip(margins, -1, 1))
        toxic = np.bincount(rows, weights=np.clip(margins, 0, 1), minlength=len(texts))
        share = np.log1p(1000 * toxic / np.maximum(tokens, 1))
        return np.stack([worst, np.log1p(toxic), share, np.ones(len(texts))], axis=1)


_KNOWN: dict[str, tuple[bytes, KnownTokens]] = {}


def score_pieces(machine: Machine | None, text: str, output: str = "score"):
    """The function that scores a piece of a batch; words met before aren't scored again."""
    if machine is None:
        return lambda piece: {output: pa.array(np.zeros(piece.num_rows))}
    name = machine.table.tobytes() + np.float64(machine.offset).tobytes()
    if _KNOWN.get("now", (b"",))[0] != name:
        _KNOWN["now"] = name, KnownTokens(machine)
    known = _KNOWN["now"][1]

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        return {output: pa.array(machine.scores(known.features(texts_of(piece, text))))}

    return work


def scores(df: DataFrame, machine: Machine | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``score`` of each text, from 0 to 1."""
    return map_pieces(df, text, None, [key], "score double", lambda: score_pieces(machine, text))


def without_toxic(df: DataFrame, machine: Machine | None, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose texts score below ``limit``, with all their columns."""
    own = "__toxicity"
    scored = map_pieces(
        df, text, None, df.columns, f"{own} double", lambda: score_pieces(machine, text, own)
    )
    return scored.filter(F.col(own) < limit).drop(own)
