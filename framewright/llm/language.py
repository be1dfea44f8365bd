"""Language identification by fusing evidence (operator 5).

Four kinds of evidence meet in one posterior for each text:

* its letters: likelihood of letter trigrams under each language, with one more
  outcome, ``und``, under which all trigrams are alike. Long texts count as
  ``EVIDENCE_GRAMS`` trigrams at most, since neighbouring ones say the same;
* the language its markup declares, and the suffix of its address, by how often they
  go with each language in this corpus;
* its host: the languages of other texts of the host, smoothed towards those of its
  domain, and these towards all texts. A text doesn't vote for itself.

The last three come from grouped sums of the texts' own posteriors, so no label is
needed beyond the bounded sample that the trigram tables are fitted on.

Null and empty texts, and texts without letters, have no likelihood; with no other
evidence they get the most common language with its share as confidence. Evidence that
is null is left out. Repeated rows give repeated rows, null keys a null key.
"""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.batches import looked_up, map_pieces, stored, texts_of

UNKNOWN = "und"
TRAINING_TEXTS = 400  # of each language, at most: those with the smallest hash of the id
LANGUAGES = 256  # more label values are refused, as each adds a table of 128 KB
AT_ONCE = 32  # languages whose texts are on the driver together
GRAM_BITS = 15
EVIDENCE_GRAMS = 120
UNKNOWN_SHARE = 0.01
HOST_STRENGTH, DOMAIN_STRENGTH, SIGN_STRENGTH = 5.0, 20.0, 10.0
DECLARED_TRUST = 0.8
TRAINING_CHARS = 20_000  # longer texts are no examples
_RAW = re.compile(r"<(script|style)\b", re.IGNORECASE)
_RAW_END = {
    name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in ("script", "style")
}
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
# a tag with another's start inside isn't read on, so that no start is read twice
DECLARED = r"(?i)<html[^<>]*?\slang\s*+=\s*+[\"']?([a-z]{2,3})"


def visible_text(page: str) -> str:
    """A page without tags, scripts, styles and comments, its entities resolved.

    One pass: what has no end once has none further on, and isn't looked for again.
    Such a start is read as a tag, or else as text.
    """
    pieces, at, endless = [], 0, set()

    def after(kind: str, end: int) -> int:
        if end < 0:
            endless.add(kind)
        return end

    while (mark := page.find("<", at)) >= 0:
        pieces.append(page[at:mark])
        end = -1
        if page.startswith("<!--", mark) and "comment" not in endless:
            end = after("comment", page.find("-->", mark + 4))
            end = end + 3 if end >= 0 else end
        elif (raw := _RAW.match(page, mark)) and (name := raw[1].lower()) not in endless:
            found = _RAW_END[name].search(page, raw.end())
            end = after(name, found.end() if found else -1)
        if end < 0 and "tag" not in endless:
            end = after("tag", page.find(">", mark + 1))
            end = end + 1 if end >= 0 else end
        pieces.append(" " if end >= 0 else "<")
        at = end if end >= 0 else mark + 1
    pieces.append(page[at:])
    text = _LONG_NUMBER.sub("\N{REPLACEMENT CHARACTER}", "".join(pieces))
    return html_entities.unescape(text)


_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "is" not in _LETTER:
        codes = np.frombuffer(
            "".join(chr(c) if chr(c).isalpha() else " " for c in range(0xD800)).encode("utf-32-le"),
            dtype=np.uint32,
        )
        table = np.ones(0x110000, dtype=bool)  # beyond the first planes, take all
        table[: len(codes)] = codes != 32
        _LETTER["is"] = table
    return _LETTER["is"]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around the letters of all texts, and how many each text has."""
    joined = " " + "  ".join(texts).lower() + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    middle = np.flatnonzero(letter)
    mixed_ = (codes[middle - 1] * np.uint32(31) + codes[middle]) * np.uint32(1009) + codes[middle + 1]
    mixed_ *= np.uint32(2654435761)
    grams = (mixed_ >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), dtype=np.int64, count=len(texts))
    row = np.searchsorted(np.cumsum(lengths), middle - 1, side="right")
    return grams, np.bincount(row, minlength=len(texts))


@dataclass
class TextModel:
    """Log likelihoods of trigrams: a row for each language, ``und`` the last."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Log likelihoods of texts under each language, long texts scaled down."""
        grams, counts = grams_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        some = counts > 0
        starts = (np.cumsum(counts) - counts)[some]
        for column, row in enumerate(self.table):
            if len(starts):
                out[some, column] = np.add.reduceat(row[grams].astype(np.float64), starts)
        scale = np.minimum(1.0, EVIDENCE_GRAMS / np.maximum(counts, 1))
        return out * scale[:, None]


def fit(texts: list[str], languages: list[str]) -> TextModel:
    """Trigram tables of labelled texts, each text counted by shares."""
    names = sorted(set(languages))
    table = np.full((len(names) + 1, 1 << GRAM_BITS), -GRAM_BITS * np.log(2))
    for row, name in enumerate(names):
        grams, _ = grams_of([t for t, own in zip(texts, languages) if own == name])
        counts = np.bincount(grams, minlength=1 << GRAM_BITS) + 0.05
        table[row] = np.log(counts / counts.sum())
    return TextModel([*names, UNKNOWN], table.astype(np.float32))


def fitted(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> TextModel:
    """Fit on at most ``TRAINING_TEXTS`` labelled texts of each language.

    They have up to ``TRAINING_CHARS`` characters, and of several of one id the smallest
    is taken, so what reaches the driver is bounded. Null ids are no examples.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).alias("id")
    )
    # an id with several languages has the smallest; the first of each language by hash
    # are found in tasks before the shuffle, in one pass for all languages
    known = known.agg(F.min(F.lower(label)).alias("language"))
    first = Window.partitionBy("language").orderBy(F.xxhash64("id"), "id")
    drawn = known.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= TRAINING_TEXTS)
    drawn = stored(drawn.select("id", "language"), "language-sample")
    names = [r[0] for r in drawn.select("language").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in column {label!r}")
    texts = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.filter(F.length("text") <= TRAINING_CHARS)
    fits = [fit([], [])]
    for first in range(0, len(names), AT_ONCE):
        some = drawn.filter(F.col("language").isin(sorted(names)[first : first + AT_ONCE]))
        chosen = texts.join(F.broadcast(some), "id").groupBy("id", "language")
        rows = chosen.agg(F.min("text").alias("text")).toPandas().sort_values("id")
        fits.append(fit(rows["text"].tolist(), rows["language"].tolist()))
    tables = [m.table[:-1] for m in fits[1:]] + [fits[0].table]
    return TextModel([n for m in fits[1:] for n in m.languages[:-1]] + [UNKNOWN], np.concatenate(tables))


def host_of(url: Column) -> Column:
    """The host of an address, without user and port, in lower case; null if none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def identify(
    df: DataFrame,
    model: TextModel,
    key: str,
    text: str,
    declared: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    suffix: Column | None = None,
    markup: bool = False,
) -> DataFrame:
    """``key``, ``language``, ``confidence``, and ``posterior`` in the model's order.

    ``markup`` tells that texts are pages of which only what is visible counts.
    """
    nothing = F.lit(None).cast("string")
    signs = {"declared": declared, "host": host, "domain": domain, "suffix": suffix}
    source = df.select(
        F.col(key).alias("__key"),
        F.col(text).alias("__text"),
        *(F.lower(nothing if c is None else c).alias(f"__{n}") for n, c in signs.items()),
    )
    names = model.languages

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = texts_of(piece, "__text")
        if markup:
            texts = [visible_text(t) for t in texts]
        found = model.likelihoods(texts)
        return {"l": pa.array(list(found), pa.list_(pa.float64()))}

    keep = ["__key", *(f"__{n}" for n in signs)]
    seen = map_pieces(source, "__text", work, keep, "l array<double>")
    return _fused(seen, names).withColumnRenamed("__key", key)


def _shares(logs: np.ndarray) -> np.ndarray:
    """Logarithms, row by row, to shares that add up to 1."""
    parts = np.exp(logs - logs.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """A list column as a matrix, null lists as NaN."""
    out = np.full((len(column), size), np.nan)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if known.any():
        flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
        out[known] = flat.reshape(-1, size)
    return out


def _base(size: int) -> np.ndarray:
    """What is expected before any evidence."""
    if size == 1:
        return np.ones(1)
    return np.array([(1 - UNKNOWN_SHARE) / (size - 1)] * (size - 1) + [UNKNOWN_SHARE])


@dataclass
class Fusion:
    """How evidence is put together; ``everywhere`` are the shares over all texts."""

    names: list[str]
    everywhere: np.ndarray

    def posterior(self, logs, votes, host, domain, suffix, declared, sign) -> np.ndarray:
        """Posteriors of texts from likelihoods, own votes and grouped votes."""

        def others(group: np.ndarray) -> np.ndarray:
            return np.maximum(np.nan_to_num(group) - np.where(np.isnan(group), 0, votes), 0)

        def smoothed(group: np.ndarray, strength: float, towards: np.ndarray) -> np.ndarray:
            own = others(group)
            return (own + strength * towards) / (own.sum(axis=1, keepdims=True) + strength)

        def ratio(group: np.ndarray, expected: np.ndarray) -> np.ndarray:
            found = smoothed(group, SIGN_STRENGTH, expected) / self.everywhere
            return np.where(np.isnan(group), 0.0, np.log(found))

        named = np.array([[s == n for n in self.names] for s in sign])
        trusted = np.where(named, DECLARED_TRUST, (1 - DECLARED_TRUST) * self.everywhere)
        known = named.any(axis=1, keepdims=True)  # another language tells nothing
        trusted = np.where(known, trusted, self.everywhere)
        prior = smoothed(host, HOST_STRENGTH, smoothed(domain, DOMAIN_STRENGTH, self.everywhere))
        evidence = ratio(declared, trusted) + ratio(suffix, self.everywhere)
        return _shares(logs + np.log(prior) + evidence)


def _fused(seen: DataFrame, names: list[str]) -> DataFrame:
    size, base = len(names), _base(len(names))

    def vote(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            votes = _shares(_rows(columns["l"], size) + np.log(base))
            made = {f"t{i}": pa.array(votes[:, i]) for i in range(size)}
            yield pa.RecordBatch.from_pydict({**columns, **made})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema)
    votes = [f"t{i}" for i in range(size)]
    doubles = ", ".join(f"{v} double" for v in votes)
    rows = stored(seen.mapInArrow(vote, f"{fields}, {doubles}"), "language-evidence")

    total = rows.agg(*(F.sum(v).alias(v) for v in votes)).first()
    everywhere = np.array([total[v] or 0.0 for v in votes]) + base
    fusion = Fusion(names, everywhere / everywhere.sum())

    joined = rows
    for sign in ("host", "domain", "suffix", "declared"):
        by = f"__{sign}"
        sums = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(
            F.array(*(F.sum(v) for v in votes)).alias(sign)
        )
        joined = joined.join(stored(sums, f"language-{sign}"), by, "left")
    kind = seen.schema["__key"].dataType.simpleString()

    def decide(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            found = fusion.posterior(
                *(_rows(columns[n], size) for n in ("l", "t", "host", "domain", "suffix", "declared")),
                columns["__declared"].to_pylist(),
            )
            best = found.argmax(axis=1) if len(found) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_pydict(
                {
                    "__key": columns["__key"],
                    "language": pa.array([names[i] for i in best], pa.string()),
                    "confidence": pa.array(found[np.arange(len(found)), best]),
                    "posterior": pa.array(list(found), pa.list_(pa.float64())),
                }
            )

    gathered = joined.select(
        "__key", "l", F.array(*votes).alias("t"), "host", "domain", "suffix", "declared", "__declared"
    )
    schema = f"`__key` {kind}, language string, confidence double, posterior array<double>"
    return gathered.mapInArrow(decide, schema)


def in_known_language(
    df: DataFrame,
    model: TextModel,
    text: str = "text",
    declared: str | None = "lang",
    host: str | None = "source",
    least: float = 0.5,
) -> DataFrame:
    """The rows of ``df`` in one of the model's languages, with all their columns.

    Rejected are texts that are likelier in none of them, and those whose likeliest
    language has less than ``least`` of the posterior. Few are, so their hashes are
    looked up; the texts stay where they are unless there are too many of those.
    """
    named = df.withColumn("__row", F.xxhash64(*(f"`{c}`" for c in df.columns)))
    found = identify(
        named,
        model,
        "__row",
        text,
        declared=None if declared is None else F.col(declared),
        host=None if host is None else F.col(host),
    )
    bad = (F.col("language") == UNKNOWN) | (F.col("confidence") < least)
    rejected = stored(found.filter(bad).select("__row").distinct(), "language-rejected")
    return named.join(looked_up(rejected), "__row", "left_anti").drop("__row")
