"""How the sources of a language differ in their words (operator 12).

Spark's CountVectorizer, with ``MIN_DOCS`` as minDF and the largest vocabSize there is,
turns each document into an exact sparse vector over its language's vocabulary. Sums of
these vectors by (language, source) give the counts that all shares come from, in whole
parts of a thousand million: p = 1 + floor(10**9 (count + 1) / (N + V)), N being the sum
of the group's counts and V the size of the vocabulary. Two distributions differ by the
sum over terms of floor((p - q)**2 / q).

CountVectorizer brings its vocabulary to the driver. So that this stays within a bound,
terms, each marked with its language's number, are dealt to shards by hash, about
``SHARD_TERMS`` distinct ones in each (estimated first, over all texts), and each shard is
fitted for all languages together; the tokens are written once, by shard. Counts are
summed in tasks before each shuffle, and pairs of sources are evaluated in blocks of
terms, whose size falls with the number of sources, so neither a language nor a source
with most of the rows makes a task larger.

Null text, language or source counts as ''. Documents without terms make their group
occur. Rows of one id are documents of their own. Groups of a language without
vocabulary have value 0 for all pairs and no term rows. An empty table gives no rows.
Words of any length and texts of any length are taken whole; columns beside the three
play no part. All arithmetic is on integers, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.batches import looked_up, pieces, shared_folder, stored, sum_long, texts_of
from framewright.llm.ordering import numbered
from framewright.llm.spans import mixed, runs_of, span_hashes

MIN_DOCS = 3
LARGEST = 2**31 - 1
SHARD_TERMS = 1_000_000
TOP_TERMS = 200
PARTS = 1_000_000_000
# Cells of a dense block of counts, sources times terms: 8 MB in each of a few copies.
BLOCK_CELLS = 1 << 20
MOST_TERMS = 1 << 12
SKETCH = 4096

_COLON = pa.scalar(":", pa.large_string())

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / (total + terms)), exact for totals below 9 * 10**15.

    Long division, three decimal digits at a time, so no product leaves 64 bits.
    """
    whole = total + terms
    quotient, rest = np.divmod(counts.astype(np.int64) + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digit
    return quotient + 1


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    return (p - q) ** 2 // q


class Terms:
    """The terms of all texts of a piece, as spans of their lower-cased UTF-8 bytes.

    Terms are runs of letters A-Z and of anything beyond ASCII, so they can be cut in
    bytes; only A-Z are lower-cased. ``rows`` has the text of each, ``hashes`` a hash
    of each and of the number of its language.
    """

    def __init__(self, piece: pa.RecordBatch):
        texts = [t.encode("utf-8", "surrogatepass").lower() for t in texts_of(piece, "text")]
        parts = piece.column("part").to_numpy(zero_copy_only=False)
        self.body = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.inside = _IS_TERM[self.body]
        self.starts, self.ends = runs_of(self.inside)
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.rows = np.searchsorted(text_ends, self.starts, side="right")
        self.parts = parts[self.rows]
        self.hashes = mixed(
            span_hashes(self.body, self.starts, self.ends) + self.parts.astype(np.uint64)
        )

    def marked(self) -> pa.Array:
        """Each term as ``part:term``; a colon is in no term."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        terms = pa.LargeStringArray.from_buffers(
            len(self.starts), pa.py_buffer(offsets), pa.py_buffer(self.body[self.inside])
        )
        marks = pa.array(self.parts).cast(pa.large_string())
        return pc.binary_join_element_wise(marks, terms, _COLON).cast(pa.string())


def distinct_terms(df: DataFrame) -> int:
    """About how many distinct terms all languages have, from the least of their hashes.

    Each task keeps its ``SKETCH`` least distinct hashes; the least of all of them are
    as dense as all hashes are, to about 1.6 %. Fewer than that are counted exactly.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.empty(0, dtype=np.uint64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes = Terms(piece).hashes >> np.uint64(1)
                if len(least) == SKETCH:
                    hashes = hashes[hashes < least[-1]]
                least = np.unique(np.concatenate([least, hashes]))[:SKETCH]
        yield pa.RecordBatch.from_pydict({"hash": pa.array(least.astype(np.int64))})

    hashes = df.select("text", "part").mapInArrow(run, "hash bigint").distinct()
    found = hashes.orderBy("hash").limit(SKETCH).agg(F.count("*"), F.max("hash")).first()
    return found[0] if found[0] < SKETCH else int((SKETCH - 1) / found[1] * 2**63)


def tokens(df: DataFrame, shards: int) -> DataFrame:
    """``gid``, ``shard``, ``terms``: a row for each document and shard that it has terms in.

    ``df`` has ``text``, ``gid`` (number of the group) and ``part`` (of the language).
    The terms are one text, set apart by blanks, which is cheaper to pass on and to
    store than an array.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                gids, terms = piece.column("gid"), Terms(piece)
                marked, shard = terms.marked(), terms.hashes % np.uint64(shards)
                for k in range(shards):
                    chosen = np.flatnonzero(shard == k)
                    counts = np.bincount(terms.rows[chosen], minlength=piece.num_rows)
                    have = np.flatnonzero(counts)
                    offsets = np.concatenate([[0], np.cumsum(counts[have])]).astype(np.int32)
                    flat = marked if shards == 1 else marked.take(pa.array(chosen))
                    each = pa.ListArray.from_arrays(pa.array(offsets), flat)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "gid": gids.take(pa.array(have)),
                            "shard": pa.array(np.full(len(have), k, dtype=np.int32)),
                            "terms": pc.binary_join(each, " "),
                        }
                    )

    chosen = df.select("text", "gid", "part")
    return chosen.mapInArrow(run, "gid bigint, shard int, terms string")


def fitted_counts(documents: DataFrame, purpose: str) -> tuple[DataFrame, DataFrame] | None:
    """Sums of the documents' vectors by group, and the vocabulary; None if it is empty.

    The sums have ``gid``, ``index`` and ``n``; the vocabulary ``index`` and ``term``,
    read from the model as Spark saves it, so that it needn't pass through Python.
    """
    spark = documents.sparkSession
    vectorizer = CountVectorizer(
        inputCol="terms", outputCol="vector", minDF=MIN_DOCS, vocabSize=LARGEST
    )
    try:
        model = vectorizer.fit(documents)
    except IllegalArgumentException as refused:
        if "vocabulary size should be > 0" in str(refused):
            return None
        raise
    path = shared_folder(spark, purpose)
    model.save(path)
    vocabulary = spark.read.parquet(f"{path}/data").select(
        F.posexplode("vocabulary").alias("index", "term")
    )
    vector = F.unwrap_udt("vector")
    entries = model.transform(documents).select(
        "gid", F.inline(F.arrays_zip(vector["indices"].alias("index"), vector["values"].alias("n")))
    )
    sums = entries.groupBy("gid", "index").agg(sum_long(F.col("n").cast("bigint")).alias("n"))
    return sums, vocabulary


def counted(documents: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """``gid``, ``term_id``, ``n`` of each group's terms, and ``part``, ``term_id``, ``term``."""
    spark = documents.sparkSession
    path = shared_folder(spark, "divergence-tokens")
    written = tokens(documents, shards).write.option("compression", "zstd")
    written.partitionBy("shard").parquet(path)
    held = spark.read.schema("gid bigint, terms string, shard int").parquet(path)
    held = held.withColumn("terms", F.split("terms", " "))
    sums = [spark.createDataFrame([], "gid bigint, term_id bigint, n bigint")]
    vocabularies = [spark.createDataFrame([], "part bigint, term_id bigint, term string")]
    for shard in range(shards):
        found = fitted_counts(held.filter(F.col("shard") == shard), "divergence-model")
        if found is None:
            continue
        term_id = F.col("index").cast("bigint") + F.lit(shard << 32)
        sums.append(
            stored(found[0].select("gid", term_id.alias("term_id"), "n"), "divergence-counts")
        )
        vocabularies.append(
            found[1].select(
                F.substring_index("term", ":", 1).cast("bigint").alias("part"),
                term_id.alias("term_id"),
                F.substring_index("term", ":", -1).alias("term"),
            )
        )
    vocabulary = stored(reduce(DataFrame.union, vocabularies), "divergence-vocabulary")
    return reduce(DataFrame.union, sums), vocabulary


def _best(values: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The first indexes by value descending, then place."""
    return np.lexsort((places, -values))[:most]


def evaluated(rows: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """A block of a language's terms: partial sums of all pairs, and candidates for terms.

    ``rows`` has a row for each group of the language (``term_id`` -1, its size and the
    vocabulary's in ``n`` and ``size``) and one for each of its counts in the block.
    """
    groups = rows[rows["term_id"] < 0].sort_values("gid")
    counts = rows[rows["term_id"] >= 0]
    gids, sizes = groups["gid"].to_numpy(), groups["n"].to_numpy()
    vocabulary = int(groups["size"].iloc[0])
    terms = terms.sort_values("term_id")
    names, ids = terms["term"].to_numpy(), terms["term_id"].to_numpy()
    table = np.zeros((len(gids), len(ids)), dtype=np.int64)
    table[np.searchsorted(gids, counts["gid"]), np.searchsorted(ids, counts["term_id"])] = counts["n"]
    p = np.stack([shares(row, int(size), vocabulary) for row, size in zip(table, sizes)])
    q = shares(table.sum(axis=0), int(sizes.sum()), vocabulary)
    places = np.empty(len(ids), dtype=np.int64)
    places[np.argsort(names)] = np.arange(len(ids))  # code points order as UTF-8 does
    found = []
    for at, gid in enumerate(gids):
        sums = np.array([spread(p[at], other).sum() for other in p])
        others = np.flatnonzero(gids != gid)
        found.append(
            pd.DataFrame({"gid": gid, "item": gids[others], "term": None, "value": sums[others]})
        )
        over = np.flatnonzero((table[at] > 0) & (p[at] > q))
        values = spread(p[at, over], q[over])
        best = _best(values, places[over], TOP_TERMS)
        found.append(
            pd.DataFrame(
                {"gid": gid, "item": -1, "term": names[over[best]], "value": values[best]}
            )
        )
    return pd.concat(found)


def block_width(sources: int) -> int:
    """Terms of a block, a power of two, so that its dense table stays within bounds."""
    return 1 << max(0, min(MOST_TERMS, BLOCK_CELLS // max(1, sources)).bit_length() - 1)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: the spread of the group against each other source of its language.
    Part ``term``: the ``TOP_TERMS`` terms that the group has more of than its language.
    """
    read = df.select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    occurring = stored(read.select("lang", "source").distinct(), "divergence-groups")
    parts = numbered(occurring.select("lang").distinct(), [F.col("lang")], "part")
    groups = stored(
        numbered(occurring, [F.col("lang"), F.col("source")], "gid").join(parts, "lang"),
        "divergence-groups",
    )
    documents = read.join(looked_up(groups), ["lang", "source"])
    shards = max(1, -(-distinct_terms(documents) // SHARD_TERMS))
    counts, vocabulary = counted(documents, shards)

    sources = groups.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    width = block_width(sources)
    block = F.floor(F.col("term_id") / width).alias("block")
    sizes = counts.groupBy("gid").agg(sum_long("n").alias("n"))
    kept = vocabulary.groupBy("part").agg(F.count("*").alias("size"))
    blocks = vocabulary.select("part", block).distinct().join(kept, "part")
    heads = groups.select("gid", "part").join(sizes, "gid", "left").join(blocks, "part")
    rows = heads.select(
        "part",
        "block",
        "gid",
        F.lit(-1).cast("bigint").alias("term_id"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "size",
    ).union(
        counts.join(looked_up(groups.select("gid", "part")), "gid").select(
            "part", block, "gid", "term_id", "n", F.lit(0).cast("bigint").alias("size")
        )
    )
    found = stored(
        rows.groupBy("part", "block")
        .cogroup(vocabulary.select("part", block, "term_id", "term").groupBy("part", "block"))
        .applyInPandas(evaluated, "gid bigint, item bigint, term string, value bigint"),
        "divergence-blocks",
    )

    own = groups.select("gid", "part", "lang", "source")
    other = groups.select(F.col("gid").alias("item"), "part", F.col("source").alias("named"))
    summed = found.filter("item >= 0").groupBy("gid", "item").agg(F.sum("value").alias("value"))
    pairs = (
        own.join(other, "part")
        .filter("gid <> item")
        .join(summed, ["gid", "item"], "left")
        .select(
            "gid",
            "lang",
            "source",
            F.lit("pair").alias("part"),
            F.col("named").alias("item"),
            F.coalesce("value", F.lit(0)).alias("value"),
        )
    )
    terms = found.filter("item < 0").join(own, "gid")
    terms = terms.select(
        "gid", "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"
    )
    first = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(first)).union(
        terms.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= TOP_TERMS)
    )
    return ranked.drop("gid")
