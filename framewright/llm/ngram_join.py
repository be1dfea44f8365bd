"""Near-duplicate documents by Jaccard similarity of word n-grams (operator 8).

Words are maximal runs without blanks, A-Z in lower case; a document's set holds
its distinct runs of five words, or its whole sequence if that is shorter. Two
documents link when 100 * shared >= 75 * all. Every such pair is found or joined
through others:

1. Equal sets form one class, known by a 64-bit hash.
2. Two sets that similar share one of their first few shingles in any common order.
   The order is by hash, with shingles that are frequent in the corpus at the end.
   Shingles that stand in the prefix of one class only are dropped: a tile is the
   classes that share one.
3. Each class is compared with two of its tiles' classes: the smallest, and the one most
   of whose prefix is shared. The latter tends to be the text that others were made
   from, which is nearer to them than they are to each other. Links found join classes
   into components, so that copies of copies need no further pairs.
4. In tiles that still hold several components, all pairs of different components
   in a size band or neighbouring bands are compared by bitmap signature; small tiles
   are one band. Large tiles are cut into blocks, a task for each pair of blocks.
5. Signatures are parities of hashed shingles: where they differ bounds the overlap
   from above. What passes is decided by intersecting the sorted sets.

Nulls and texts without words have an empty set and link with nothing. Rows of one
id are one node. A row without id links with nothing and has no component. Other
columns play no part. Hashes have 64 bits; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.batches import looked_up, map_pieces, stored, texts_of
from framewright.llm.components import components
from framewright.llm.spans import mixed, runs_of, span_hashes

WORDS = 5
PERCENT = 75
BANDED_ROWS = 64  # tiles of so many classes or fewer are one band
GIVEN_PAIRS = 200_000  # remembered in a task; any repeated after that drop out later
SPREAD = 4  # tasks, at least, for the tiles that share a smallest class
BLOCK_ROWS = 2048  # rows of a tile that one task compares with as many others
LOCALLY_FREQUENT = 4  # documents of one piece of a batch
FREQUENT_SHARE = 1 / 2000  # of all documents; bounds the list of frequent shingles
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_runs(
    texts: list[bytes], words: int = WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in a row, and a hash for the run of words that each begins.

    Returns the words' hashes, the runs' hashes, the words' starts and ends in the
    texts joined by single bytes, and the number of words up to each text's end.
    """
    codes = _LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    starts, ends = runs_of(~_BLANK[codes])
    hashes = span_hashes(codes, starts, ends)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    last = np.searchsorted(starts, np.cumsum(lengths))
    runs = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        runs *= _FACTOR
        runs[: max(0, len(hashes) - k)] += hashes[k:]
    return hashes, mixed(runs), starts, ends, last


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, runs, _, _, last = shingle_runs(texts, words)
    sets, first = [], 0
    for end in last.tolist():
        count = end - first
        if count >= words:
            sets.append(np.unique(runs[first : end - words + 1]))
        elif count:
            steps = _FACTOR ** np.arange(1, count + 1, dtype=np.uint64)
            whole = (hashes[first:end] * steps).sum(dtype=np.uint64, keepdims=True)
            sets.append(mixed(whole + np.uint64(count)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
        first = end
    return sets


def class_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = np.array([mixed(shingles.copy()).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(mixed(total.astype(np.uint64)).view(np.int64)[0])


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """So many first shingles hold one that any similar enough set has first, too."""
    return size - (percent * size + 99) // 100 + 1


def lead_length(size: int, percent: int = PERCENT) -> int:
    """The prefix of a pair's smaller set that holds the first shingle both have.

    Of sizes a <= b the overlap is at least percent * (a + b) / (100 + percent), so at
    least 2 * percent * a / (100 + percent); what comes before it can't be longer.
    """
    return size + 2 * percent * size // -(100 + percent) + 1


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits, two bits or more for each."""
    bits = min(1 << 17, max(64, 2 << int(len(shingles) - 1).bit_length()))
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(signature_: bytes, size: int) -> np.ndarray:
    """A signature at ``size`` bytes: halves are added, which keeps it a parity."""
    bits = np.frombuffer(signature_, dtype=np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(differing: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets can be similar enough, from differing bits and the sum of sizes.

    Each differing bit needs a shingle of one set alone, so the overlap is at most
    half of what is left of both sizes.
    """
    overlap = (sizes - differing) // 2
    return 100 * overlap >= percent * (sizes - overlap)


def links(one: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    shared = int((other[at] == one).sum()) if len(other) else 0
    return shared > 0 and 100 * shared >= percent * (len(one) + len(other) - shared)


def profiles(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``class``, ``bits``, and shingles frequent in the piece.

    The frequent ones stand in the first row of each piece, with their number of
    documents, counted once for each class.
    """

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts_of(piece, text)])
        classes = [class_hash(s) if len(s) else None for s in sets]
        distinct = {c: s for c, s in zip(classes, sets) if c is not None}
        every = np.concatenate(list(distinct.values()) or [np.empty(0, np.uint64)])
        found, counts = np.unique(every, return_counts=True)
        often = counts >= LOCALLY_FREQUENT
        nothing = [None] * (len(sets) - 1)
        kind = pa.list_(pa.int64())
        return {
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "class": pa.array(classes, pa.int64()),
            "bits": pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            "often": pa.array([found[often].view(np.int64), *nothing], kind),
            "often_in": pa.array([counts[often], *nothing], kind),
        }

    outputs = (
        "n_shingles bigint, class bigint, bits binary, often array<bigint>, often_in array<bigint>"
    )
    return map_pieces(df, text, work, [key], outputs)


def frequent_shingles(profiled: DataFrame) -> np.ndarray:
    """Shingles in a fixed share of all documents, so a list of bounded length.

    They only set the order of shingles; any order gives the same links.
    """
    rows = profiled.count()
    each = profiled.select(F.explode(F.arrays_zip("often", "often_in")).alias("x")).select("x.*")
    totals = each.groupBy("often").agg(F.sum("often_in").alias("n"))
    kept = totals.filter(F.col("n") >= max(LOCALLY_FREQUENT, rows * FREQUENT_SHARE)).toPandas()
    return np.sort(kept["often"].to_numpy(dtype=np.int64).view(np.uint64))


def prefixes(df: DataFrame, frequent: np.ndarray, text: str = "text") -> DataFrame:
    """``class``, its size ``n``, how much of the prefix is its ``lead``, and ``prefix``.

    Copies within a piece appear once.
    """

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts_of(piece, text)])
        distinct = {class_hash(s): s for s in sets if len(s)}
        heads = []
        for s in distinct.values():
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                common = frequent[at] == s
                ordered = np.concatenate([s[~common], s[common]])
            else:
                ordered = s
            heads.append(ordered[: prefix_length(len(s))].view(np.int64))
        return {
            "class": pa.array(list(distinct), pa.int64()),
            "n": pa.array([len(s) for s in distinct.values()], pa.int64()),
            "lead": pa.array([lead_length(len(s)) for s in distinct.values()], pa.int64()),
            "prefix": pa.array(heads, pa.list_(pa.int64())),
        }

    outputs = "class bigint, n bigint, lead bigint, prefix array<bigint>"
    return map_pieces(df, text, work, [], outputs)


def full_sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``class`` and ``set`` (sorted, packed) of the rows whose ids are wanted, each."""
    chosen = df.select(key, text).join(
        looked_up(wanted.withColumnRenamed("id", key)), key, "left_semi"
    )

    def work(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts_of(piece, text)])
        return {
            "class": pa.array([class_hash(s) if len(s) else None for s in sets], pa.int64()),
            "set": pa.array([s.tobytes() for s in sets], pa.binary()),
        }

    made = map_pieces(chosen, text, work, [], "class bigint, set binary")
    return made.filter("class is not null")


def _by_signature(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Keep the pairs that sizes and signatures allow."""
    a, b = (known.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    )

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows = zip(columns["bitsa"].to_pylist(), columns["bitsb"].to_pylist())
            apart = []
            for x, y in rows:
                size = min(len(x), len(y))
                apart.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
            sizes = (columns["na"].to_numpy() + columns["nb"].to_numpy()).astype(np.int64)
            passed = may_link(np.array(apart, dtype=np.int64), sizes)
            yield pa.RecordBatch.from_pydict(
                {n: columns[n].filter(pa.array(passed)) for n in ("a", "b")}
            )

    return sized.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(keep, "a bigint, b bigint")


def _exactly(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Keep the pairs whose sets are similar enough."""
    a, b = (sets.select(F.col("class").alias(x), F.col("set").alias(f"set{x}")) for x in "ab")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                columns = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
                passed = [
                    links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    for x, y in zip(columns["seta"].to_pylist(), columns["setb"].to_pylist())
                ]
                yield pa.RecordBatch.from_pydict(
                    {n: columns[n].filter(pa.array(passed, pa.bool_())) for n in ("a", "b")}
                )

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "seta", "setb")
    return joined.mapInArrow(keep, "a bigint, b bigint")


def _shared_tiles(heads: DataFrame) -> DataFrame:
    """``h`` and ``class`` of the prefix shingles that can be the first of a pair.

    The first shingle that a linked pair shares is in the lead of its smaller set, or
    of both if they are equally large. So a tile is of use only if a leading class
    meets a larger one, or another leading one.

    One shuffle serves the count and the join. Nothing refers to it once this has
    returned, so Spark may drop its files before the larger joins that follow.
    """
    each = heads.select(F.posexplode("prefix").alias("at", "h"), "class", "n", "lead")
    # size and lead in one number, to keep the shuffle small
    mark = F.col("n") * 2 + (F.col("at") < F.col("lead")).cast("bigint")
    rows = each.select("h", "class", mark.alias("mark")).repartition("h")
    leads = F.col("mark") % 2 == 1
    size = F.floor(F.col("mark") / 2)
    of_use = rows.groupBy("h").agg(
        F.min(F.when(leads, size)).alias("least_lead"),
        F.max(size).alias("most"),
        F.min(F.when(leads, F.col("class"))).alias("one"),
        F.max(F.when(leads, F.col("class"))).alias("other"),
    )
    of_use = of_use.filter("least_lead < most or one <> other").select("h")
    # all columns on both sides, or the two would be shuffled one by one
    return stored(rows.join(of_use, "h").distinct(), "shingle-tiles")


def _stars(tiles: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of each class with the smallest and the central class of its tiles.

    Of either kind the one that it meets in most tiles is taken; all other pairs are
    left to the comparison of tiles, as far as these don't join their classes.
    """
    counts = tiles.groupBy("class").agg(F.count("*").alias("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    shares = counts.join(known, "class").select("class", (F.col("shared") / prefix).alias("share"))
    ranked = tiles.join(stored(shares, "shingle-shares"), "class")
    heads = ranked.groupBy("h").agg(
        F.min("class").alias("least"),
        F.max(F.struct("share", "class")).getField("class").alias("central"),
    )
    kinds = [F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("star")) for kind in ("least", "central")]
    paired = tiles.join(heads, "h").select("class", F.explode(F.array(*kinds)).alias("x"))
    met = paired.select("class", "x.*").filter("star <> class").groupBy("class", "kind", "star").count()
    best = met.groupBy("class", "kind").agg(
        F.max(F.struct("count", "star")).getField("star").alias("star")
    )
    return best.select(
        F.least("star", "class").alias("a"), F.greatest("star", "class").alias("b")
    ).distinct()


def _open_tiles(placed: DataFrame) -> DataFrame:
    """Tiles that hold several components, one of those with the same classes.

    A passage that texts share gives a tile for each of its shingles; these tiles
    mostly hold the same classes and one of them has all the pairs.
    """
    member = [F.bit_xor(F.xxhash64("class", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    described = placed.groupBy("h").agg(
        F.count("*").alias("rows"),
        F.min("class").alias("low"),
        F.max("class").alias("high"),
        F.min("component").alias("one"),
        F.max("component").alias("other"),
        *member,
    )
    several = described.filter("one <> other")
    one_of = several.groupBy("rows", "low", "high", "x1", "x2").agg(F.min("h").alias("h"))
    return placed.join(one_of.select("h", "rows", "low"), "h")


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of different components in a tile that sizes and signatures allow.

    ``tiles``: h, class, n, bits, component and ``rows``, the classes in the tile, and
    ``low``, the smallest. A row goes to its size band's tile and, as a guest, to that
    of the next band. A passage's tiles mostly share ``low`` and so a few tasks, which
    give each pair once.
    """
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / PERCENT)))).cast("int")
    places = [
        F.when(F.col("rows") <= BANDED_ROWS, F.struct(F.lit(-1).alias("band"), F.lit(False).alias("guest"))),
        F.when(F.col("rows") > BANDED_ROWS, F.struct(band.alias("band"), F.lit(False).alias("guest"))),
        F.when(F.col("rows") > BANDED_ROWS, F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))),
    ]
    banded = tiles.withColumn(
        "to", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull()))
    ).select("h", "low", "class", "n", "bits", "component", "rows", "to.*")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    others = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = banded.withColumns({"own": own, "other": others}).select(
        "low", F.pmod("h", F.lit(SPREAD)).cast("int").alias("salt"), "h", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        "own", "guest", "class", "n", "bits", "component",
    )
    keys = ["band", "p", "q"]
    sorted_ = met.repartition("low", "salt", *keys).sortWithinPartitions("h", *keys)
    return sorted_.mapInArrow(_compare_tiles, "a bigint, b bigint").distinct()


def _compare_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("h", "band", "p", "q", "own", "guest", "class", "n", "bits", "component")
    held: list[list] = [[] for _ in names]
    given: set[tuple[int, int]] = set()  # pairs of this task, lately

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held[0]) > 1:
            pairs = _compare_block(dict(zip(names, held)))
            if len(given) > GIVEN_PAIRS:
                given.clear()
            fresh = [pair for pair in pairs if pair not in given]
            given.update(fresh)
            if fresh:
                a, b = zip(*fresh)
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}
                )
        for column in held:
            column.clear()

    current = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        for row in zip(*columns):
            if row[:4] != current:
                yield from flush()
                current = row[:4]
            for column, value in zip(held, row):
                column.append(value)
    yield from flush()


def _compare_block(rows: dict[str, list]) -> list[tuple[int, int]]:
    """The pairs of a block that sizes and signatures allow, smaller class first."""
    guest, own = np.array(rows["guest"]), np.array(rows["own"])
    classes = np.array(rows["class"], dtype=np.int64)
    n = np.array(rows["n"], dtype=np.int64)
    _, component = np.unique(np.array(rows["component"], dtype=np.int64), return_inverse=True)
    widths = np.array([len(x) for x in rows["bits"]])
    at_width: dict[int, np.ndarray] = {}

    def bits_at(width: int) -> np.ndarray:
        """Signatures of this width; rows with shorter ones stay empty."""
        if width not in at_width:
            made = np.zeros((len(widths), width), dtype=np.uint8)
            for row in np.flatnonzero(widths >= width).tolist():
                made[row] = folded(rows["bits"][row], width)
            at_width[width] = made.view(np.uint64)
        return at_width[width]

    home = np.flatnonzero(~guest)
    p, q = rows["p"][0], rows["q"][0]
    found: list[tuple[int, int]] = []
    for i in home.tolist():
        # hosts meet later hosts and all guests; of two blocks, only the other's rows
        ok = (component != component[i]) & (guest | (classes > classes[i]))
        ok &= 100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])
        if p != q:
            ok &= own != own[i]
        at = np.flatnonzero(ok)
        shorter = np.minimum(widths[at], widths[i])
        for width in np.unique(shorter).tolist():
            part, bits = at[shorter == width], bits_at(width)
            apart = np.bitwise_count(bits[part] ^ bits[i]).sum(axis=1).astype(np.int64)
            part = part[may_link(apart, n[part] + n[i])]
            low, high = np.minimum(classes[part], classes[i]), np.maximum(classes[part], classes[i])
            found += zip(low.tolist(), high.tolist())
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of each row, the smallest linked id."""
    profiled = stored(profiles(df, key, text), "shingle-profiles")
    frequent = frequent_shingles(profiled)
    documents = profiled.select(F.col(key).alias("id"), "n_shingles", "class")
    tiles = _shared_tiles(prefixes(df, frequent, text))

    known = profiled.select("class", F.col("n_shingles").alias("n"), "bits").join(
        tiles.select("class").distinct(), "class", "left_semi"
    )
    known = stored(known.dropDuplicates(["class"]), "shingle-signatures")
    ids = documents.filter("id is not null").groupBy("class").agg(F.min("id").alias("id"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of few pairs whose sets are similar enough."""
        pairs = stored(pairs, "shingle-pairs")
        members = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        wanted = stored(ids.join(members, "class", "left_semi").select("id"), "shingle-ids")
        sets = full_sets(df, wanted, key, text)
        # each class has one wanted id, so only rows that repeat an id give a set again
        rows = documents.join(looked_up(wanted), "id", "left_semi").count()
        if rows > wanted.count():
            sets = sets.dropDuplicates(["class"])
        sets = stored(sets, "shingle-sets")
        return stored(_exactly(pairs, sets), "shingle-links")

    first = linked(_by_signature(_stars(tiles, known), known))
    joined = components(first)
    placed = tiles.select("h", "class").join(joined, tiles["class"] == joined["node"], "left").select(
        "h", "class", F.coalesce("component", "class").alias("component")
    )
    second = linked(_tile_pairs(_open_tiles(stored(placed, "shingle-placed")).join(known, "class")))

    # rows of one id are one node, whatever their sets
    same_id = documents.filter("id is not null and class is not null").groupBy("id").agg(
        F.min("class").alias("a"), F.max("class").alias("b")
    )
    twice = documents.join(same_id.filter("a <> b"), "id").select("a", F.col("class").alias("b"))
    every = components(first.union(second).union(twice.filter("b is not null")))
    return _labelled(documents, every, key)


def _labelled(documents: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Give each document the smallest id of its class's component."""
    named = documents.filter("class is not null").groupBy("class").agg(F.min("id").alias("id"))
    grouped = named.join(every, named["class"] == every["node"], "left").select(
        "class", "id", F.coalesce("component", "class").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("id").alias("least"))
    labels = grouped.join(least, "component").select("class", "least")
    own = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return documents.join(labels, "class", "left").select(
        F.col("id").alias(key), "n_shingles", own.alias("component_id")
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with the smallest id of each group of near-duplicates.

    Of rows that repeat an id one stays, the first by text; rows without id stay.
    """
    found = near_duplicates(df, key, text)
    gone = stored(found.filter(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    kept = df.join(looked_up(gone), key, "left_anti").select(*df.columns)
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    twice = stored(counts.filter("count > 1").select(key), "repeated-ids")
    if twice.isEmpty():
        return kept
    first = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_first() for c in (text, *df.columns)))
    again = kept.join(looked_up(twice), key, "left_semi").select(*df.columns)
    again = again.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")
    return kept.join(looked_up(twice), key, "left_anti").select(*df.columns).unionByName(again)
