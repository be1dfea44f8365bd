"""Mixing sources to target weights (operator 10).

The words of each source are added up; water-filling turns weights into targets
of at most ``MOST_REPEATS`` times a source's own size, and targets into repetition
rates. A document is emitted floor(rate) times, and once more where a hash of its
id and a seed, read as a fraction, lies below the rest of the rate.

A null text has no words; null sources are one source, the last in order. Repeated
rows of one id share their fate; null ids draw by their text. A source without words
has rate 0. Columns of the input beside id, text and source play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import stored
from framewright.llm.ordering import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
_DIGITS = 13  # of a hex digest: 52 bits, which a double holds exactly


def word_count(text: Column | str) -> Column:
    """The number of words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """``source``, ``source_size`` and ``target``, one row for each source.

    Sources in code-point order, null last, take the weights in turn. Targets are
    in proportion to the weights, except that none exceeds ``most_repeats`` times
    its source's size. The common level is found in rounds over the small table
    of sources: each sets the sources above their limit to it and shares the rest.
    """
    sizes = df.groupBy(F.col(source).alias("source")).agg(
        F.sum(word_count(text)).alias("source_size")
    )
    order = [F.col("source").asc_nulls_last()]
    placed = numbered(sizes, order, "place")
    turn = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")
    )
    table = stored(
        placed.select(
            "source",
            "source_size",
            turn.alias("weight"),
            (F.col("source_size") * most_repeats).alias("limit"),
        ),
        "mix-sources",
    )
    level = F.lit(None).cast("double")
    capped = -1
    while True:
        above = F.coalesce(F.col("limit") < level * F.col("weight"), F.lit(False))
        now = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(above, 1)).alias("capped"),
        ).first()
        if now["capped"] == capped or not now["open"]:
            break
        capped = now["capped"]
        rest = F.lit(int(now["total"] - now["fixed"])).cast("double")
        level = rest / F.lit(int(now["open"])).cast("double")
    share = level * F.col("weight")
    target = F.when(F.col("limit") < share, F.col("limit").cast("double")).otherwise(share)
    return table.select(
        "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")
    )


def drawn_fraction(key: str, text: str, seed: str = SEED) -> Column:
    """A fraction from 0 up to 1 that depends on id and seed alone."""
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(text)), F.lit(""))
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, _DIGITS)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def repetitions(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    seed: str = SEED,
) -> DataFrame:
    """``key``, kept columns, ``size``, ``source_size``, ``target`` and ``copies``."""
    targets = source_targets(df, text, source).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = drawn_fraction(key, text, seed) < rate - F.floor(rate)
    sized = df.select(
        *dict.fromkeys([key, text, source, *keep]), word_count(text).alias("__size")
    )
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("__source")))
    return joined.select(
        *dict.fromkeys([key, *keep]),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.floor(rate) + extra.cast("bigint")).alias("copies"),
    )


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all its columns.

    Columns named like the operator's own (``size``, ``target``, ...) stay the input's.
    """
    packed = df.select(
        F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(source).alias("__src"),
        F.struct(*(f"`{c}`" for c in df.columns)).alias("__row"),
    )
    taken = repetitions(packed, "__key", "__text", "__src", keep=["__row"])
    repeated = taken.filter("copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return repeated.select("__row.*")
