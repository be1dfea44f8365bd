"""Labels by cut points, as one rule usable natively and from Python."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from numbers import Real

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARISONS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


class _Else:
    """Marks that nulls share the label of the else branch."""

    def __repr__(self) -> str:
        return "ELSE"


ELSE = _Else()


@dataclass(frozen=True)
class BandRule:
    """First cut whose comparison holds gives the label.

    ``compare`` says on which side a value exactly on a cut falls. Cuts must
    ascend for ``<`` and ``<=`` and descend for ``>`` and ``>=``; any other
    order would hide a band. ``null_label`` is ``ELSE`` (a null takes the else
    branch, as in a plain conditional), ``None`` (null in, null out) or a label
    of its own.
    """

    compare: str
    cuts: tuple[tuple[Real, str], ...]
    otherwise: str
    null_label: str | None | _Else = ELSE

    def __post_init__(self) -> None:
        if self.compare not in _COMPARISONS:
            raise ValueError(f"compare must be one of {sorted(_COMPARISONS)}")
        if not self.cuts:
            raise ValueError("a band rule needs at least one cut")
        # the wanted order of the cuts is the strict form of the comparison
        in_order = operator.lt if self.compare.startswith("<") else operator.gt
        values = [cut for cut, _ in self.cuts]
        if not all(in_order(a, b) for a, b in zip(values, values[1:])):
            raise ValueError(f"cuts {values} are out of order for {self.compare!r}")

    @property
    def labels(self) -> tuple[str, ...]:
        """Every label a non-null value can get, in cut order."""
        return tuple(label for _, label in self.cuts) + (self.otherwise,)

    def holds(self, value, cut):
        """Compare a value, column or array with one cut."""
        return _COMPARISONS[self.compare](value, cut)

    @property
    def label_of_null(self) -> str | None:
        return self.otherwise if self.null_label is ELSE else self.null_label

    def column(self, value: Column | str) -> Column:
        """The rule as a native conditional, inside whole-stage codegen.

        Cuts are in order, so where one holds, all later ones do: a balanced tree of
        conditions finds the first in as many comparisons as the number of cuts has
        binary digits. A null takes the right branch each time, to the else label.
        """
        value = F.col(value) if isinstance(value, str) else value
        # cuts of several types may be compared in several types, in which a value
        # could fall between two cuts that it doesn't fall between in another
        alike = len({type(cut) for cut, _ in self.cuts}) == 1
        bands = self._tree(value, 0, len(self.cuts), alike)
        if self.null_label is ELSE:
            return bands
        return F.when(value.isNull(), F.lit(self.null_label)).otherwise(bands)

    def _tree(self, value: Column, first: int, end: int, halves: bool) -> Column:
        """The label by the cuts from ``first`` on, where the one at ``end`` holds."""
        if first == end:
            return F.lit(self.labels[first])
        middle = (first + end - 1) // 2 if halves else first
        return F.when(
            self.holds(value, self.cuts[middle][0]),
            self._tree(value, first, middle, halves),
        ).otherwise(self._tree(value, middle + 1, end, halves))
