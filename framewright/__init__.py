"""framewright: lazy, policy-carrying table transforms for PySpark.

Everything here is a function over ``DataFrame`` or ``Column`` objects. Spark
plans and runs the work; the functions settle what plain calls leave open:
nulls, ties, column names, exact averages and groups too large for one task.
"""

from framewright.functions.bands import ELSE, BandRule
from framewright.functions.measures import exact_avg, wide_sum
from framewright.functions.python_functions import arrow_bands, null_safe_udf
from framewright.operators.averages import stable_average
from framewright.operators.derive import filter_derive
from framewright.operators.enrich import attach_lookup, join_on_key
from framewright.operators.ordering import ordered, ordered_once
from framewright.operators.output import counted_preview, preview
from framewright.operators.pivoting import REFUSE, pivot_measures, pivot_values
from framewright.operators.profile import profile
from framewright.operators.ranking import (
    rank_values,
    rank_values_balanced,
    rank_within,
    rank_within_balanced,
)
from framewright.operators.skew import hot_groups
from framewright.sources.session import RECOMMENDED_SETTINGS, obtain_session
from framewright.sources.tables import load_table, lookup_table

__all__ = [
    "ELSE",
    "BandRule",
    "REFUSE",
    "RECOMMENDED_SETTINGS",
    "arrow_bands",
    "attach_lookup",
    "counted_preview",
    "exact_avg",
    "filter_derive",
    "hot_groups",
    "join_on_key",
    "load_table",
    "lookup_table",
    "null_safe_udf",
    "obtain_session",
    "ordered",
    "ordered_once",
    "pivot_measures",
    "pivot_values",
    "preview",
    "profile",
    "rank_values",
    "rank_values_balanced",
    "rank_within",
    "rank_within_balanced",
    "stable_average",
    "wide_sum",
]
