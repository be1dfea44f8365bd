"""Obtaining a session. Library code never creates or reconfigures one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions at run time and splits skewed
# join partitions; forcing the split keeps it on when it costs one more shuffle
# (for example when the join feeds an aggregate on the same key).
RECOMMENDED_SETTINGS: Mapping[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def obtain_session(
    app_name: str = "framewright",
    master: str | None = None,
    settings: Mapping[str, str] | None = None,
) -> SparkSession:
    """Return the active session, or build one for a script or a test.

    An existing session is returned untouched, so a notebook or job keeps the
    configuration its cluster gave it. ``settings`` only reach a new session.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
