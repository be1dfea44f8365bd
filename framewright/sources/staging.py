"""Folders for intermediate tables that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# On a local master without a setting; all tasks share the machine there.
LOCAL_FOLDER = "/tmp/checkpoints"


def staging_folder(spark: SparkSession, purpose: str, folder: str | None = None) -> str:
    """A new path below ``folder``, or below the cluster's checkpoint directory.

    A caller that names the folder owns it and may remove it once the result has
    been written. Otherwise the session's ``spark.checkpoint.dir`` decides, whose
    retention rule then holds.
    """
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = LOCAL_FOLDER
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` now and read it back, free of its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``stored``, and the number of rows, observed by the run that writes them."""
    seen = Observation("stored rows")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    return stored(watched, path), seen.get["rows"]
