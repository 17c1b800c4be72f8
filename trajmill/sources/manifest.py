"""Lookups over listings of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C


def latest_checkpoint(files: DataFrame, keys: list[str]) -> DataFrame:
    """Highest ``checkpoint-<n>`` per group of a listing with a ``name`` column."""
    step = F.regexp_extract("name", C.CHECKPOINT_NAME, 1)
    found = files.where(F.col("name").rlike(C.CHECKPOINT_NAME)).withColumn(
        "step", step.cast("bigint")
    )
    return found.groupBy(*keys).agg(
        F.max("step").alias("step"), F.max_by("name", "step").alias("name")
    )
