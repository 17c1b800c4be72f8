"""Merging tables across iterations and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_datasets(base: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; extra columns of ``new`` are dropped, missing ones are an error."""
    missing = [c for c in base.columns if c not in new.columns]
    if missing:
        raise ValueError(f"new table lacks columns {missing}")
    return base.unionByName(new.select(*base.columns))


def union_runs(*runs: DataFrame) -> DataFrame:
    """Rollouts of several runs with the same columns."""
    return reduce(DataFrame.unionByName, runs)


def summarize_runs(metrics: dict[tuple[int, str, str], DataFrame]) -> DataFrame:
    """Metric tables ``(metric, x, value)`` per ``(iteration, dataset, split)``, with one
    column per iteration."""
    tagged = [
        df.select(
            F.lit(iteration).alias("iteration"),
            F.lit(dataset).alias("dataset"),
            F.lit(split).alias("split"),
            "metric",
            "x",
            F.col("value").cast("double").alias("value"),
        )
        for (iteration, dataset, split), df in metrics.items()
    ]
    iterations = sorted({iteration for iteration, _, _ in metrics})
    wide = [
        F.max(F.when(F.col("iteration") == i, F.col("value"))).alias(f"iter{i}")
        for i in iterations
    ]
    return union_runs(*tagged).groupBy("dataset", "split", "metric", "x").agg(*wide)
