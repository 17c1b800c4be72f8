"""Where callers plug in their own Python: always Arrow batches, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.operators import skew
from trajmill.session import new_folder


def apply_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Map every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def apply_group(
    df: DataFrame,
    keys: list[str],
    select: Callable[[pd.DataFrame], pd.DataFrame],
    spread: list[str] | None = None,
    limit: int = 100_000,
) -> DataFrame:
    """Rows that ``select`` picks from each group.

    ``select`` gets all rows of one group and returns those it would keep. With ``spread`` the
    caller says that picking from picked parts equals picking from the whole, as for the five best
    rows: then picks are merged level by level. On each, groups of more than ``limit`` rows are dealt
    over shares of half of that by a hash of those columns and the level's number, and picked from
    share by share, until no group is larger; the last picks are made from whole groups. No task gets
    many more rows of a group than ``limit``. A selector that keeps too much for a level to
    shrink is an error: nothing could pick from its whole groups within the limit.
    """
    if spread is None:
        return df.groupBy(*keys).applyInPandas(select, df.schema)

    def select_part(rows: pd.DataFrame) -> pd.DataFrame:
        return select(rows.drop(columns=["_share", "_level"]))

    largest = None
    level = 0
    while True:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= limit:
            return df.groupBy(*keys).applyInPandas(select, df.schema)
        if largest is not None and most > 0.9 * largest:
            raise ValueError(f"select keeps {most} rows of a group: more than {limit} cannot be picked from at once")
        largest = most
        dealt = skew.deal_hot(df.withColumn("_level", F.lit(level)), keys, ["_level", *spread], limit // 2 or 1)
        picked = dealt.groupBy(*keys, "_share").applyInPandas(select_part, df.schema)
        # Every level is counted and picked from again: stored once.
        path = new_folder(df.sparkSession, "picks")
        picked.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
        level += 1


def score_with(
    df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str = "reward"
) -> DataFrame:
    """Add a score column computed batch by batch, e.g. by a model the caller loads.

    The scorer sees only the columns ``prompt`` and ``completion``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = scorer(batch[["prompt", "completion"]])
            yield batch.assign(**{name: pd.Series(scores, index=batch.index, dtype="float64")})

    plain = df.drop(name)
    schema = T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())])
    return plain.mapInPandas(run, schema)
