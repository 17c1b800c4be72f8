"""Readers. Parquet is read with its declared schema, so nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill import constants as C
from trajmill import schemas as S
from trajmill.functions.feedback import positive
from trajmill.sources.literals import parse_literal


def scan_problems(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """One split of a problem table, stored partitioned by ``split``."""
    if dataset not in C.BENCHMARKS:
        raise ValueError(f"unsupported dataset {dataset!r}")
    if split not in C.BENCHMARKS[dataset]:
        raise ValueError(f"{dataset!r} has no split {split!r}")
    problems = spark.read.schema(S.PROBLEMS[dataset]).parquet(path)
    return problems.where(F.col("split") == split)


def scan_rollouts(
    spark: SparkSession, path: str, schema: T.StructType = S.ROLLOUTS
) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_scored_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.SCORED,
    cells: str = "literal",
    multi_line: bool = True,
) -> DataFrame:
    """Scored rollouts from CSV; array columns are restored from their text cells.

    ``cells`` is ``"literal"`` (Python literals, read by the JVM but for odd ones) or ``"json"``. Files whose cells hold no
    raw line ends may be read with ``multi_line=False``, which keeps them splittable.
    """
    header = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )

    def restore(field: T.StructField) -> Column:
        cell = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            if cells == "json":
                return F.from_json(cell, field.dataType).alias(field.name)
            return parse_literal(cell, field.dataType).alias(field.name)
        if isinstance(field.dataType, T.BooleanType):
            # Stored as True/False, 0/1 or 0.0/1.0.
            return F.when(F.lower(cell).isin("true", "false"), F.lower(cell).cast("boolean")).otherwise(
                positive(F.try_to_number(cell, F.lit("9.9")).cast("double"))
            ).alias(field.name)
        return cell.cast(field.dataType).alias(field.name)

    return header.select(*[restore(f) for f in schema.fields if f.name in header.columns])
