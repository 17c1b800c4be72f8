"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.functions.code import quoted
from trajmill.operators import skew


def append_rollouts(df: DataFrame, path: str, run: str) -> None:
    """Add a finished batch to the rollout log; earlier files are never rewritten."""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished the folder: a killed job leaves no success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


RECORD = "_written.json"


def _record(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """The commit record beside a table's files: written, if a text is given, or read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path, RECORD)
    files = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is not None:
        out = files.create(fs_path, True)
        out.write(bytearray(text.encode()))
        out.close()
        return text
    if not files.exists(fs_path):
        return None
    stream = files.open(fs_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def content_digest(df: DataFrame) -> tuple:
    """Rows, and two order-free sums of their hashes: equal for tables with the same rows."""
    row = F.struct(*[df[c] for c in df.columns])
    found = df.agg(
        F.count(F.lit(1)),
        F.coalesce(F.bit_xor(F.xxhash64(row)), F.lit(0)),
        F.coalesce(F.sum(F.hash(row).cast("bigint")), F.lit(0)),
    )
    return tuple(found.first())


def write_once(df: DataFrame, path: str, tag: str | None = None, rewrite: bool = False) -> DataFrame:
    """Write a derived table unless it is there already, and read it back.

    A commit record beside the files keeps the schema and the caller's ``tag``, a name of the input
    such as its version. On reuse the schema must be the same, and the tag if one is given; without
    a tag the rows are compared by an order-free digest, which reads both tables but writes
    nothing. What differs raises a ValueError, or is written anew with ``rewrite``. A folder that a
    stopped job left half written is written anew.
    """
    spark = df.sparkSession
    known = _record(spark, path) if _is_complete(spark, path) else None
    stored = spark.read.schema(df.schema).parquet(path) if known else None
    if known:
        old = json.loads(known)
        same = old["schema"] == df.schema.simpleString()
        same = same and (old["tag"] == tag if tag is not None else content_digest(stored) == content_digest(df))
        if same:
            return stored
        if not rewrite:
            raise ValueError(f"{path} holds another table: give another path, or rewrite=True")
    df.write.mode("overwrite").parquet(path)
    _record(spark, path, json.dumps({"schema": df.schema.simpleString(), "tag": tag}))
    return spark.read.schema(df.schema).parquet(path)


def stringify_nested(df: DataFrame) -> DataFrame:
    """Every array column as JSON text."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({name: F.to_json(name) for name in arrays})


def literal_cell(messages: Column) -> Column:
    """Messages as a Python list literal, the form of foreign CSV cells."""
    items = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("{'role': "), quoted(m["role"]), F.lit(", 'content': "), quoted(m["content"]),
            F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def write_scored_csv(df: DataFrame, path: str, index: str = "row") -> None:
    """Scored rows as CSV with a leading 0-based index and JSON for nested columns.

    JSON escapes line ends, so such files stay splittable as long as the table has no
    plain text column with line ends.
    """
    numbered = skew.number_by_id(df, [], "ID", index)
    flat = stringify_nested(numbered).select(index, *df.columns)
    flat.write.option("header", True).option("escape", '"').mode("error").csv(path)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Metric rows ``(metric, x, value)`` as text lines.

    ``turn`` gives ``Turn x: v``, ``pass_at_k`` gives ``Pass @ x: v`` and ``best_of_n``
    gives ``Best of N=x: v``.
    """
    titles = (
        F.when(F.col("metric") == "pass_at_k", "Pass @ ")
        .when(F.col("metric") == "best_of_n", "Best of N=")
        .otherwise("Turn ")
    )
    line = F.concat(titles, F.col("x").cast("string"), F.lit(": "), F.col("value").cast("string"))
    return metrics.select("run", "metric", "x", line.alias("line"))


def write_metric_lines(metrics: DataFrame, path: str) -> None:
    """One text folder per run and metric, lines in order; a metric has few lines."""
    # The writer keeps an order that starts with its own partition columns.
    lines = metric_lines(metrics).repartition("run", "metric")
    lines = lines.sortWithinPartitions("run", "metric", "x")
    lines.select("run", "metric", "line").write.partitionBy("run", "metric").text(path)


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("line string, run string, metric string").format("text").load(path)
