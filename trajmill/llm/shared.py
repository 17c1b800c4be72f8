"""Helpers of the operators: stored tables, columns under private names, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajmill.session import new_folder


#: Spark removes the shuffle files of a query when the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared work folder and read it back: it cuts the lineage, and a
    lost executor costs no more than its running tasks. The shuffle files of the writing go at its end."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 600_000


def small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if a count finds it small; larger ones are
    shuffled."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def remove(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """Documents whose labels no model may learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on the values and the seed alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / float(1 << 52)
