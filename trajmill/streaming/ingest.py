"""Rollout files picked up as they arrive, each row stored exactly once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.functions.feedback import positive
from trajmill.sources.sinks import _record


def rollout_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of new Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


#: Index folders of one size that are merged into one of the next.
FAN = 8


class KeyIndex:
    """Where the keys of a table lie: folders of (x, run, batch, bucket) rows, x a hash of the key.

    A record names the live folders and their levels. A batch adds one folder of level 0; as soon
    as FAN folders share a level they are merged into one of the next, so at most FAN - 1 folders
    a level are read. Without a readable record the index is built anew from the table.
    """

    SCHEMA = "x long, run string, batch long, bucket long"

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table, self.home = spark, table, f"{table}/_keys"

    def _files(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, path: str) -> bool:
        files, path = self._files(path)
        return files.exists(path)

    def live(self) -> list | None:
        """[level, folder] of the live folders."""
        text = _record(self.spark, self.home)
        try:
            return None if text is None else json.loads(text)
        except json.JSONDecodeError:
            return None

    def commit(self, live: list) -> None:
        _record(self.spark, self.home, json.dumps(live))

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.home}/{f}" for f in folders])

    def _write(self, rows: DataFrame, level: int) -> list:
        folder = f"{level}-{uuid.uuid4().hex}"
        # Adaptive execution makes as many files as the rows need.
        rows.repartition("x").write.parquet(f"{self.home}/{folder}")
        return [level, folder]

    def add(self, rows: DataFrame) -> None:
        """Index the rows of a batch that is written. Adding a batch again does no harm."""
        live = [*(self.live() or []), self._write(rows, 0)]
        old, level = [], 0
        while len(full := [f for n, f in live if n == level]) >= FAN:
            level, old = level + 1, old + full
            live = [x for x in live if x[1] not in full] + [self._write(self._read(full).distinct(), level)]
        self.commit(live)
        for folder in old:
            files, path = self._files(f"{self.home}/{folder}")
            files.delete(path, True)

    def places(self, hashes: DataFrame, run: str, batch: int) -> list[str]:
        """Folders of other batches in which keys with these hashes may lie."""
        live = self.live()
        if not live:
            return []
        mine = (F.col("run") == run) & (F.col("batch") == batch)
        found = self._read([f for _, f in live]).where(~mine).join(hashes, "x", "left_semi")
        rows = found.select("run", "batch", "bucket").distinct().collect()
        paths = [f"{self.table}/run={r}/batch={n}/bucket={b}" for r, n, b in rows]
        # A batch that was repeated with other rows may have left entries without a folder.
        return [p for p in paths if self.exists(p)]


def ingest_rollouts(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    keys: list[str],
    run: str = "main",
    buckets: int = 8,
) -> None:
    """Append new rows of the stream to ``table`` until no input is left, then stop.

    Rows whose key is stored already are dropped; of rows of one batch with one key the one with
    the smallest hash stays. Every micro-batch owns the partition ``run=<run>/batch=<id>`` and
    overwrites it, and is compared with the other partitions only, so a batch repeated after a
    crash leaves the same rows. Below that, rows lie in buckets by a hash of their key. A batch asks
    the table's KeyIndex in which folders its keys may lie and reads those only; it never lists the
    table. Call again with the same checkpoint and run name to resume; a new checkpoint needs a new
    run name, a table always the same keys. One query writes a table at a time.
    """
    spark = stream.sparkSession
    index = KeyIndex(spark, table)
    key_hash = F.xxhash64(*keys).alias("x")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    place = T.StructType().add("run", "string").add("batch", "long").add("bucket", "long")
    if not index.exists(table):
        # An empty first partition lets the table be read before the first batch.
        nothing = spark.createDataFrame([], stream.schema)
        nothing.write.mode("ignore").parquet(f"{table}/run={run}/batch=-1/bucket=-1")
        index.commit([])
    elif index.live() is None:
        stored = spark.read.schema(T.StructType([*stream.schema.fields, *place.fields])).parquet(table)
        index.add(stored.select(key_hash, *place.names))

    def store(batch: DataFrame, batch_id: int) -> None:
        own = KeyIndex(batch.sparkSession, table)
        row = F.struct(*batch.columns)
        fresh = (
            batch.groupBy(*keys).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
        )
        folders = own.places(batch.select(key_hash).distinct(), run, batch_id)
        reader = batch.sparkSession.read.schema(batch.schema)
        if folders:
            fresh = fresh.join(reader.parquet(*folders).select(*keys), keys, "left_anti")
        folder = f"{table}/run={run}/batch={batch_id}"
        fresh.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = reader.option("recursiveFileLookup", True).parquet(folder)
        own.add(written.select(key_hash, F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"), bucket))

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingested(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(table)


def running_counts(stream: DataFrame, rows: list[str], key: str = "data_id") -> DataFrame:
    """Rollouts and right ones per prompt, kept up to date. The ``rows`` columns tell rows apart: their
    values are kept in the query's state, so a row that is sent again counts once; the first one seen
    counts. The state grows with rows, on disk where the session's state store is RocksDB."""
    return stream.dropDuplicates(rows).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive(F.col("label"))).alias("c")
    )


def running_pass_rate(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    rows: list[str],
    key: str = "data_id",
) -> None:
    """Hand the changed ``(key, n, c)`` rows of each micro-batch to ``sink`` until no input
    is left. Counts are totals, so writing a row again does no harm."""
    query = (
        running_counts(stream, rows, key)
        .writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_folder_sink(table: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each micro-batch's changed rows under ``batch=<id>``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return store


def latest_counts(spark: SparkSession, table: str, key: str = "data_id") -> DataFrame:
    """Newest counts per prompt from what batch_folder_sink kept."""
    rows = spark.read.parquet(table)
    newest = F.max_by(F.struct("n", "c"), "batch").alias("_now")
    return rows.groupBy(key).agg(newest).select(key, "_now.n", "_now.c")
